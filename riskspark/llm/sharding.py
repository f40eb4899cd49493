"""Shards along a Hilbert curve over document metadata.

Language, source and size are quantised by how many rows have smaller values, the cells numbered along a Hilbert curve, and the documents
ranked by that number; runs of the ranking make shards of equal row counts. Each shard then spans a compact box
in all dimensions, so that readers can skip files by the minima and maxima of several columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from riskspark.session import ship

from .common import in_one, new_dir, read_table, saved, with_running_total

BITS = 5
#: Bytes of text that one range of the order holds, about.
RANGE_BYTES = 1 << 27


def hilbert_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Index along the Hilbert curve of points whose coordinates lie in [0, 2**bits); vectorised over points."""
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    # From the axes to the transposed index: undo the rotations, from the highest bit down.
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turn, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] & (1 << b)) != 0, flip ^ ((1 << b) - 1), flip)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def string_cuts(rows: DataFrame, column: str, cells: int) -> list[str]:
    """The values at the quantiles that part a string column's rows into cells of near equal numbers of rows; a frequent value is there more than once. Distinct values are
    counted and put in order, whole, range by range; the driver sees one value a cell."""
    counted = rows.groupBy(column).agg(F.count("*").alias("_n"))
    placed = with_running_total(counted, [column], F.col("_n"), "_before", "shard-values")
    total = rows.count()
    first, last = (F.expr(f"({c} * {cells} + {max(total, 1) - 1}) div {max(total, 1)}") for c in ("_before", "(_before + _n)"))
    held = placed.select(F.col(column).alias("v"), F.greatest(first, F.lit(1)).alias("a"), (last - 1).alias("b")).where("a <= b")
    return sorted(r["v"] for r in held.select("v", F.explode(F.sequence("a", "b")).alias("k")).where(F.col("k") < cells).collect())


def cell_cuts(rows: DataFrame, strings: list[str], numbers: list[str], bits: int = BITS) -> dict[str, list]:
    """Of each dimension the values that part rows, which are saved, into 2 ** bits cells of near equal numbers of rows."""
    cells = 2**bits
    steps = [k / cells for k in range(1, cells)]
    found = rows.agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in numbers]).first()
    return {c: string_cuts(rows, c, cells) for c in strings} | {c: list(found[c] or []) for c in numbers}


def with_curve(rows: DataFrame, cuts: dict[str, list], bits: int = BITS) -> DataFrame:
    """rows with their cell's number along the curve in the column curve; equal values share a cell."""

    def cell(c: str) -> Column:
        kind = "string" if cuts[c] and isinstance(cuts[c][0], str) else "bigint"
        edges = F.array(*[F.lit(x) for x in cuts[c]]).cast(f"array<{kind}>")
        return F.size(F.filter(edges, lambda e: e <= F.col(c))) if cuts[c] else F.lit(0)

    @F.pandas_udf("long")
    def index(*found: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([c.to_numpy() for c in found], bits))

    return rows.withColumn("curve", index(*[cell(c) for c in cuts]))


STRINGS, NUMBERS = ["_lang", "_source"], ["size"]


def metadata(of: str = "") -> list[Column]:
    """id, size, crc, lang and source of documents, in columns or in the struct `of`; a null text has no bytes, null metadata count as empty."""
    text = F.coalesce(F.col(f"{of}text"), F.lit(""))
    return [
        F.col(f"{of}doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.coalesce(F.col(f"{of}lang"), F.lit("")).alias("_lang"), F.coalesce(F.col(f"{of}source"), F.lit("")).alias("_source"),
    ]


def shard_and_slot(rows: DataFrame, shards: int, n: int) -> DataFrame:
    shard = F.expr(f"cast(rank * {shards} div {max(n, 1)} as int)")
    return rows.withColumn("shard", shard).withColumn("slot", F.expr(f"rank - (cast(shard as long) * {n} + {shards - 1}) div {shards}"))


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """A row for each row of docs: doc_id, size, text_crc32, curve, rank, shard, slot.

    The law is `rows`: counts of any two shards differ by one at most. A null text has no bytes, null metadata count as empty and sort first,
    repeated rows take neighbouring places, an empty table gives no rows. Other columns of docs are not read. Texts of any length are read for their size and crc alone.
    """
    ship(docs.sparkSession)
    thin = saved(docs.select(*metadata()), "shard-rows")
    placed = with_running_total(with_curve(thin, cell_cuts(thin, STRINGS, NUMBERS)), ["curve", "doc_id", "text_crc32"], F.lit(1), "rank", "shard-order")
    return shard_and_slot(placed, shards, thin.count()).drop("_lang", "_source")


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """Writes docs, all columns, with shard and slot (gapless from 0 in each shard), one folder a shard, its files in the order of slots.

    Whole rows are shuffled once, into ranges of the curve's order that hold RANGE_BYTES of text, about; a row's place is its range's start and its place in the range, so
    that rows are neither joined back nor numbered in one task, and a shard is written by as many tasks as it has ranges. Rows that repeat an identifier and a text take neighbouring
    slots; columns of docs called shard or slot are replaced; an empty table writes no shard.
    """
    ship(docs.sparkSession)
    whole = docs.drop("shard", "slot")
    thin = saved(docs.select(*metadata()), "shard-rows")
    total = thin.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    ranges = max(1, math.ceil((total["bytes"] or 0) / RANGE_BYTES))
    keyed = with_curve(in_one(whole).select("row", *metadata("row.")), cell_cuts(thin, STRINGS, NUMBERS))
    order = ["curve", "doc_id", "text_crc32"]
    dealt = keyed.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = saved(dealt.select("row", F.spark_partition_id().alias("_range"), at.alias("_at")), "shard-ranges")
    starts, before = [], 0
    for r in sorted(kept.groupBy("_range").agg(F.count("*").alias("n")).collect(), key=lambda r: r["_range"]):  # one row a range
        starts.append((r["_range"], before))
        before += r["n"]
    offsets = docs.sparkSession.createDataFrame(starts, "_range int, _start long")
    placed = kept.join(F.broadcast(offsets), "_range").withColumn("rank", F.col("_start") + F.col("_at"))  # one row a range
    shard_and_slot(placed, shards, total["n"]).select("row.*", "shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the shards that were written."""
    docs, path = read_table(spark, sf_dir, "documents"), new_dir(spark, "shards")
    write_shards(docs, 24, path)
    schema = StructType([*docs.schema.fields, StructField("slot", LongType()), StructField("shard", IntegerType())])
    text = F.coalesce(F.col("text"), F.lit(""))
    return spark.read.schema(schema).parquet(path).select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
