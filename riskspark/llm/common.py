"""Helpers that the operators share: tables in the shared folder, global ranks and running totals."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.session import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows that one range of a global order holds at most, about.
RANGE_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is set here only if the session names none and all tasks run on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder; on a cluster it has to be one that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='riskspark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def in_one(docs: DataFrame) -> DataFrame:
    """docs with all its columns in one, `row`, so that no name of theirs meets another; `row.*` unpacks them."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"))


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/riskspark/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and no executor is needed to read it again."""
    path = new_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each of x."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ascii_lower(text: Column) -> Column:
    """A-Z only. lower() does just that to a text without other than ASCII bytes, and is faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def in_order(df: DataFrame, order: list[str], tag: str, rows: int | None = None) -> DataFrame:
    """df dealt into ranges of `order` and saved, with each row's range in the column _range."""
    rows = df.count() if rows is None else rows
    n = max(1, math.ceil(rows / RANGE_ROWS))
    return saved(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).withColumn("_range", F.spark_partition_id()), tag)


def with_running_total(df: DataFrame, order: list[str], value: Column, name: str, tag: str) -> DataFrame:
    """Adds the sum of `value` over all rows before each row in the order given.

    Ranges of the order are summed one by one and the few sums, one a range, are added up on the driver;
    so no task ever sees more than one range. Rows with equal `order` follow one another in some order.
    """
    ranged = in_order(df.withColumn("_value", value.cast("long")), order, tag)
    sums = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum")).collect()
    starts, total = [], 0
    for r in sorted(sums, key=lambda r: r["_range"]):
        starts.append((r["_range"], total))
        total += r["_sum"]
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    within = Window.partitionBy("_range").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(offsets), "_range")  # one row a range
        .withColumn(name, F.col("_start") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .drop("_range", "_start", "_value")
    )
