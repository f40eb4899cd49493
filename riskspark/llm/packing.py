"""Packing into fixed windows by minimum bin slack.

A document's whole windows stand alone; what is left of each document, shorter than a window, is packed. The packer sees
only how many documents have each remaining length, at most one count for each length below the window, however large
the corpus: for the longest length left, a subset-sum over bitsets with bounded counts finds the multiset of lengths
that fills the window closest to capacity, and that pattern is repeated as long as the counts allow. Documents take
their places by rank among those of their length, which is a join with the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import ship

from .common import read_table, saved, small, with_running_total
from .wordbpe import encoder, tokenizer_file

WINDOW, END_ID = 4096, 2


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length go into one window: the longest, and those that with it come closest to capacity."""
    first = max(n for n, c in counts.items() if c)
    room, chosen = capacity - first, Counter({first: 1})
    reach, layers, whole = 1, [], (1 << (room + 1)) - 1
    for n in sorted((n for n, c in counts.items() if c and n <= room), reverse=True):
        left, step = min(counts[n] - (n == first), room // n), 1
        while left > 0:
            k = min(step, left)
            layers.append((n, k, reach))
            reach |= (reach << (k * n)) & whole
            left, step = left - k, step * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for n, k, before in reversed(layers):
        if not before >> total & 1:
            chosen[n] += k
            total -= k * n
    return dict(chosen)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, first window, number in each window, offset there), and the number of windows."""
    left, used, rows, windows = dict(counts), Counter(), [], 0
    while any(left.values()):
        chosen = fill(left, capacity)
        times, offset = min(left[n] // k for n, k in chosen.items()), 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n, used[n], windows, k, offset))
            offset += n * k
            left[n] -= k * times
            used[n] += k * times
        left = {n: c for n, c in left.items() if c}
        windows += times
    return rows, windows


def piece_sums(docs: DataFrame, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens, and the CRC-32 of each of the document's pieces."""
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_file(tokenizer))  # a vocabulary file of fixed size
    end, size = end_id.to_bytes(4, "little"), 4 * window

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for b in small(batches):
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            sums = [[zlib.crc32(x[k : k + size]) for k in range(0, len(x), size)] for x in ids]
            yield pa.record_batch([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sums, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "sums"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ship(docs.sparkSession)
    return thin.mapInArrow(encode, "doc_id long, doc_tokens long, sums array<long>")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row of docs is a document of its own, whatever its identifier: repeated rows and null identifiers are packed like
    others. A null text is empty and so one end id. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = saved(piece_sums(docs, tokenizer, window, end_id), "pieces").withColumn("left", F.col("doc_tokens") % window).withColumn("full", F.expr(f"doc_tokens div {window}"))
    counts = {r["left"]: r["count"] for r in rows.where("left > 0").groupBy("left").count().collect()}  # fewer rows than a window has places
    planned, windows = plan(counts, window)
    first, before = {}, 0
    for n in sorted(counts):
        first[n], before = before, before + counts[n]
    by_length: dict[int, list] = {}
    for n, rank, sequence, k, offset in planned:
        by_length.setdefault(n, []).append((first[n] + rank, sequence, k, offset))
    places = spark.createDataFrame([(n, sorted(x)) for n, x in by_length.items()], "left long, runs array<struct<place: long, sequence: long, number: long, offset: long>>")
    ranked = with_running_total(rows.where("left > 0").withColumn("ids_crc32", F.element_at("sums", -1)).select("left", "doc_id", "doc_tokens", "ids_crc32"), ["left", "doc_id", "ids_crc32"], F.lit(1), "place", "pack-order")
    rest = (
        ranked.join(F.broadcast(places), "left")  # one row a length
        .withColumn("run", F.element_at(F.filter("runs", lambda r: r["place"] <= F.col("place")), -1))
        .withColumn("nth", F.col("place") - F.col("run.place"))
        .select("doc_id", (F.col("doc_tokens") - F.col("left")).alias("start"), F.col("left").alias("length"), "ids_crc32", "doc_tokens",
                F.expr("run.sequence + nth div run.number").alias("sequence_id"), F.expr("run.offset + nth % run.number * left").alias("offset"))
    )
    numbered = with_running_total(rows.where("full > 0").withColumn("body", F.slice("sums", 1, F.col("full").cast("int"))).select("doc_id", "doc_tokens", "full", "body"), ["doc_id", "doc_tokens"], F.col("full"), "nth", "pack-full")
    whole = numbered.select("doc_id", "doc_tokens", "nth", F.posexplode("body").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k") * F.lit(window).cast("long")).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens",
        (F.col("nth") + F.col("k") + F.lit(windows)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return whole.unionByName(rest)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
