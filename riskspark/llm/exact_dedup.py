"""Exact deduplication over a log-structured merge index of digests, DataFrame operations only.

Each batch of documents is dealt over some memtables. A memtable flushes a run: its digests in order, each with the identifier that stays and the number of
rows. Compaction merges runs level by level, FANOUT at a time: the runs' filters, bitmaps of their digests, tell which digests no other run of
the merge has; those go on as they are, and only the others are merged. A further batch adds runs, and what was merged before is not read from the
documents again. A look-up consults a filter over the digests that occur more than once; texts that pass it are grouped by their
bytes, which verifies the hits: a group whose digest stands for several texts is split by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, in_one, new_dir, read_table

#: Memtables that a batch is dealt over, and runs that are merged at once.
MEMTABLES, FANOUT = 8, 4
#: Bits of a filter for each digest, and of the look-up filter at most (8 MB, as it is broadcast); when that fills up it lets more texts through to
#: verification, and the result is the same.
BITS_EACH, MOST_BITS = 16, 1 << 26
#: Bits in one bitmap of Spark's bitmap functions.
BUCKET = 32768


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def filter_bits(digests: int) -> int:
    """A power of two, with BITS_EACH bits for each digest or more."""
    return max(BUCKET, 1 << (max(1, BITS_EACH * digests) - 1).bit_length())


def slot_of(bits: int) -> Column:
    """The digest's place in a filter of so many bits, from 1."""
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def has_bit(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


class DigestIndex:
    """Runs under `path`. keep: which of equal texts stays, the "smallest" or the "largest" identifier."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", digest=sha256) -> None:
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep is {keep}")
        self.spark, self.path, self.keep, self.digest = spark, path, keep, digest
        #: Runs by level: the table that holds them and their numbers in it.
        self.levels: list[list[tuple[str, int]]] = [[]]
        self.flushes = 0

    def keyed(self, docs: DataFrame) -> DataFrame:
        text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
        return docs.select("doc_id", text.alias("body")).withColumn("digest", self.digest(F.col("body")))

    def best(self, column: str = "doc_id") -> Column:
        return (F.min if self.keep == "smallest" else F.max)(column)

    def write(self, rows: DataFrame, path: str) -> None:
        """Sorted by digest in each file, which holds the rows of one task, with a Bloom filter beside, of a size that follows its digests (1 KB to 1 MB)."""
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true", "parquet.bloom.filter.candidates.number": "10"}
        rows.sortWithinPartitions("run", "digest").write.options(**bloom).parquet(path)

    def flush(self, docs: DataFrame) -> None:
        """Adds the rows of docs as MEMTABLES runs; the texts are read once."""
        path = f"{self.path}/rows/{self.flushes}"
        rows = self.keyed(docs).select("digest", F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.spark_partition_id(), F.lit(MEMTABLES)).alias("run"))
        self.write(rows, path)
        runs = self.spark.read.parquet(path).groupBy("run", "digest").agg(self.best().alias("keep_id"), F.count("*").alias("group_size"))
        self.write(runs, f"{self.path}/runs/0-{self.flushes}")
        self.levels[0] += [(f"{self.path}/runs/0-{self.flushes}", k) for k in range(MEMTABLES)]
        self.flushes += 1

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/rows/{k}" for k in range(self.flushes)])

    def merge(self, runs: list[tuple[str, int]], to: str) -> None:
        """Merges runs, FANOUT at a time in their order, into the runs of a new table."""
        place = {r: k for k, r in enumerate(runs)}
        parts = None
        for path in dict(runs):
            own = self.spark.read.parquet(path)
            numbers = F.create_map(*[F.lit(x) for p, k in runs if p == path for x in (k, place[p, k])])
            own = own.withColumn("run", F.element_at(numbers, F.col("run"))).where("run IS NOT NULL")
            parts = own if parts is None else parts.unionByName(own)
        bits = filter_bits(parts.count() // len(runs))
        placed = parts.withColumn("to", F.floor(F.col("run") / FANOUT).cast("int")).withColumn("bucket", F.bitmap_bucket_number(slot_of(bits))).withColumn("at", F.bitmap_bit_position(slot_of(bits)))
        filters = placed.groupBy("to", "bucket", "run").agg(F.bitmap_construct_agg("at").alias("bits")).groupBy("to", "bucket").agg(F.collect_list(F.struct("run", "bits")).alias("filters"))  # FANOUT bitmaps of 4 KB
        filters.write.parquet(f"{to}-filters")
        held = placed.join(self.spark.read.parquet(f"{to}-filters"), ["to", "bucket"])
        looked_up = held.select("to", "digest", "keep_id", "group_size", F.exists("filters", lambda f: (f["run"] != F.col("run")) & has_bit(f["bits"], F.col("at"))).alias("hit"))
        looked_up.write.parquet(f"{to}-looked-up")
        looked_up = self.spark.read.parquet(f"{to}-looked-up")
        hits = looked_up.where("hit").groupBy("to", "digest").agg(self.best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        both = hits.unionByName(looked_up.where("NOT hit").drop("hit"))
        self.write(both.withColumnRenamed("to", "run"), to)

    def compact(self) -> DataFrame:
        """Merges all runs, level by level, into one segment: digest, keep_id, group_size."""
        level = 0
        while sum(map(len, self.levels)) > 1:
            if level + 1 == len(self.levels):
                self.levels.append([])
            runs, self.levels[level] = self.levels[level], []
            if len(runs) == 1:
                self.levels[level + 1] += runs
            elif runs:
                to = f"{self.path}/runs/{level + 1}-{self.flushes}"
                self.merge(runs, to)
                self.levels[level + 1] += [(to, k) for k in range(-(-len(runs) // FANOUT))]
            level += 1
        path, run = next(r for some in self.levels for r in some)
        return self.spark.read.parquet(path).where(F.col("run") == run).drop("run")

    def verify(self, docs: DataFrame, segment: DataFrame) -> DataFrame | None:
        """Groups by bytes the texts whose digest occurs more than once.

        None if every digest stands for one text, else the texts of digests that stand for several:
        digest, body, keep_id, group_size.
        """
        hits = segment.where("group_size > 1")
        size = min(MOST_BITS, filter_bits(hits.count()))
        bits = hits.select(slot_of(size).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        doubtful = (
            self.keyed(docs).withColumn("bucket", F.bitmap_bucket_number(slot_of(size))).withColumn("at", F.bitmap_bit_position(slot_of(size)))
            .join(F.broadcast(bits), "bucket")  # at most MOST_BITS / BUCKET rows of 4 KB
            .where(has_bit(F.col("bits"), F.col("at"))).select("digest", "body", "doc_id")
        )
        doubtful.groupBy("digest", "body").agg(self.best().alias("keep_id"), F.count("*").alias("group_size")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/verified")
        verified = self.spark.read.parquet(f"{self.path}/verified")
        several = verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
        if several.isEmpty():
            return None
        return verified.join(several, "digest", "left_semi")

    def groups(self, docs: DataFrame) -> DataFrame:
        """A row for each row of docs, all that have been flushed: doc_id, keep_id, group_size, digest, kept, copies.

        Of rows that repeat both text and identifier one is kept. copies: how many rows have this text and this doc_id.
        """
        segment = self.compact()
        split = self.verify(docs, segment)
        rows = self.rows().groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))
        if split is None:
            found = rows.join(segment, "digest")
        else:
            clear = rows.join(split, "digest", "left_anti").join(segment, "digest")
            by_text = self.keyed(docs).join(split, ["digest", "body"]).groupBy("digest", "body", "doc_id").agg(F.count("*").alias("copies"), F.first("keep_id").alias("keep_id"), F.first("group_size").alias("group_size"))
            found = clear.unionByName(by_text.drop("body"))
        return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
            "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "digest", "copies"
        )


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """Flushes docs into a new index and returns its groups.

    A null text counts as empty. Null identifiers sort before all others, stay only if their group has no other,
    and are told apart by nothing; repeated rows are one group of which one row is kept. An empty table gives no rows.
    """
    index = DigestIndex(docs.sparkSession, new_dir(docs.sparkSession, "exact"), keep)
    index.flush(docs)
    return index.groups(docs)


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs, all its columns, without the rows that exact_groups() does not keep. Of rows that repeat an identifier and a text any one stays."""
    kept = exact_groups(docs, keep).where("kept").select(F.col("doc_id").alias("id"), "digest", "copies")
    whole = in_one(docs)
    left = whole.select("row", sha256(ascii_lower(F.coalesce("row.text", F.lit("")))).alias("own"))
    joined = left.join(kept, (F.col("own") == F.col("digest")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    once = joined.where("copies = 1").select("row.*")
    if kept.where("copies > 1").isEmpty():
        return once
    return once.unionByName(joined.where("copies > 1").dropDuplicates(["id", "digest"]).select("row.*"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
"""
