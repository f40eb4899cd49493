"""Filter interaction audit: what each filter of a set removes, at each place of each order that the filters can be applied in.

Direct relational replay: each document's flags, one bit a filter, meet all orders (a broadcast table of 120 rows for five filters), the steps of an
order are exploded, a document is removed at the first step whose filter it fails, and conditional sums are taken for each part, order and step. Sums
are combined within each task before they are shuffled, so a part with a third of all rows is no more than 600 rows from each task.
DataFrame operations only.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, saved

LETTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Digests that stand for more than this part of all rows are looked up by broadcast, so there are fewer than HOT_SHARE of them.
HOT_SHARE = 10_000


def conditions(text: Column) -> list[Column]:
    """Whether a text, null counting as empty, fails A to D: too short, too repetitive, too many capitals, signs of markup or code."""
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, WORD_GAP), "")
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.char_length(F.regexp_replace(body, "[^A-Z]+", ""))
    return [n < 200, F.lit(100).cast("long") * kinds < F.lit(50).cast("long") * n, F.lit(100).cast("long") * capitals > F.lit(2).cast("long") * F.char_length(body), body.rlike(r"[#$%&*|]")]


def mask(fails: list[Column]) -> Column:
    """Bit k is set where the document fails filter k."""
    out = F.lit(0)
    for k, c in enumerate(fails):
        out = out + F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    return out


def copy_of_smaller(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) with `copy`: whether a smaller doc_id has the same digest. Digests with many rows are looked up by broadcast, at most
    HOT_SHARE of them; the others, none of which has more than that part of the rows, meet theirs in an equi-join."""
    least = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1"), "audit-copies")
    often = F.col("_n") * HOT_SHARE > rows.count()
    hot = least.where(often).select("digest", F.col("_least").alias("_hot"))
    cold = least.where(~often).select("digest", F.col("_least").alias("_cold"))
    both = rows.join(F.broadcast(hot), "digest", "left").join(cold, "digest", "left")
    return both.withColumn("copy", F.coalesce(F.col("doc_id") > F.coalesce("_hot", "_cold"), F.lit(False))).drop("_hot", "_cold")


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, fails (a bit for each of A to E), good, toxic; a row for each row of docs.

    docs: doc_id, text, source; labels: doc_id, quality, toxic; other columns of either are not read. A null text counts as empty, a null source as
    the empty part. Rows with the same doc_id are documents of their own, and none of them is smaller than another. A null doc_id is
    neither smaller nor larger than another, so it fails E never and lets no other fail it. A document labelled more than once is good, or toxic, if any of
    its labels says so; labels of no document are left out. Texts of any length are read whole; equal texts are told by their SHA-256.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask(conditions(F.col("text"))).alias("fails"), F.unhex(F.sha2(F.encode(body, "UTF-8"), 256)).alias("digest"))
    rows = copy_of_smaller(saved(rows, "audit-flags"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return rows.join(marks, "doc_id", "left").select(
        "doc_id", "part", (F.col("fails") + F.when(F.col("copy"), F.lit(1 << 4)).otherwise(F.lit(0))).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")
    )


def orders(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """order, filter_order, bits: all orders of the letters, with the bit of each step's filter."""
    rows = [(k, "".join(p), [1 << letters.index(c) for c in p]) for k, p in enumerate(permutations(letters))]
    return spark.createDataFrame(rows, "order int, filter_order string, bits array<int>")


def replayed(flags: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, filter_order and step: see op12_filter_audit. flags: part, fails, good, toxic. No rows give no parts and so no rows."""
    table = orders(flags.sparkSession, letters)
    first = F.coalesce(*[F.when(F.col("fails").bitwiseAND(F.col("bits")[k]) != 0, F.lit(k)) for k in range(len(letters))], F.lit(len(letters)))
    each = flags.crossJoin(F.broadcast(table.drop("filter_order"))).withColumn("first", first)  # 120 orders
    steps = each.select("part", "order", "fails", "good", "toxic", "first", F.posexplode("bits").alias("at", "bit"))
    fails, removed = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("first") == F.col("at")
    tally = lambda c, name: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).alias(name)
    sums = steps.groupBy("part", "order", "at", "bit").agg(
        tally(F.col("first") > F.col("at"), "kept"), tally(removed, "removed"), tally(fails & (F.col("first") < F.col("at")), "redundant"), tally(F.col("fails") == F.col("bit"), "unique_fails"),
        tally(removed & F.col("good"), "good_lost"), tally(removed & F.col("toxic"), "toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "bit"))  # 120 rows each
    named = sums.withColumn("shapley", shapley).join(F.broadcast(table.drop("bits")), "order")
    return named.select("part", "filter_order", (F.col("at") + 1).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(flagged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


OP12_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
least AS (SELECT body, min(doc_id) AS id FROM d GROUP BY body),
marks AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN d.doc_id > least.id THEN 'E' ELSE '' END AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d JOIN least USING (body) LEFT JOIN marks ON marks.doc_id = d.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE length(a.c || b.c || c.c || d.c || e.c) = len(list_distinct([a.c, b.c, c.c, d.c, e.c]))),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
t AS (SELECT filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS before FROM s),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
r AS (SELECT *, contains(fails, c) AS bad, length(regexp_replace(fails, '[^' || before || '_]', '', 'g')) > 0 AS gone FROM g, t),
x AS (SELECT part, filter_order, step, c, CAST(sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails = c THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN bad AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN bad AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY part, filter_order, step, c)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM x"""
