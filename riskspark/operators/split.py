"""Train and test splits without leaks, as small tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions.tests import uniform


@dataclass(frozen=True)
class Split:
    """The rows that are held out: `block` of them from each of `test_starts` on, out of `rows`. `origin` tells how they were drawn and from which data."""

    rows: int
    block: int
    test_starts: tuple[int, ...]
    origin: dict = field(default_factory=dict)

    def ranges(self) -> list[tuple[int, int]]:
        """First row of each held-out range and the row after its last; ranges that touch are one."""
        out: list[tuple[int, int]] = []
        for s in sorted(self.test_starts):
            end = min(s + self.block, self.rows)
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((s, end))
        return out

    @property
    def id(self) -> str:
        """Equal for two splits if and only if they hold out the same rows of the same data, however those were drawn."""
        held = " ".join(f"{a}..{b}" for a, b in self.ranges())
        return hashlib.sha256(f"{self.rows} rows of {self.origin.get('data', '')}: {held}".encode()).hexdigest()[:16]

    def guard(self, rows: int, data: str = "", split_id: str = "") -> None:
        """Raises if the data, or a model's split, are others than this split's."""
        if rows != self.rows:
            raise ValueError(f"the split is of {self.rows} rows, the data have {rows}")
        if data and self.origin.get("data") and data != self.origin["data"]:
            raise ValueError("the split is of other data")
        if split_id and split_id != self.id:
            raise ValueError(f"the model was trained on split {split_id}, this is {self.id}")

    def stored(self) -> dict:
        return {"rows": self.rows, "block": self.block, "test_starts": list(self.test_starts), "origin": self.origin, "id": self.id}

    @staticmethod
    def restored(stored: dict) -> Split:
        """From stored(); an id that doesn't fit means that the file was altered."""
        split = Split(stored["rows"], stored["block"], tuple(stored["test_starts"]), stored["origin"])
        if split.id != stored["id"]:
            raise ValueError("the stored split doesn't fit its id")
        return split


def train_all(rows: int, horizon: int) -> Split:
    """Nothing held out: what is tested lies in the sample."""
    return Split(rows, horizon, (), {"sampling": "none"})


def drawn_blocks(spark: SparkSession, rows: int, block: int, test_frac: float, seeds: Column, spread: bool = True) -> DataFrame:
    """split, b, s: number and first row of each block that a split holds out, for all seeds (an array column) at once.

    Whole blocks are cards that each seed shuffles by a hash of seed and card. If they are to spread over time, the cards in order of time are dealt into as many
    heaps of near equal size as blocks are wanted, and each heap's top card counts; if not, the first cards of the whole deck. The number wanted is the fraction of the
    blocks, a half rounded to even.
    """
    cards = rows // block if block > 0 else 0
    wanted = round(test_frac * cards)
    if not 0 < wanted <= cards:
        raise ValueError(f"{test_frac} of {rows} rows in blocks of {block} is no block to hold out")
    deck = spark.range(cards).select(F.explode(seeds).alias("split"), F.col("id").alias("card"))
    deck = deck.withColumn("u", uniform(F.concat_ws(":", F.col("split").cast("string"), F.col("card").cast("string"))))
    if spread:
        top = deck.groupBy("split", F.expr(f"card * {wanted} div {cards}").alias("heap")).agg(F.min_by("card", F.struct("u", "card")).alias("card"))
    else:
        top = deck.withColumn("place", F.row_number().over(Window.partitionBy("split").orderBy("u", "card"))).where(F.col("place") <= wanted)
    number = F.row_number().over(Window.partitionBy("split").orderBy("card")) - 1
    return top.select("split", number.cast("long").alias("b"), (F.col("card") * block).alias("s"))


def drawn_split(spark: SparkSession, rows: int, horizon: int, seed: int, block: int | None = None, test_frac: float = 0.2, spread: bool = True) -> Split:
    """One split to be stored: blocks of two horizons unless told otherwise. The driver sees a number for each held-out block."""
    size = 2 * horizon if block is None else block
    if size < horizon:
        raise ValueError(f"a block of {size} rows holds no horizon of {horizon}")
    starts = drawn_blocks(spark, rows, size, test_frac, F.array(F.lit(seed)), spread).select("s").collect()
    return Split(rows, size, tuple(sorted(r["s"] for r in starts)), {"sampling": "spread" if spread else "uniform", "test_frac": test_frac, "seed": seed})


def last_part(rows: int, test_frac: float = 0.2) -> Split:
    """The end of the series is held out."""
    cut = int((1.0 - test_frac) * rows)
    return Split(rows, rows - cut, (cut,), {"sampling": "chronological", "test_frac": test_frac})


def blocks_table(spark: SparkSession, split: Split) -> DataFrame:
    """s, b: first row and number of each test block."""
    return spark.createDataFrame([(s, k) for k, s in enumerate(split.test_starts)], "s long, b long")


def split_rows(spark: SparkSession, split: Split) -> DataFrame:
    """t, is_test for each row; blocks are exploded into their rows, which meet the others in an equi-join."""
    test = blocks_table(spark, split).select(F.explode(F.sequence("s", F.col("s") + split.block - 1)).alias("t")).where(F.col("t") < split.rows)
    return spark.range(split.rows).select(F.col("id").alias("t")).join(test.withColumn("is_test", F.lit(True)), "t", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def period_split(days: DataFrame, train: list[tuple[str, str]], test: list[tuple[str, str]]) -> DataFrame:
    """days (t, d) with is_train, is_test: date ranges, both ends inside."""

    def inside(ranges: list[tuple[str, str]]):
        out = F.lit(False)
        for a, b in ranges:
            out = out | F.col("d").between(a, b)
        return out

    return days.withColumn("is_test", inside(test)).withColumn("is_train", inside(train) & ~F.col("is_test"))


def window_starts(flags: DataFrame, n: int, stride: int = 1) -> DataFrame:
    """First rows t of windows of n train rows that touch no test row. flags: t, is_test, rows without gaps."""
    ahead = Window.orderBy("t").rowsBetween(0, n - 1)
    free = F.sum((~F.col("is_test")).cast("int")).over(ahead)
    return flags.withColumn("_n", free).where((F.col("_n") == n) & (F.col("t") % stride == 0)).select("t")


def windows(rets: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """w, k, j, x: the n rows from each start on."""
    places = starts.select(F.col("t").alias("w"), F.posexplode(F.sequence("t", F.col("t") + n - 1)).alias("k", "t"))
    return rets.join(places, "t").select("w", "k", "j", "x")


def test_blocks(spark: SparkSession, split: Split, horizon: int) -> DataFrame:
    """w, t: the rows of the whole h-step pieces of each test block, in order."""
    if horizon > split.block:
        raise ValueError("the horizon is longer than a test block")
    per = split.block // horizon
    return blocks_table(spark, split).select("b", "s", F.explode(F.sequence(F.lit(0), F.lit(per * horizon - 1))).alias("i")).select(
        (F.col("b") * per + F.expr(f"i div {horizon}")).alias("w"), (F.col("s") + F.col("i")).alias("t")
    )


def permuted(df: DataFrame, key: str, seed: int, by: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """df with `place`, from 0: its rows, within each group, in the order of a hash of seed and key; equal hashes by key.

    Rows fall into buckets of the hash, buckets are numbered through from their counts, and rows are ordered within their bucket alone: no task sees a whole group.
    """
    by = by or []
    u = uniform(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    dealt = df.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * buckets))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_u", key)) - 1
    return dealt.join(starts, [*by, "_bucket"]).withColumn("place", F.col("_start") + within).drop("_u", "_bucket", "_start")
