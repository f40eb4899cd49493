"""Prices, scalers and the profit and loss of strategies on windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATH = ["w", "j"]


def prices(windows: DataFrame) -> DataFrame:
    """w, j, k, p: increments summed up from a price of one at step 0."""
    w = Window.partitionBy(*PATH).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    later = windows.select(*PATH, (F.col("k") + 1).alias("k"), (1.0 + F.sum("x").over(w)).alias("p"))
    first = windows.where("k = 0").select(*PATH, F.lit(0).alias("k"), F.lit(1.0).alias("p"))
    return first.unionByName(later)


def buy_and_hold(p: DataFrame, capital: float = 1.0) -> DataFrame:
    return p.groupBy(*PATH).agg((capital * (F.max_by("p", "k") - F.min_by("p", "k"))).alias("pnl"))


def moving_average(p: DataFrame, length: int, name: str) -> DataFrame:
    """The mean of the last values; the first length - 1 values stand for themselves."""
    w = Window.partitionBy(*PATH).orderBy("k").rowsBetween(1 - length, 0)
    return p.withColumn(name, F.when(F.col("k") < length - 1, F.col("p")).otherwise(F.avg("p").over(w)))


def mean_reversion_signal(p: DataFrame, length: int) -> DataFrame:
    """p with z: distance to the mean of the first length + 1 prices, in hundredths."""
    mean = p.where(F.col("k") <= length).groupBy(*PATH).agg(F.avg("p").alias("_ma"))
    return p.join(mean, PATH).withColumn("z", (F.col("p") - F.col("_ma")) / 0.01).drop("_ma")


def trend_signal(p: DataFrame, length: int) -> DataFrame:
    """p with z: short less long moving average, in hundredths."""
    both = moving_average(moving_average(p, length, "_s"), 2 * length, "_l")
    return both.withColumn("z", (F.col("_s") - F.col("_l")) / 0.01).drop("_s", "_l")


def thresholds(signals: DataFrame, low: float = 0.31, high: float = 0.69) -> tuple[float, float]:
    row = signals.agg(F.percentile("z", F.array(F.lit(low), F.lit(high))).alias("c")).first()
    return tuple(row["c"])


def positions(signals: DataFrame, long_at: float, short_at: float, trend: bool) -> DataFrame:
    """signals with pos: opened where z crosses a threshold after it had crossed zero, closed at the next crossing of zero, flat at the end.

    Events with a sign, -1 at a crossing of zero and 1 at an entry, follow one another per path; a position opens where the sign turns up and closes where it turns down.
    """
    order = Window.partitionBy(*PATH).orderBy("k")
    z, before = F.col("z"), F.lag("z").over(order)
    s = signals.withColumn("_b", before)
    cross = F.col("_b").isNull() | ((F.col("_b") < 0) & (z >= 0)) | ((F.col("_b") > 0) & (z <= 0))
    up = lambda at: F.coalesce((F.col("_b") < at) & (z >= at), F.lit(False))
    down = lambda at: F.coalesce((F.col("_b") > at) & (z <= at), F.lit(False))
    short, long = (down(short_at), up(long_at)) if trend else (up(short_at), down(long_at))

    def side(df: DataFrame, enter: Column, sign: int, name: str) -> DataFrame:
        marked = df.withColumn("_sig", F.when(enter, 1).when(cross, -1))
        seen = Window.partitionBy(*PATH).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        turned = marked.withColumn("_last", F.last("_sig", ignorenulls=True).over(seen))
        step = F.when((F.col("_sig") == 1) & (F.col("_last") == -1), sign).when((F.col("_sig") == -1) & (F.col("_last") == 1), -sign).otherwise(0)
        run = Window.partitionBy(*PATH).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        return turned.withColumn("_step", F.when(F.col("k") > 0, step).otherwise(0)).withColumn(name, F.sum("_step").over(run)).drop("_sig", "_last", "_step")

    both = side(side(s, short, -1, "_short"), long, 1, "_long")
    last = F.max("k").over(Window.partitionBy(*PATH))
    return both.withColumn("pos", F.when(F.col("k") == last, 0).otherwise(F.col("_short") + F.col("_long"))).drop("_b", "_short", "_long")


def strategy_pnl(held: DataFrame, capital: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*PATH).orderBy("k")
    return held.withColumn("_n", F.lead("p").over(w)).groupBy(*PATH).agg((capital * F.sum(F.col("pos") * (F.col("_n") - F.col("p")))).alias("pnl"))


def static_portfolios(p: DataFrame, weights: DataFrame) -> DataFrame:
    """w, portfolio, pnl: buy and hold under weights (portfolio, j, weight), scaled to a sum of sizes of one."""
    scaled = weights.withColumn("weight", F.col("weight") / F.sum(F.abs("weight")).over(Window.partitionBy("portfolio")))
    return buy_and_hold(p).join(scaled, "j").groupBy("w", "portfolio").agg(F.sum(F.col("weight") * F.col("pnl")).alias("pnl"))


def joint_score(pnl: DataFrame, v: Column, e: Column, alpha: float, scale: float = 10.0) -> DataFrame:
    """The mean score of a value at risk v and shortfall e, both as profit, for lower tails."""
    x = F.col("pnl")
    hit = (x <= v).cast("double")
    g = lambda y: -scale * y * y / 2
    score = (hit - alpha) * (g(v) - g(x)) + e * hit * (v - x) + alpha * e * (e - v) - alpha * e * e / 2
    return pnl.agg(F.avg(score).alias("score"), F.count("*").alias("n"))


def minmax(windows: DataFrame) -> DataFrame:
    """windows with y: each feature over its range, which is widened a little."""
    w = Window.partitionBy("j")
    return windows.withColumn("y", (F.col("x") - F.min("x").over(w)) / (F.max("x").over(w) - F.min("x").over(w) + 1e-7))


def symmetric(windows: DataFrame) -> DataFrame:
    w = Window.partitionBy("j")
    return windows.withColumn("y", F.col("x") / (F.max(F.abs("x")).over(w) + 1e-12))
