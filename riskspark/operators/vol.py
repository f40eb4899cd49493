"""Volatility filters, regimes and filtered historical simulation.

Recursions over time run for each instrument apart, as grouped pandas functions; everything else is relational.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ewma_path(x: np.ndarray, lam: float, start: float, floor: float) -> np.ndarray:
    """Variances: each from the one before and the return before, not under floor; the first is start."""
    out = np.empty(len(x))
    if len(x):
        out[0] = start
    for t in range(1, len(x)):
        out[t] = max(lam * out[t - 1] + (1 - lam) * x[t - 1] ** 2, floor)
    return out


def ewma(rets: DataFrame, train: Column, lam: float = 0.94, floor: float = 0.05) -> DataFrame:
    """t, j, x, sigma. The first variance is that of train rows; floor is a part of its standard deviation."""
    start = rets.where(train).groupBy("j").agg(F.var_pop("x").alias("v"))

    def path(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("t")
        v = df["v"].iloc[0]
        return df[["t", "j", "x"]].assign(sigma=np.sqrt(ewma_path(df["x"].to_numpy(), lam, v, floor**2 * v)))

    kind = rets.schema["j"].dataType.simpleString()
    return rets.select("t", "j", "x").join(F.broadcast(start), "j").groupBy("j").applyInPandas(path, f"t long, j {kind}, x double, sigma double")  # start: one row an instrument


def standardised(filtered: DataFrame) -> DataFrame:
    return filtered.withColumn("e", F.col("x") / F.col("sigma"))


def trailing_vol(pnl: DataFrame, length: int = 63) -> DataFrame:
    """pnl with vol: standard deviation of the rows strictly before, null where there are too few. One series; T rows."""
    w = Window.orderBy("t").rowsBetween(-length, -1)
    return pnl.withColumn("vol", F.when(F.count("r").over(w) == length, F.stddev_pop("r").over(w)))


def terciles(df: DataFrame, column: str) -> DataFrame:
    """df with regime 0, 1, 2; a value on a cut goes up, nulls have none."""
    c = df.agg(F.percentile(column, F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    return df.join(F.broadcast(c)).withColumn("regime", F.when(F.col(column) >= F.col("c")[1], 2).when(F.col(column) >= F.col("c")[0], 1).when(F.col(column).isNotNull(), 0)).drop("c")  # one row


def percentile_rank(df: DataFrame, column: str, train: Column, by: list[str], name: str = "u") -> DataFrame:
    """df with the share of the group's train rows that are not above: running counts over the sorted union, no lookup for each row. Null for a group without train rows."""
    marked = df.withColumn("_train", train.cast("int"))
    up_to = Window.partitionBy(*by).orderBy(column).rangeBetween(Window.unboundedPreceding, 0)
    total = F.sum("_train").over(Window.partitionBy(*by))
    return marked.withColumn(name, F.try_divide(F.sum("_train").over(up_to), total)).drop("_train")


def episodes(days: DataFrame, gap: int = 5) -> DataFrame:
    """first_t, last_t, n of runs of rows t no further apart than gap."""
    w = Window.orderBy("t")
    begun = F.coalesce((F.col("t") - F.lag("t").over(w) > gap).cast("int"), F.lit(0))
    return days.withColumn("_new", begun).withColumn("_run", F.sum("_new").over(w)).groupBy("_run").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n")).drop("_run")


def fhs_laws(innovations: DataFrame, sigma: DataFrame) -> DataFrame:
    """t, x: one-step scenarios for each forecast date: every innovation day (s, j, e) under the date's sigma (t, j, sigma), equal weights.

    Scenario days meet dates feature by feature; the pairs of days are the result itself.
    """
    pairs = sigma.join(innovations, "j")
    return pairs.groupBy("t", "s").agg((F.sum(F.col("e") * F.col("sigma")) / F.count("*")).alias("x"))


def fhs_path_laws(paths: pd.DataFrame | DataFrame, sigma: DataFrame, start: DataFrame, horizon: int, lam: float = 0.94, floor: float = 0.05) -> DataFrame:
    """t, w, x: horizon-step scenarios. paths: (w, k, j, e) innovation windows; the variance recursion runs along each path.

    Windows are dealt into blocks; each date goes to every block, and a block and a slice of the dates are one task's arrays, in which all paths of a date
    advance together.
    """
    steps = paths.where(F.col("k") < horizon).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("k", "j", "e"))).alias("p")).where(F.size("p") > 0)
    states = sigma.join(start, "j").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("j", "sigma", "v"))).alias("s"))
    blocks, slices = (max(1, -(-df.select(c).distinct().count() // rows)) for df, c, rows in ((paths, "w", 4096), (sigma, "t", 256)))
    dealt = steps.withColumn("block", F.pmod(F.xxhash64("w"), F.lit(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    each = states.withColumn("slice", F.pmod(F.xxhash64("t"), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def run(dates: pd.DataFrame, paths: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(paths):
            e = np.array([[q["e"] for q in p] for p in paths["p"]]).reshape(len(paths), horizon, -1)
            for t, s in zip(dates["t"], dates["s"]):
                s2 = np.tile(np.array([q["sigma"] for q in s]) ** 2, (len(paths), 1))
                low, total = floor**2 * np.array([q["v"] for q in s]), np.zeros(len(paths))
                for k in range(horizon):
                    r = np.sqrt(s2) * e[:, k]
                    total += r.mean(axis=1)
                    s2 = np.maximum(lam * s2 + (1 - lam) * r**2, low)
                found.append(pd.DataFrame({"t": t, "w": paths["w"].to_numpy(), "x": total}))
        return pd.concat(found) if found else pd.DataFrame({"t": pd.Series([], dtype="int64"), "w": pd.Series([], dtype="int64"), "x": pd.Series([], dtype="float64")})

    return each.groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice")).applyInPandas(run, "t long, w long, x double")
