"""Losses, laws, value at risk and expected shortfall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def portfolio(rets: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """t, r: equal weights unless some are given."""
    if weights is None:
        return rets.groupBy("t").agg((F.sum("x") / F.count("*")).alias("r"))
    w = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    return rets.groupBy("t").agg(F.sum(F.col("x") * F.element_at(w, F.col("j"))).alias("r"))


def window_losses(windows: DataFrame, horizon: int) -> DataFrame:
    """w, loss: of equal weights over the first steps of each window."""
    features = F.countDistinct("j")
    return windows.where(F.col("k") < horizon).groupBy("w").agg((-F.sum("x") / features).alias("loss"))


def law(pnl: DataFrame, by: list[str] | None = None, value: str = "r") -> DataFrame:
    """The sample in order: by..., i from 1, x, m. A law is one sample; partition it by what tells laws apart."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    return pnl.select(*by, F.row_number().over(w).alias("i"), F.col(value).alias("x"), F.count("*").over(whole).alias("m"))


def ordinal(p: Column, m: Column) -> Column:
    """Place, from 1, of the generalised inverse at p."""
    return F.least(F.greatest(F.ceil(F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12)) * m), F.lit(1)), m)


def law_var_es(laws: DataFrame, alphas: list[float], by: list[str] | None = None) -> DataFrame:
    """by..., alpha, var, es at tail probability alpha: the ordinal quantile, and the integral of the law's tail with the
    part of the last place that belongs to it."""
    by = by or []
    each = laws.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    k = F.floor(F.col("alpha") * F.col("m"))
    part = F.when(F.col("i") <= k, F.col("x") / F.col("m")).when(F.col("i") == k + 1, (F.col("alpha") - k / F.col("m")) * F.col("x")).otherwise(0.0)
    return each.groupBy(*by, "alpha").agg(
        (-F.max(F.when(F.col("i") == ordinal(F.col("alpha"), F.col("m")), F.col("x")))).alias("var"), (-F.sum(part) / F.first("alpha")).alias("es"), F.first("m").alias("m")
    )


def var_cvar(losses: DataFrame, levels: list[float], value: str = "loss", by: list[str] | None = None) -> DataFrame:
    """by..., level, var, cvar: linear quantile of losses, and their mean from there on."""
    by = by or []
    cuts = losses.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(p) for p in levels])).alias("q"))
    cuts = cuts.select(*by, F.posexplode("q").alias("_p", "var")).withColumn("level", F.element_at(F.array(*[F.lit(p) for p in levels]), F.col("_p") + 1)).drop("_p")
    joined = losses.join(cuts, by) if by else losses.join(F.broadcast(cuts))  # one row a level
    return joined.where(F.col(value) >= F.col("var")).groupBy(*by, "level", "var").agg(F.avg(value).alias("cvar"), F.count("*").alias("n_tail"))


def exceptions(pnl: DataFrame, var: DataFrame) -> DataFrame:
    """pnl with the columns of var, which has one row for each alpha, and exc."""
    return pnl.join(F.broadcast(var)).withColumn("exc", F.col("r") + F.col("var") < 0)  # one row a level
