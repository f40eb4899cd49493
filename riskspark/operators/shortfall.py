"""Acerbi and Szekely's tests of expected shortfall, for one law and for a law of each date."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.tests import uniform

from .conditional import order_weights
from .risk import ordinal


def z1_z2(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., n, n_exc, z1, z2 of rows (r, var, es, alpha): z1 is null without exceptions."""
    by = [*(by or []), "alpha"]
    exc = F.col("r") + F.col("var") < 0
    ratio = F.sum(F.when(exc, F.col("r") / F.col("es")).otherwise(0.0))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(exc).alias("n_exc"), (F.when(F.count_if(exc) > 0, ratio / F.count_if(exc)) + 1).alias("z1"), (ratio / (F.count("*") * F.first("alpha")) + 1).alias("z2")
    )


def z3(law: DataFrame, sample: DataFrame, alpha: float, n: int, cells: int) -> DataFrame:
    """n, m, z3 of a sample (t, r) of n rows under one law (i, x, m) of so many cells: the mean of the m least ranks' quantiles over its expectation."""
    m = math.floor(n * alpha)
    if m < 1:
        return law.sparkSession.createDataFrame([(n, m, None)], "n long, m long, z3 double")

    @F.pandas_udf("double")
    def weight(i: pd.Series) -> pd.Series:
        return pd.Series(order_weights(n, m, cells)[i.to_numpy() - 1])

    denominator = law.withColumn("_w", weight("i")).agg((-F.sum(F.col("_w") * F.col("x"))).alias("den"))
    least = sample.orderBy("r", "t").limit(m)
    both = law.select("x", F.lit(1).alias("_c"), F.lit(None).cast("long").alias("t")).unionByName(least.select(F.col("r").alias("x"), F.lit(0).alias("_c"), "t"))
    ranks = both.withColumn("_u", F.sum("_c").over(Window.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)) / cells).where("_c = 0")
    u = F.greatest(F.least("_u", F.lit(1 - 0.5 / cells)), F.lit(0.5 / cells))
    at = ranks.select("t", ordinal(u, F.lit(cells)).cast("int").alias("i"))
    deepest = at.join(law, "i").agg((-F.sum("x") / m).alias("es"))
    return deepest.join(F.broadcast(denominator)).select(F.lit(n).cast("long").alias("n"), F.lit(m).cast("long").alias("m"), (-F.col("es") / F.col("den") + 1).alias("z3"))  # one row each


def simulated(law: DataFrame, n: int, sims: int, cells: int, seed: int = 0) -> DataFrame:
    """sim, k, r: draws from the law by inversion of hashed uniforms."""
    spark = law.sparkSession
    each = spark.range(sims).select(F.col("id").alias("sim"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    u = uniform(F.concat_ws(":", F.lit(str(seed)), F.col("sim").cast("string"), F.col("k").cast("string")))
    return each.withColumn("i", ordinal(u, F.lit(cells)).cast("int")).join(law.select("i", F.col("x").alias("r")), "i").select("sim", "k", "r")


def p_values(observed: DataFrame, sims: DataFrame) -> DataFrame:
    """observed, one row (z1, z2), with the shares of simulations (z1, z2) strictly below; those without exceptions do not count for z1."""
    both = sims.select(F.col("z1").alias("s1"), F.col("z2").alias("s2")).join(F.broadcast(observed.select("z1", "z2")))  # one row
    return both.groupBy("z1", "z2").agg(
        F.avg(F.when(F.col("s1").isNotNull() & F.col("z1").isNotNull(), (F.col("s1") < F.col("z1")).cast("int"))).alias("p1"), F.avg((F.col("s2") < F.col("z2")).cast("int")).alias("p2")
    )
