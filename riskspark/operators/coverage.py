"""Kupiec's coverage tests: regions, power and sample sizes over tables of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions.tests import CHI2_95, pf_lr, tuff_lr


def grid(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def pf_region(cases: DataFrame, crit: float = CHI2_95) -> DataFrame:
    """cases (n, p) with lo and hi: failures that are not rejected."""
    x = cases.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))))
    return x.where(pf_lr(F.col("x"), F.col("n"), F.col("p")) <= crit).groupBy(*cases.columns).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def tuff_region(cases: DataFrame, longest: int = 2000) -> DataFrame:
    """cases (p, crit) with lo and hi: first failures that are not rejected."""
    v = cases.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(longest))))
    return v.where(tuff_lr(F.col("v"), F.col("p")) <= F.col("crit")).groupBy(*cases.columns).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def with_binomial(cases: DataFrame, n: str, p: str) -> DataFrame:
    """cases with x from 0 to n and pmf: ln n! as running sums of logarithms, each case on its own."""
    x = cases.withColumn("x", F.explode(F.sequence(F.lit(0), F.col(n).cast("int"))))
    w = Window.partitionBy(*cases.columns).orderBy("x")
    lf = x.withColumn("_lf", F.sum(F.when(F.col("x") > 0, F.ln("x")).otherwise(0.0)).over(w))
    whole = Window.partitionBy(*cases.columns)
    top = F.max("_lf").over(whole)
    mirrored = lf.select(*cases.columns, (F.col(n) - F.col("x")).alias("x"), F.col("_lf").alias("_rf"))
    return lf.withColumn("_top", top).join(mirrored, [*cases.columns, "x"]).withColumn(
        "pmf", F.exp(F.col("_top") - F.col("_lf") - F.col("_rf") + F.col("x") * F.ln(F.col(p)) + (F.col(n) - F.col("x")) * F.ln(1.0 - F.col(p)))
    ).drop("_lf", "_rf", "_top")


def pf_power(cases: DataFrame) -> DataFrame:
    """cases (n, p, q) with power: how often the test of rate p rejects when the rate is q."""
    region = pf_region(cases.select("n", "p").distinct())
    pmf = with_binomial(cases, "n", "q").join(region, ["n", "p"])
    return pmf.groupBy("n", "p", "q").agg((1.0 - F.sum(F.when(F.col("x").between(F.col("lo"), F.col("hi")), F.col("pmf")).otherwise(0.0))).alias("power"))


def pf_max_n(cases: DataFrame, most: int = 2000) -> DataFrame:
    """cases (x, p) with n: the largest sample in which x failures still reject."""
    each = cases.withColumn("n", F.explode(F.sequence(F.greatest(F.col("x"), F.lit(1)), F.lit(most))))
    return each.where((pf_lr(F.col("x"), F.col("n"), F.col("p")) > CHI2_95) & (F.col("x") / F.col("n") > F.col("p"))).groupBy("x", "p").agg(F.max("n").alias("n"))
