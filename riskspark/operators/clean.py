"""Quotes to panels to returns. Panels are long: valor, d, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_quotes(quotes: DataFrame) -> DataFrame:
    """The price type and currency with most quotes for each valor; ties by type, then currency."""
    counted = quotes.groupBy("valor", "price_type", "currency").agg(F.count("*").alias("n_obs"))
    order = Window.partitionBy("valor").orderBy(F.desc("n_obs"), "price_type", "currency")
    return counted.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def keep_last(quotes: DataFrame, by: list[str], order: str) -> DataFrame:
    """One row for each key, the last in source order."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return quotes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def median_gap(panel: DataFrame) -> DataFrame:
    """valor, gap: the median number of days between its dates; infinite for a single date."""
    w = Window.partitionBy("valor").orderBy("d")
    gaps = panel.select("valor", "d").distinct().withColumn("g", F.datediff("d", F.lag("d").over(w)))
    return gaps.groupBy("valor").agg(F.coalesce(F.median("g"), F.lit(float("inf"))).alias("gap"))


def instruments(panel: DataFrame) -> list:
    """The sorted dictionary of instruments, one entry for each column of the wide panel."""
    return sorted(r[0] for r in panel.select("valor").distinct().collect())


def dense(panel: DataFrame) -> DataFrame:
    """A row for each date and instrument, with null where there is no price."""
    names = panel.agg(F.collect_set("valor").alias("_names"))  # one row, the dictionary of instruments
    days = panel.select("d").distinct().join(F.broadcast(names)).select("d", F.explode("_names").alias("valor"))
    return days.join(panel, ["d", "valor"], "left")


def nonpositive_share(panel: DataFrame) -> DataFrame:
    return panel.groupBy("valor").agg(F.count("value").alias("n"), F.try_divide(F.count_if(F.col("value") <= 0), F.count("value")).alias("share"))


def mask_nonpositive(panel: DataFrame) -> DataFrame:
    return panel.withColumn("value", F.when(F.col("value") > 0, F.col("value")))


def coverage(dense_panel: DataFrame) -> DataFrame:
    return dense_panel.groupBy("valor").agg((F.count("value") / F.count("*")).alias("coverage"))


def forward_fill(dense_panel: DataFrame, limit: int = 2) -> DataFrame:
    w = Window.partitionBy("valor").orderBy("d").rowsBetween(-limit, 0)
    return dense_panel.withColumn("value", F.last("value", ignorenulls=True).over(w))


def complete_rows(dense_panel: DataFrame) -> DataFrame:
    """Only dates on which every instrument has a value."""
    full = dense_panel.groupBy("d").agg((F.count("value") == F.count("*")).alias("full")).where("full").select("d")
    return dense_panel.join(full, "d", "left_semi")


def log_returns(panel: DataFrame) -> DataFrame:
    """valor, d, x: the first date of each instrument has none."""
    w = Window.partitionBy("valor").orderBy("d")
    return panel.withColumn("x", F.ln(F.col("value") / F.lag("value").over(w))).where("x IS NOT NULL").drop("value")


def numbered(returns: DataFrame) -> DataFrame:
    """t, d, j, x: dates numbered from 0. The numbering orders dates alone, one row each."""
    days = returns.select("d").distinct().withColumn("t", (F.row_number().over(Window.orderBy("d")) - 1).cast("long"))
    return returns.join(F.broadcast(days), "d").select("t", "d", F.col("valor").alias("j"), "x")  # one row a date


def returns(panel: DataFrame, ffill: int = 2, min_coverage: float = 0.0, max_nonpositive: float = 0.01) -> DataFrame:
    """Panel to numbered returns: coverage is measured before prices are filled forward, and returns span dropped dates."""
    sound = nonpositive_share(panel).where(F.col("share") <= max_nonpositive).select("valor")
    whole = dense(mask_nonpositive(panel.join(sound, "valor", "left_semi")))
    if min_coverage > 0:
        whole = whole.join(coverage(whole).where(F.col("coverage") >= min_coverage).select("valor"), "valor", "left_semi")
    return numbered(log_returns(complete_rows(forward_fill(whole, ffill))))


def zero_share(rets: DataFrame) -> DataFrame:
    return rets.groupBy("j").agg(F.avg((F.col("x") == 0).cast("int")).alias("share"))


def tail_counts(rets: DataFrame, q: float = 0.05, test_frac: float = 0.2) -> DataFrame:
    """Exceedances of the linear quantiles of the leading rows in either tail, for the feasibility filter."""
    last = rets.agg(F.max("t") + 1).first()[0] or 0
    lead = rets.where(F.col("t") < int((1 - test_frac) * last))
    cuts = lead.groupBy("j").agg(F.percentile("x", F.lit(q)).alias("lo"), F.percentile("x", F.lit(1 - q)).alias("hi"))
    return lead.join(cuts, "j").groupBy("j").agg(F.count_if(F.col("x") < F.col("lo")).alias("n_lo"), F.count_if(F.col("x") > F.col("hi")).alias("n_hi"))


def wide(panel: DataFrame, key: str, value: str) -> DataFrame:
    """A column for each instrument."""
    names = instruments(panel)
    return panel.groupBy(key).pivot("valor", names).agg(F.first(value)).select(key, *[F.col(f"`{n}`").alias(f"v{n}") for n in names])


def weekday(d: Column) -> Column:
    """Monday is 0."""
    return F.weekday(d)
