"""Panels over the driver's tables: canonical long form (valor, d, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import clean

from .shared import kept


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_mean(price: Column) -> Column:
    """Mean of prices in cents: a sum of whole numbers does not depend on the order of rows."""
    return F.sum(F.round(price * 100).cast("long")).cast("double") / F.count(price) / 100


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: an instrument for each line number, the day's mean extended price. Made once of the quotes; queries read the panel."""

    def build() -> DataFrame:
        rows = table(spark, sf_dir, "lineitem")
        return rows.groupBy(F.col("l_linenumber").alias("valor"), F.to_date("l_shipdate").alias("d")).agg(exact_mean(F.col("l_extendedprice")).alias("value"))

    return kept(spark, "panel-p1", [f"{sf_dir}/lineitem.parquet"], build)


def lineitem_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered returns of P1 (t, d, j, x), made once of the panel."""
    return kept(spark, "returns-p1", [f"{sf_dir}/lineitem.parquet"], lambda: clean.returns(lineitem_panel(spark, sf_dir)))


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: an instrument for each supplier nation."""

    def build() -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
        nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("valor"))
        return rows.join(nations, "l_suppkey").groupBy("valor", F.to_date("l_shipdate").alias("d")).agg(exact_mean(F.col("l_extendedprice")).alias("value"))

    return kept(spark, "panel-p2", [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/supplier.parquet"], build)


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: an instrument for each event type, by hour."""
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return rows.groupBy(F.col("event_type").alias("valor"), F.date_trunc("hour", "ts").alias("d")).agg(exact_mean(F.col("value")).alias("value"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed quotes out of lineitem: valor, price_type, currency, d, price, and the source's row order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("valor"), F.col("l_returnflag").alias("price_type"), F.col("l_linestatus").alias("currency"),
        F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("price"), F.col("l_orderkey").alias("ordinal"),
    )
