"""URL filters by hash prefixes, DataFrame operations only.

Each URL is expanded into host suffixes and path prefixes, as deep as any rule goes; the expressions meet the rules
in an equi-join on the first hex digits of their SHA-256, and a hit counts once the full digests and the rule's whole
path agree. Of the rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read_table

#: (verdict, host and path)
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null URL or one without ://"""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: verdict string, rule string, a host with a path from its first slash on. Rules of equal length that both
    fit: the one with the longer path wins, then the first verdict, then the first rule, in alphabetical order.
    pages may hold any columns beside url; those named host, path, rule or verdict are replaced. Null and malformed URLs fit no rule and get
    the default. An empty table of rules gives the default to all. The expansion is made once for each distinct
    host and path, so a host or URL with a large part of all rows costs no more than another.
    """
    parts = F.split("rule", "/", 2)
    rules = (
        rules.where(F.col("rule").isNotNull() & (F.col("rule") != "")).dropDuplicates(["rule", "verdict"])
        .withColumn("rule_host", ascii_lower(parts[0]))
        .withColumn("rule_path", F.expr("substring(rule, length(split(rule, '/', 2)[0]) + 1)"))
        .withColumn("key", F.concat("rule_host", F.regexp_extract("rule_path", r"^(?s)(.*/)?", 0)))
    )
    depth = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(F.size(F.split("rule_path", "/"))).alias("slashes")).first()
    labels, slashes = depth["labels"] or 0, (depth["slashes"] or 1) - 1
    rules = rules.withColumn("rule_digest", F.sha2("key", 256)).withColumn("prefix", F.substring("rule_digest", 1, prefix_digits))
    host, path = host_and_path(F.col("url"))
    pages = pages.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    places = pages.where("host != '' OR path != ''").select("host", "path").distinct()
    host_parts, path_parts = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(host_parts), F.lit(max(1, labels)))), lambda k: F.array_join(F.slice(host_parts, F.size(host_parts) - k + 1, k), "."))
    deepest = F.least(F.size(path_parts) - 1, F.lit(slashes))
    prefixes = F.when(deepest < 1, F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(deepest, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(path_parts, 1, k), "/"), F.lit("/"))))
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    found = (
        places.withColumn("key", F.explode(keys)).withColumn("digest", F.sha2("key", 256)).withColumn("prefix", F.substring("digest", 1, prefix_digits))
        .join(rules.select("prefix", "rule_digest", "rule_path", "rule", F.col("verdict")), "prefix")
        .where((F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("a"), (-F.length("rule_path")).alias("b"), "verdict", "rule")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return pages.join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, rule string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return with_rule(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
rule_parts AS (SELECT verdict, rule, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM rests),
fits AS (
  SELECT host, path, rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC) AS nth
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rule_parts
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path AND nth = 1
"""
