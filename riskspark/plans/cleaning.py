"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions import parse
from riskspark.operators import clean
from riskspark.sources.panels import lineitem_panel, lineitem_returns, nation_panel, quotes, table

from .sql import BASE, DENSE, FILLED, P1, P2


def r8(c: str):
    return F.round(c, 8).alias(c)


def quote_select_best(spark, sf):
    return clean.best_quotes(quotes(spark, sf))


def quote_stream(spark, sf):
    q = quotes(spark, sf)
    best = clean.best_quotes(q).drop("n_obs")
    last = clean.keep_last(q.join(best, ["valor", "price_type", "currency"]), ["valor", "d"], "ordinal")
    return last.select("valor", "d", "price", "ordinal")


def quote_multiplicity(spark, sf):
    per = quotes(spark, sf).groupBy("valor").agg(F.countDistinct("price_type").alias("types"), F.countDistinct("currency").alias("currencies"))
    return per.agg(F.count("*").alias("valors"), F.count_if(F.col("types") > 1).alias("several_types"), F.count_if(F.col("currencies") > 1).alias("several_currencies"))


def quote_summary(spark, sf):
    return quotes(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("valor").alias("valors"), F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.array_join(F.sort_array(F.collect_set("price_type")), ",").alias("types"))


def currency_mix(spark, sf):
    return quotes(spark, sf).groupBy("currency").agg(F.count("*").alias("n"))


def quote_filters(spark, sf):
    q = quotes(spark, sf)
    kept = q.na.drop(subset=["valor", "d", "price"]).where(F.col("d").between("1996-01-01", "1997-12-31")).where(F.col("price_type").isin("A", "N")).where("currency = 'F'")
    return kept.groupBy("valor", "price_type").agg(F.count("*").alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d"))


def weekday_filter(spark, sf):
    p = lineitem_panel(spark, sf)
    return p.where(F.weekday("d") < 5).select("valor", "d", r8("value"))


def median_gap_filter(spark, sf):
    return clean.median_gap(nation_panel(spark, sf)).withColumn("kept", F.col("gap") <= 2)


def keep_valors(spark, sf):
    p = lineitem_panel(spark, sf)
    listed = spark.createDataFrame([(1,), (3,), (5,)], "valor int")
    kept = p.join(F.broadcast(listed), "valor", "left_semi").withColumn("side", F.lit("kept"))  # the list is given by hand
    dropped = p.join(F.broadcast(listed), "valor", "left_anti").withColumn("side", F.lit("dropped"))
    return kept.unionByName(dropped).groupBy("side", "valor").agg(F.count("*").alias("n"))


def nonpos_fraction(spark, sf):
    p = lineitem_panel(spark, sf).withColumn("value", F.when(F.col("value") < 20000, -F.col("value")).otherwise(F.col("value")))
    return clean.nonpositive_share(p).select("valor", "n", r8("share"), (F.col("share") > 0.01).alias("dropped"))


def coverage_filter(spark, sf):
    return clean.coverage(clean.dense(lineitem_panel(spark, sf))).select("valor", r8("coverage"), (F.col("coverage") >= 0.965).alias("kept"))


def ffill_limit(spark, sf):
    return clean.forward_fill(clean.dense(lineitem_panel(spark, sf)), 2).select("valor", "d", r8("value"))


def date_completeness(spark, sf):
    per = clean.dense(lineitem_panel(spark, sf)).groupBy("d").agg(F.count("value").alias("present"))
    return per.groupBy("present").agg(F.count("*").alias("days"))


def log_returns(spark, sf):
    return lineitem_returns(spark, sf).select("t", "d", "j", r8("x"))


def zero_fraction(spark, sf):
    rets = lineitem_returns(spark, sf)
    flat = rets.withColumn("x", F.when(F.abs("x") < 0.05, 0.0).otherwise(F.col("x")))
    return clean.zero_share(flat).select("j", r8("share"), (F.col("share") > 0.05).alias("dropped"))


def evt_feasibility(spark, sf):
    return clean.tail_counts(lineitem_returns(spark, sf)).withColumn("kept", F.least("n_lo", "n_hi") >= 30)


def panel_pivot(spark, sf):
    return clean.wide(lineitem_panel(spark, sf).withColumn("value", F.round("value", 8)), "d", "value")


NUMBERS = ["1'234.56", "1 234,56", "1.234,56", "1,234.56", "1,234", "1,234,567", "abc", "", "-5", " 42 ", "1 000,5", "3.5e2"]


def number_parse(spark, sf):
    given = spark.createDataFrame(list(enumerate(NUMBERS)), "k long, raw string")
    prices = table(spark, sf, "part").select((F.col("p_partkey") + 1000).alias("k"), F.replace(F.format_string("%.2f", "p_retailprice"), F.lit("."), F.lit(",")).alias("raw"))
    return given.unionByName(prices).select("k", parse.to_number(F.col("raw")).alias("value"))


def date_format_infer(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("raw"))
    raw = raw.withColumn("raw", F.when(F.col("o_orderkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("raw")))
    return parse.with_dates(raw, "raw").select("o_orderkey", F.col("raw").alias("d"))


def panel_checks(spark, sf):
    """Rules of the validator over the return panel: rule, severity, value, passed."""
    rets = lineitem_returns(spark, sf)
    one = rets.agg(F.countDistinct("t").alias("rows"), F.countDistinct("j").alias("features"), F.count_if(F.isnan("x") | F.col("x").isNull()).alias("bad"), F.avg(F.abs("x")).alias("size"), F.max(F.abs("x")).alias("largest"))
    rule = lambda name, severity, value, passed: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), value.cast("double").alias("value"), passed.alias("passed"))
    rules = F.array(
        rule("rows", "fail", F.col("rows"), F.col("rows") >= 250), rule("features", "warn", F.col("features"), F.col("features") >= 2), rule("finite", "fail", F.col("bad"), F.col("bad") == 0),
        rule("mean size", "fail", F.round("size", 8), F.col("size") <= 1), rule("largest", "warn", F.round("largest", 8), F.col("largest") <= 1),
    )
    return one.select(F.inline(rules))


_quotes = "quotes AS (SELECT l_linenumber AS valor, l_returnflag AS price_type, l_linestatus AS currency, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS price, l_orderkey AS ordinal FROM lineitem)"
_best = "best AS (SELECT valor, price_type, currency, n_obs FROM (SELECT valor, price_type, currency, count(*) AS n_obs, row_number() OVER (PARTITION BY valor ORDER BY count(*) DESC, price_type, currency) AS k FROM quotes GROUP BY ALL) WHERE k = 1)".replace("GROUP BY ALL", "GROUP BY valor, price_type, currency")
_to_number = "try_cast(replace(CASE WHEN contains(b, ',') AND NOT regexp_matches(b, ',[0-9]*\\.') THEN replace(replace(b, '.', ''), ',', '.') ELSE b END, ',', '') AS DOUBLE)"
_numbers = ", ".join("({}, '{}')".format(k, s.replace("'", "''")) for k, s in enumerate(NUMBERS))

QUERIES = {f.__name__: f for f in (
    quote_select_best, quote_stream, quote_multiplicity, quote_summary, currency_mix, quote_filters, weekday_filter, median_gap_filter, keep_valors, nonpos_fraction,
    coverage_filter, ffill_limit, date_completeness, log_returns, zero_fraction, evt_feasibility, panel_pivot, number_parse, date_format_infer, panel_checks,
)}

SQL = {
    "quote_select_best": f"WITH {_quotes}, {_best} SELECT * FROM best",
    "quote_stream": f"WITH {_quotes}, {_best} SELECT valor, d, price, ordinal FROM (SELECT q.*, row_number() OVER (PARTITION BY valor, d ORDER BY ordinal DESC) AS k FROM quotes q JOIN best USING (valor, price_type, currency)) WHERE k = 1",
    "quote_multiplicity": f"WITH {_quotes} SELECT count(*) AS valors, count_if(t > 1) AS several_types, count_if(c > 1) AS several_currencies FROM (SELECT count(DISTINCT price_type) AS t, count(DISTINCT currency) AS c FROM quotes GROUP BY valor)",
    "quote_summary": f"WITH {_quotes} SELECT count(*) AS n, count(DISTINCT valor) AS valors, min(d) AS first_d, max(d) AS last_d, string_agg(DISTINCT price_type, ',' ORDER BY price_type) AS types FROM quotes",
    "currency_mix": f"WITH {_quotes} SELECT currency, count(*) AS n FROM quotes GROUP BY 1",
    "quote_filters": f"WITH {_quotes} SELECT valor, price_type, count(*) AS n, min(d) AS first_d, max(d) AS last_d FROM quotes WHERE valor IS NOT NULL AND price IS NOT NULL AND d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND price_type IN ('A', 'N') AND currency = 'F' GROUP BY 1, 2",
    "weekday_filter": f"WITH {P1} SELECT valor, d, round(value, 8) AS value FROM p1 WHERE isodow(d) < 6",
    "median_gap_filter": f"WITH {P2} SELECT valor, gap, gap <= 2 AS kept FROM (SELECT valor, coalesce(median(g), 'inf'::DOUBLE) AS gap FROM (SELECT valor, d - lag(d) OVER (PARTITION BY valor ORDER BY d) AS g FROM (SELECT DISTINCT valor, d FROM p2)) GROUP BY valor)",
    "keep_valors": f"WITH {P1} SELECT CASE WHEN valor IN (1, 3, 5) THEN 'kept' ELSE 'dropped' END AS side, valor, count(*) AS n FROM p1 GROUP BY 1, 2",
    "nonpos_fraction": f"WITH {P1} SELECT valor, n, round(share, 8) AS share, share > 0.01 AS dropped FROM (SELECT valor, count(value) AS n, count_if(value < 20000) / count(value) AS share FROM p1 GROUP BY 1)",
    "coverage_filter": f"WITH {P1}, {DENSE} SELECT valor, round(c, 8) AS coverage, c >= 0.965 AS kept FROM (SELECT valor, count(value) / count(*) AS c FROM dense GROUP BY 1)",
    "ffill_limit": f"WITH {P1}, {DENSE}, {FILLED} SELECT valor, d, round(value, 8) AS value FROM filled",
    "date_completeness": f"WITH {P1} SELECT present, count(*) AS days FROM (SELECT d, count(value) AS present FROM p1 GROUP BY d) GROUP BY 1",
    "log_returns": f"{BASE} SELECT t, d, j, round(x, 8) AS x FROM ret",
    "zero_fraction": f"{BASE} SELECT j, round(share, 8) AS share, share > 0.05 AS dropped FROM (SELECT j, avg(CASE WHEN abs(x) < 0.05 THEN 1 ELSE 0 END) AS share FROM ret GROUP BY j)",
    "evt_feasibility": f"{BASE}, lead AS (SELECT * FROM ret WHERE t < floor((1 - 0.2::DOUBLE) * (SELECT max(t) + 1 FROM ret))), cuts AS (SELECT j, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM lead GROUP BY j) SELECT j, n_lo, n_hi, least(n_lo, n_hi) >= 30 AS kept FROM (SELECT j, count_if(x < lo) AS n_lo, count_if(x > hi) AS n_hi FROM lead JOIN cuts USING (j) GROUP BY j)",
    "panel_pivot": f"WITH {P1} SELECT d, " + ", ".join(f"round(max(value) FILTER (valor = {k}), 8) AS v{k}" for k in range(1, 8)) + " FROM p1 GROUP BY d",
    "number_parse": f"WITH raws AS (SELECT * FROM (VALUES {_numbers}) v(k, raw) UNION ALL SELECT p_partkey + 1000, replace(printf('%.2f', p_retailprice), '.', ',') FROM part), bare AS (SELECT k, regexp_replace(trim(raw), '[''  ]', '', 'g') AS b FROM raws) SELECT CAST(k AS BIGINT) AS k, {_to_number} AS value FROM bare",
    "date_format_infer": "SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders",
    "panel_checks": f"{BASE}, one AS (SELECT count(DISTINCT t) AS n, count(DISTINCT j) AS f, count_if(isnan(x) OR x IS NULL) AS bad, avg(abs(x)) AS size, max(abs(x)) AS largest FROM ret) SELECT 'rows' AS rule, 'fail' AS severity, n::DOUBLE AS value, n >= 250 AS passed FROM one UNION ALL SELECT 'features', 'warn', f::DOUBLE, f >= 2 FROM one UNION ALL SELECT 'finite', 'fail', bad::DOUBLE, bad = 0 FROM one UNION ALL SELECT 'mean size', 'fail', round(size, 8), size <= 1 FROM one UNION ALL SELECT 'largest', 'warn', round(largest, 8), largest <= 1 FROM one",
}
