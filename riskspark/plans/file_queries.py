"""Queries that write files and read them back: extracts, panels, matrices, lists, splits, windows and artefacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.operators import clean, split, tails, vol
from riskspark.sources import sinks, text
from riskspark.sources.panels import lineitem_panel, quotes
from riskspark.sources.shared import new_folder

from . import cleaning, report_queries, risk_queries, tail_queries, vol_queries
from .risk_queries import BLOCK, N, SPLIT, STARTS, WINDOWS, hashed_split, rets, train_windows
from .sql import BASE, P1

HEADS = ["VALOR;FI_ID;PRICE", "VALOR\tFI_ID\tPRICE", "VALOR|FI_ID|PRICE", "VALOR,FI_ID,PRICE", "A;B,C;D,E", "one column"]
KEPT = ["# instruments to keep", "1", "  3  # the third", "", "5"]


def separator_sniff(spark, sf):
    found = []
    for k, head in enumerate(HEADS):
        path = new_folder(spark, "head")
        spark.createDataFrame([(head,)], "value string").write.text(path)
        found.append((k, text.sniff_separator(spark, path)))
    return spark.createDataFrame(found, "k int, separator string")


def quote_extract(spark, sf):
    """All quotes as a text extract with an untidy header, day-first dates and grouped numbers with a decimal comma; scanned and typed."""
    price = F.translate(F.format_number("price", 2), ",.", "',")
    lines = quotes(spark, sf).select("valor", F.col("ordinal"), F.lower("price_type"), F.date_format("d", "dd.MM.yyyy"), price, F.concat(F.lit(" "), F.lower("currency")))
    path = new_folder(spark, "extract")
    lines.toDF("Valor", "fi_id", " Price_Type", "Price_Date 1", "PRICE", "Currency").write.csv(path, sep=";", header=True)
    return text.typed_quotes(text.scan_quotes(spark, path))


def selection_audit(spark, sf):
    path = new_folder(spark, "selection")
    sinks.write_selection(clean.best_quotes(quotes(spark, sf)), path)
    return spark.read.csv(path, header=True, schema="valor int, price_type string, currency string, n_obs long")


def wide_prices(spark, sf):
    path = new_folder(spark, "prices")
    sinks.write_wide(lineitem_panel(spark, sf), path)
    return text.dated_panel(spark, path)


def wide_dates(spark, sf):
    path = new_folder(spark, "prices")
    sinks.write_wide(lineitem_panel(spark, sf), path)
    return text.panel_dates(spark, path)


def written_returns(spark, sf):
    path = new_folder(spark, "returns")
    sinks.write_wide(rets(spark, sf).select(F.col("j").alias("valor"), "d", F.col("x").alias("value")), path, sinks.RETURN_FORM)
    return path


def matrix_scan(spark, sf):
    """Returns written with dates and a header, read as a bare matrix with a name for each column."""
    cells, names = text.numeric_matrix(spark, written_returns(spark, sf))
    return text.require_finite(cells).select("t", "j", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("j") + 1).alias("name"), "x")


def matrix_log_returns(spark, sf):
    """Full rows of prices written as a matrix and turned into returns on load."""
    path = new_folder(spark, "full-prices")
    sinks.write_wide(clean.complete_rows(clean.forward_fill(clean.dense(lineitem_panel(spark, sf)), 2)), path)
    cells, _ = text.numeric_matrix(spark, path)
    return text.matrix_returns(cells).select("t", "j", F.round("x", 6).alias("x"))


def listed_valors(spark, sf):
    path = new_folder(spark, "list")
    spark.createDataFrame([(line,) for line in KEPT], "value string").write.text(path)
    panel = lineitem_panel(spark, sf)
    listed = text.listed_names(spark, path).select(F.col("valor").cast("int").alias("valor"), F.lit(True).alias("_in"))
    side = F.when(F.col("_in"), "kept").otherwise("dropped").alias("side")
    return panel.join(listed, "valor", "left").groupBy(side, "valor").agg(F.count("*").alias("n"))


def split_store(spark, sf):
    """A split written as JSON, read and held against the data again."""
    made, path = hashed_split(spark, sf), new_folder(spark, "split")
    sinks.write_split(spark, made, path)
    again = sinks.read_split(spark, path)
    again.guard(risk_queries.n_rows(rets(spark, sf)), split_id=made.id)
    return split.blocks_table(spark, again).select("b", "s", F.lit(again.rows).cast("long").alias("n"), F.lit(again.block).alias("block"))


def train_all_starts(spark, sf):
    """With nothing held out each window is a training window."""
    whole = split.train_all(risk_queries.n_rows(rets(spark, sf)), risk_queries.HORIZON)
    return split.window_starts(split.split_rows(spark, whole), N)


def panel_fingerprint(spark, sf):
    """Depends on the rows alone; digests of rows have no counterpart in the other engine's SQL."""
    return spark.createDataFrame([(text.fingerprint(lineitem_panel(spark, sf)),)], "fingerprint string")


def window_store(spark, sf):
    path = new_folder(spark, "windows")
    sinks.write_windows(train_windows(spark, sf).withColumn("label", F.lit("train")), path)
    return spark.read.parquet(path).select("label", "w", "k", "j", F.round("x", 8).alias("x"))


def labelled_sources(spark, sf):
    """Two tables of windows, one named by its spec and one by its path."""
    windows, base = train_windows(spark, sf), new_folder(spark, "generated")
    windows.where(F.col("w") % 2 == 0).write.parquet(f"{base}/gen_even")
    windows.where(F.col("w") % 2 == 1).write.parquet(f"{base}/rest")
    both = text.labelled_windows(spark, [f"{base}/gen_even", f"odd={base}/rest"])
    return both.groupBy("label", "w").agg(F.count("*").alias("cells"), F.round(F.sum("x"), 6).alias("total"))


def marginal_store(spark, sf):
    """Marginals written whole and read back: the distribution function of every row follows from the stored tables alone."""
    path = new_folder(spark, "marginals")
    r = rets(spark, sf).withColumn("x", F.round("x", 10))
    sinks.write_marginals(*tails.marginal_tables(r, tail_queries.fits(spark, sf)), path)
    return tails.cdf_of(r, *sinks.read_marginals(spark, path)).select("t", "j", F.round("u", 5).alias("u"))


def regime_store(spark, sf):
    """Ranks of volatility and the sorted volatilities that they refer to, written and read back; a rank is the share of those not above."""
    path = new_folder(spark, "regime")
    f = vol_queries.filtered(spark, sf).withColumn("sigma", F.round("sigma", 10))
    lead = risk_queries.first_four_fifths(f)
    order = Window.partitionBy("j").orderBy("sigma", "t")
    sinks.write_regime(vol.percentile_rank(f, "sigma", lead, ["j"]).select("j", "t", "u"), f.where(lead).select("j", F.row_number().over(order).cast("long").alias("i"), "sigma"), path)
    u, reference = spark.read.parquet(f"{path}/u"), spark.read.parquet(f"{path}/reference")
    return u.select(F.lit("u").alias("part"), "j", F.col("t").alias("i"), F.round("u", 8).alias("value")).unionByName(reference.select(F.lit("reference").alias("part"), "j", "i", F.col("sigma").alias("value")))


def report_store(spark, sf):
    """The report on marginals as text, read back."""
    path = new_folder(spark, "report")
    report = report_queries.pit_report(spark, sf)
    sinks.write_report(report, path)
    return spark.read.csv(path, header=True, schema=report.schema)


QUERIES = {f.__name__: f for f in (
    separator_sniff, quote_extract, selection_audit, wide_prices, wide_dates, matrix_scan, matrix_log_returns, listed_valors, split_store, train_all_starts, panel_fingerprint, window_store, labelled_sources, marginal_store, regime_store, report_store,
)}

_long = "SELECT CAST(valor AS VARCHAR) AS valor, d, CAST(printf('%.8f', value) AS DOUBLE) AS value FROM dense"

SQL = {
    "separator_sniff": "SELECT k, separator FROM (VALUES (0, ';'), (1, '\t'), (2, '|'), (3, ','), (4, ';'), (5, ';')) v(k, separator)",
    "quote_extract": "SELECT CAST(l_linenumber AS VARCHAR) AS valor, CAST(l_orderkey AS VARCHAR) AS fi_id, l_returnflag AS price_type, l_linestatus AS currency, CAST(l_shipdate AS DATE) AS d, round(l_extendedprice, 2) AS price FROM lineitem",
    "selection_audit": cleaning.SQL["quote_select_best"],
    "wide_prices": f"WITH {P1}, {cleaning.DENSE} {_long}",
    "wide_dates": f"WITH {P1} SELECT DISTINCT d FROM p1",
    "matrix_scan": f"{BASE} SELECT t, CAST(dense_rank() OVER (ORDER BY j) - 1 AS INT) AS j, CAST(j AS VARCHAR) AS name, CAST(printf('%.8e', x) AS DOUBLE) AS x FROM ret",
    "matrix_log_returns": f"{BASE} SELECT t, CAST(dense_rank() OVER (ORDER BY j) - 1 AS INT) AS j, round(x, 6) AS x FROM ret",
    "listed_valors": cleaning.SQL["keep_valors"],
    "split_store": f"{BASE}, {SPLIT} SELECT b, s, (SELECT n FROM size) AS n, {BLOCK} AS block FROM blocks",
    "train_all_starts": f"{BASE} SELECT DISTINCT t FROM ret WHERE t <= (SELECT max(t) FROM ret) - {N - 1}",
    "window_store": f"{BASE}, {SPLIT}, {STARTS}, {WINDOWS} SELECT 'train' AS label, w, CAST(k AS INT) AS k, j, round(x, 8) AS x FROM wins",
    "labelled_sources": f"{BASE}, {SPLIT}, {STARTS}, {WINDOWS} SELECT CASE WHEN w % 2 = 0 THEN 'even' ELSE 'odd' END AS label, w, count(*) AS cells, round(sum(x), 6) AS total FROM wins GROUP BY 1, 2",
    "marginal_store": tail_queries.SQL["marginal_cdf"],
    "regime_store": f"{BASE}, {vol_queries.EWMA}, {vol_queries.U} SELECT 'u' AS part, j, t AS i, round(u, 8) AS value FROM up UNION ALL SELECT 'reference', j, row_number() OVER (PARTITION BY j ORDER BY s, t), s FROM (SELECT t, j, round(sigma, 10) AS s FROM filt WHERE t < {vol_queries.C5})",
    "report_store": report_queries.SQL["pit_report"],
}
