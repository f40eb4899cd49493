"""Splits, value at risk, expected shortfall and coverage tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions.tests import CHI2_90, CHI2_95, pf_lr, tuff_lr
from riskspark.operators import coverage, risk, split
from riskspark.sources.panels import lineitem_returns

from .sql import BASE, PNL

N, HORIZON, BLOCK = 24, 10, 20
ALPHAS = [1.0 - 0.95, 1.0 - 0.975, 1.0 - 0.99]


def r8(c, name=None):
    return F.round(c, 8).alias(name or c)


def rets(spark, sf):
    return lineitem_returns(spark, sf)


def pnl(spark, sf):
    return risk.portfolio(rets(spark, sf)).withColumn("r", F.round("r", 12))


def n_rows(df):
    return df.agg(F.max("t") + 1).first()[0] or 0


def first_four_fifths(df):
    """Whether a row lies in the leading part that models learn from."""
    return F.col("t") < int((1.0 - 0.2) * n_rows(df))


def hashed_split(spark, sf):
    return split.drawn_split(spark, n_rows(rets(spark, sf)), HORIZON, 7, BLOCK)


def split_rows_block(spark, sf):
    return split.split_rows(spark, hashed_split(spark, sf))


def split_rows_chrono(spark, sf):
    s = split.last_part(n_rows(rets(spark, sf)))
    return split.split_rows(spark, s).groupBy("is_test").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def split_rows_period(spark, sf):
    days = rets(spark, sf).select("t", "d").distinct()
    return split.period_split(days, [("1992-01-01", "1996-12-31")], [("1995-01-01", "1995-06-30"), ("1997-01-01", "1998-12-31")])


def date_to_row(spark, sf):
    """First row on or after a date and the row after the last on or before another."""
    days = rets(spark, sf).select("t", "d").distinct()
    return days.agg(F.min(F.when(F.col("d") >= "1995-01-15", F.col("t"))).alias("start"), (F.max(F.when(F.col("d") <= "1996-06-30", F.col("t"))) + 1).alias("stop"))


def purged_window_starts(spark, sf):
    s = hashed_split(spark, sf)
    return split.window_starts(split.split_rows(spark, s), N)


def train_windows(spark, sf):
    r, s = rets(spark, sf), hashed_split(spark, sf)
    return split.windows(r, split.window_starts(split.split_rows(spark, s), N), N)


def sliding_windows(spark, sf):
    return train_windows(spark, sf).select("w", "k", "j", r8("x"))


def test_blocks_h(spark, sf):
    s = hashed_split(spark, sf)
    rows = split.test_blocks(spark, s, HORIZON).join(pnl(spark, sf), "t")
    return rows.groupBy("w").agg(F.min("t").alias("first_t"), F.count("*").alias("n"), r8(F.sum("r"), "r"))


def split_summary(spark, sf):
    s = hashed_split(spark, sf)
    flags = split.split_rows(spark, s)
    starts = split.window_starts(flags, N).agg(F.count("*").alias("windows"))
    return flags.agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test")).join(F.broadcast(starts)).withColumn("blocks", F.lit(len(s.test_starts)).cast("long"))


def train_pnl(spark, sf):
    p = pnl(spark, sf)
    cut = int((1.0 - 0.2) * n_rows(p))
    return p.where(F.col("t") < cut), p.where(F.col("t") >= cut)


def hs_var_pf_backtest(spark, sf):
    train, test = train_pnl(spark, sf)
    var = risk.law_var_es(risk.law(train), [ALPHAS[0]])
    n = risk.exceptions(test, var).groupBy("alpha", "var").agg(F.count("*").alias("n"), F.count_if("exc").alias("x"))
    lr = pf_lr(F.col("x"), F.col("n"), F.col("alpha"))
    return n.select(r8("alpha"), r8("var"), "n", "x", F.round(lr, 6).alias("lr"), (lr > CHI2_95).alias("rejected"))


def law_var_es(spark, sf):
    train, _ = train_pnl(spark, sf)
    return risk.law_var_es(risk.law(train), ALPHAS).select(r8("alpha"), r8("var"), r8("es"), "m")


def var_cvar_empirical(spark, sf):
    return risk.var_cvar(pnl(spark, sf).select((-F.col("r")).alias("loss")), [0.95, 0.99, 0.995]).select("level", r8("var"), r8("cvar"), "n_tail")


def window_var_cvar(spark, sf):
    return risk.var_cvar(risk.window_losses(train_windows(spark, sf), HORIZON).withColumn("loss", F.round("loss", 12)), [0.95, 0.99]).select("level", r8("var"), r8("cvar"), "n_tail")


def marginal_var_cvar(spark, sf):
    losses = rets(spark, sf).select("j", F.round(-F.col("x"), 12).alias("loss"))
    return risk.var_cvar(losses, [0.95, 0.99], by=["j"]).select("j", "level", r8("var"), r8("cvar"), "n_tail")


def weighted_portfolio(spark, sf):
    w = {k: k / 28 for k in range(1, 8)}
    return risk.portfolio(rets(spark, sf), w).select("t", r8("r"))


def backtest_table(spark, sf):
    train, test = train_pnl(spark, sf)
    each = risk.exceptions(test, risk.law_var_es(risk.law(train), ALPHAS))
    n = each.groupBy("alpha").agg(F.count("*").alias("n"), F.count_if("exc").alias("x"), F.min(F.when(F.col("exc"), F.col("t"))).alias("_t"), F.min("t").alias("_s"))
    v = F.col("_t") - F.col("_s") + 1
    return n.select(
        r8("alpha"), "n", "x", r8(F.col("n") * F.col("alpha"), "expected"), F.round(pf_lr(F.col("x"), F.col("n"), F.col("alpha")), 6).alias("pf"), v.alias("first_failure"), F.round(tuff_lr(v, F.col("alpha")), 6).alias("tuff"),
        F.when(v.isNull(), F.round(F.pow(1 - F.col("alpha"), F.col("n")), 8)).alias("p_no_failure"),
    )


PF_CASES = [(n, p) for n in (255, 510, 1000) for p in (0.01, 0.025, 0.05, 0.075, 0.1)]
POWER_CASES = [(n, p, q) for n in (255, 510, 1000) for p, q in ((0.01, 0.02), (0.01, 0.03), (0.025, 0.04), (0.05, 0.075))]
TUFF_CASES = [(p, c) for p in (0.005, 0.01, 0.02, 0.03, 0.05) for c in (CHI2_95, CHI2_90)]
MAX_N_CASES = [(x, p) for x in (1, 2, 5, 10) for p in (0.01, 0.02, 0.03, 0.04, 0.05)]


def pf_table(spark, sf):
    cases = spark.createDataFrame([(x, n, p) for n, p in PF_CASES for x in (0, 5, 10, 20)], "x long, n long, p double")
    return cases.select("x", "n", "p", F.round(pf_lr(F.col("x"), F.col("n"), F.col("p")), 6).alias("lr"))


def pf_region(spark, sf):
    return coverage.pf_region(spark.createDataFrame(PF_CASES, "n long, p double")).select("n", "p", "lo", "hi")


def tuff_region(spark, sf):
    return coverage.tuff_region(spark.createDataFrame(TUFF_CASES, "p double, crit double"))


def pf_power(spark, sf):
    return coverage.pf_power(spark.createDataFrame(POWER_CASES, "n long, p double, q double")).select("n", "p", "q", F.round("power", 6).alias("power"))


def pf_max_n(spark, sf):
    return coverage.pf_max_n(spark.createDataFrame(MAX_N_CASES, "x int, p double"))


def binomial_tails(spark, sf):
    cases = spark.createDataFrame([(255, 0.01), (255, 0.05), (510, 0.025)], "n long, p double")
    pmf = coverage.with_binomial(cases, "n", "p")
    at = spark.createDataFrame([(x,) for x in (0, 3, 7, 15)], "c int")
    each = pmf.join(F.broadcast(at))  # four rows
    return each.groupBy("n", "p", "c").agg(F.round(F.sum(F.when(F.col("x") <= F.col("c"), F.col("pmf")).otherwise(0.0)), 8).alias("cdf"), F.round(F.sum(F.when(F.col("x") >= F.col("c"), F.col("pmf")).otherwise(0.0)), 8).alias("sf"))


def design_table(spark, sf):
    """What the held-out sample can detect: expected failures, region, power against two and three times the rate."""
    _, test = train_pnl(spark, sf)
    n = test.count()
    cases = spark.createDataFrame([(n, round(p, 12), round(k * p, 12)) for p in (0.05, 0.01) for k in (2, 3)], "n long, p double, q double")
    power = coverage.pf_power(cases).join(coverage.pf_region(cases.select("n", "p").distinct()), ["n", "p"])
    return power.select("n", "p", "q", r8(F.col("n") * F.col("p"), "expected"), "lo", "hi", F.round("power", 6).alias("power"))


QUERIES = {f.__name__: f for f in (
    hs_var_pf_backtest, split_rows_block, split_rows_chrono, split_rows_period, date_to_row, purged_window_starts, sliding_windows, test_blocks_h, split_summary, law_var_es,
    var_cvar_empirical, window_var_cvar, marginal_var_cvar, weighted_portfolio, backtest_table, pf_table, pf_region, tuff_region, pf_power, pf_max_n, binomial_tails, design_table,
)}

#: The number of leading rows.
EARLY = "(SELECT CAST(floor((1.0::DOUBLE - 0.2::DOUBLE) * (max(t) + 1)) AS BIGINT) FROM ret)"
SPLIT = f"""size AS (SELECT max(t) + 1 AS n, (max(t) + 1) // {BLOCK} AS cards, CAST(round_even(0.2::DOUBLE * ((max(t) + 1) // {BLOCK}), 0) AS BIGINT) AS wanted FROM ret),
deck AS (SELECT card, card * wanted // cards AS heap, CAST(('0x' || substr(md5('7:' || card), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496 AS u FROM (SELECT *, unnest(range(0, cards)) AS card FROM size)),
blocks AS (SELECT row_number() OVER (ORDER BY s) - 1 AS b, s FROM (SELECT arg_min(card, u) * {BLOCK} AS s FROM deck GROUP BY heap)),
rows_ AS (SELECT t, t IN (SELECT s + i FROM blocks, (SELECT unnest(range(0, {BLOCK})) AS i)) AS is_test FROM (SELECT unnest(range(0, n)) AS t FROM size))"""
STARTS = f"starts AS (SELECT t FROM (SELECT t, sum(CASE WHEN is_test THEN 0 ELSE 1 END) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING) AS free FROM rows_) WHERE free = {N})"
WINDOWS = f"wins AS (SELECT s.t AS w, ret.t - s.t AS k, j, x FROM starts s JOIN ret ON ret.t BETWEEN s.t AND s.t + {N - 1})"
CUT = "cut AS (SELECT CAST(floor((1.0::DOUBLE - 0.2::DOUBLE) * (max(t) + 1)) AS BIGINT) AS c FROM pnl), train AS (SELECT * FROM pnl WHERE t < (SELECT c FROM cut)), test AS (SELECT * FROM pnl WHERE t >= (SELECT c FROM cut))"
LEVELS = "alphas AS (SELECT unnest([1.0::DOUBLE - 0.95::DOUBLE, 1.0::DOUBLE - 0.975::DOUBLE, 1.0::DOUBLE - 0.99::DOUBLE]) AS alpha)"
LAW = "law AS (SELECT row_number() OVER (ORDER BY r) AS i, r AS x, count(*) OVER () AS m FROM train)"
VARES = "vares AS (SELECT alpha, -max(CASE WHEN i = ceil(alpha * m) THEN x END) AS var, -sum(CASE WHEN i <= floor(alpha * m) THEN x / m WHEN i = floor(alpha * m) + 1 THEN (alpha - floor(alpha * m) / m) * x ELSE 0 END) / alpha AS es, max(m) AS m FROM law, alphas GROUP BY alpha)"


def xlogy_sql(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE {x} * ln(greatest({y}, 1e-300::DOUBLE)) END)"


def pf_sql(x: str, n: str, p: str) -> str:
    return f"(-2.0::DOUBLE * (({xlogy_sql(f'({n} - {x})', f'(1.0::DOUBLE - {p})')} + {xlogy_sql(x, p)}) - ({xlogy_sql(f'({n} - {x})', f'(1.0::DOUBLE - {x} / {n})')} + {xlogy_sql(x, f'({x} / {n})')})))"


def tuff_sql(v: str, p: str) -> str:
    return f"(-2.0::DOUBLE * (ln({p}) + ({v} - 1) * ln(1.0::DOUBLE - {p}) - (-ln({v}) + CASE WHEN {v} = 1 THEN 0 ELSE ({v} - 1) * ln(greatest(1.0::DOUBLE - 1.0::DOUBLE / {v}, 1e-300::DOUBLE)) END)))"


def values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + f") v({names})"


VC = "cuts AS (SELECT {by} unnest([{lv}]) AS level, unnest(quantile_cont(loss, [{lv}])) AS var FROM losses {gb}) SELECT {by} level, round(var, 8) AS var, round(avg(loss), 8) AS cvar, count(*) AS n_tail FROM losses JOIN cuts {on} WHERE loss >= var GROUP BY ALL"
PMF = "xs AS (SELECT c.*, unnest(range(0, CAST(n AS BIGINT) + 1)) AS x FROM cases c), pmf AS (SELECT *, exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln({p}) + (n - x) * ln(1 - {p})) AS pmf FROM xs)"
REGION = f"region AS (SELECT n, p, min(x) AS lo, max(x) AS hi FROM (SELECT DISTINCT n, p, x FROM xs) WHERE {pf_sql('x', 'n', 'p')} <= {CHI2_95}::DOUBLE GROUP BY n, p)"

SQL = {
    "hs_var_pf_backtest": f"{PNL}, {CUT}, alphas AS (SELECT 1.0::DOUBLE - 0.95::DOUBLE AS alpha), {LAW}, {VARES}, n AS (SELECT alpha, var, count(*) AS n, count_if(r + var < 0) AS x FROM test, vares GROUP BY alpha, var) SELECT round(alpha, 8) AS alpha, round(var, 8) AS var, n, x, round({pf_sql('x', 'n', 'alpha')}, 6) AS lr, {pf_sql('x', 'n', 'alpha')} > {CHI2_95}::DOUBLE AS rejected FROM n",
    "split_rows_block": f"{BASE}, {SPLIT} SELECT t, is_test FROM rows_",
    "split_rows_chrono": f"{PNL}, {CUT} SELECT t >= c AS is_test, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM pnl, cut GROUP BY 1",
    "split_rows_period": f"{BASE} SELECT t, d, is_test, d BETWEEN DATE '1992-01-01' AND DATE '1996-12-31' AND NOT is_test AS is_train FROM (SELECT DISTINCT t, d, d BETWEEN DATE '1995-01-01' AND DATE '1995-06-30' OR d BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AS is_test FROM ret)",
    "date_to_row": f"{BASE} SELECT min(t) FILTER (d >= DATE '1995-01-15') AS start, max(t) FILTER (d <= DATE '1996-06-30') + 1 AS stop FROM ret",
    "purged_window_starts": f"{BASE}, {SPLIT}, {STARTS} SELECT t FROM starts",
    "sliding_windows": f"{BASE}, {SPLIT}, {STARTS}, {WINDOWS} SELECT w, CAST(k AS INT) AS k, j, round(x, 8) AS x FROM wins",
    "test_blocks_h": f"{PNL}, {SPLIT} SELECT b * {BLOCK // HORIZON} + (t - s) // {HORIZON} AS w, min(t) AS first_t, count(*) AS n, round(sum(r), 8) AS r FROM blocks JOIN pnl ON t BETWEEN s AND s + {BLOCK - 1} GROUP BY 1",
    "split_summary": f"{BASE}, {SPLIT}, {STARTS} SELECT count(*) AS n, count_if(is_test) AS n_test, (SELECT count(*) FROM starts) AS windows, (SELECT count(*) FROM blocks) AS blocks FROM rows_",
    "law_var_es": f"{PNL}, {CUT}, {LEVELS}, {LAW}, {VARES} SELECT round(alpha, 8) AS alpha, round(var, 8) AS var, round(es, 8) AS es, m FROM vares",
    "var_cvar_empirical": f"{PNL}, losses AS (SELECT -r AS loss FROM pnl), " + VC.format(by="", gb="", lv="0.95::DOUBLE, 0.99::DOUBLE, 0.995::DOUBLE", on="ON true"),
    "window_var_cvar": f"{BASE}, {SPLIT}, {STARTS}, {WINDOWS}, losses AS (SELECT w, round(-sum(x) / count(DISTINCT j), 12) AS loss FROM wins WHERE k < {HORIZON} GROUP BY w), " + VC.format(by="", gb="", lv="0.95::DOUBLE, 0.99::DOUBLE", on="ON true"),
    "marginal_var_cvar": f"{BASE}, losses AS (SELECT j, round(-x, 12) AS loss FROM ret), " + VC.format(by="j,", gb="GROUP BY j", lv="0.95::DOUBLE, 0.99::DOUBLE", on="USING (j)"),
    "weighted_portfolio": f"{BASE} SELECT t, round(sum(x * (j / 28::DOUBLE)), 8) AS r FROM ret GROUP BY t",
    "backtest_table": f"{PNL}, {CUT}, {LEVELS}, {LAW}, {VARES}, n AS (SELECT alpha, count(*) AS n, count_if(r + var < 0) AS x, min(t) FILTER (r + var < 0) - min(t) + 1 AS v FROM test, vares GROUP BY alpha) SELECT round(alpha, 8) AS alpha, n, x, round(n * alpha, 8) AS expected, round({pf_sql('x', 'n', 'alpha')}, 6) AS pf, v AS first_failure, round({tuff_sql('v', 'alpha')}, 6) AS tuff, CASE WHEN v IS NULL THEN round((1 - alpha) ** n, 8) END AS p_no_failure FROM n",
    "pf_table": f"SELECT x, n, p, round({pf_sql('x', 'n', 'p')}, 6) AS lr FROM {values([(x, n, p) for n, p in PF_CASES for x in (0, 5, 10, 20)], 'x, n, p')}",
    "pf_region": f"WITH cases AS (SELECT * FROM {values(PF_CASES, 'n, p')}), {PMF.format(p='p')}, {REGION} SELECT n, p, lo, hi FROM region",
    "tuff_region": f"WITH v AS (SELECT c.*, unnest(range(1, 2001)) AS v FROM {values(TUFF_CASES, 'p, crit').replace(' v(', ' c(')}) SELECT p, crit, min(v) AS lo, max(v) AS hi FROM v WHERE {tuff_sql('v', 'p')} <= crit GROUP BY p, crit",
    "pf_power": f"WITH cases AS (SELECT * FROM {values(POWER_CASES, 'n, p, q')}), {PMF.format(p='q')}, {REGION} SELECT n, p, q, round(1 - sum(CASE WHEN x BETWEEN lo AND hi THEN pmf ELSE 0 END), 6) AS power FROM pmf JOIN region USING (n, p) GROUP BY n, p, q",
    "pf_max_n": f"WITH each AS (SELECT c.x, c.p, unnest(range(c.x, 2001)) AS n FROM {values(MAX_N_CASES, 'x, p').replace(' v(', ' c(')}) SELECT x, p, max(n) AS n FROM each WHERE {pf_sql('x', 'n', 'p')} > {CHI2_95}::DOUBLE AND x / n > p GROUP BY x, p",
    "binomial_tails": f"WITH cases AS (SELECT * FROM {values([(255, 0.01), (255, 0.05), (510, 0.025)], 'n, p')}), {PMF.format(p='p')} SELECT n, p, c, round(sum(pmf) FILTER (x <= c), 8) AS cdf, round(sum(pmf) FILTER (x >= c), 8) AS sf FROM pmf, (SELECT unnest([0, 3, 7, 15]) AS c) GROUP BY n, p, c",
    "design_table": f"{PNL}, {CUT}, cases AS (SELECT (SELECT count(*) FROM test) AS n, p, q FROM {values([(round(p, 12), round(k * p, 12)) for p in (0.05, 0.01) for k in (2, 3)], 'p, q')}), {PMF.format(p='q')}, {REGION} SELECT n, p, q, round(n * p, 8) AS expected, lo, hi, round(1 - sum(CASE WHEN x BETWEEN lo AND hi THEN pmf ELSE 0 END), 6) AS power FROM pmf JOIN region USING (n, p) GROUP BY n, p, q, lo, hi",
}
