"""Diagnostics of dependence, fit, density and novelty, and strategies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.operators import dependence, risk, strategies
from riskspark.session import ship
from riskspark.sources.panels import table

from .risk_queries import EARLY, SPLIT, STARTS, WINDOWS, first_four_fifths, pnl, r8, rets, train_windows
from .sql import BASE, PNL


#: Where tail dependence is shown.
Q_GRID = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2)


def r6(c, name=None):
    return F.round(c, 6).alias(name or c)


def rounded(spark, sf):
    return rets(spark, sf).withColumn("x", F.round("x", 10))


def pseudo_obs(spark, sf):
    return dependence.pseudo_obs(rounded(spark, sf)).select("t", "j", r8("u"))


def tail_dep_matrix(spark, sf):
    u = dependence.pseudo_obs(rounded(spark, sf))
    low = dependence.tail_dependence(u, 0.05)
    return low.join(dependence.tail_dependence(u, 0.05, upper=True).withColumnRenamed("lam", "upper"), ["i", "j"]).select("i", "j", r8("lam", "lower"), r8("upper"))


def tail_dep_curve_top(spark, sf):
    """Screened at one q, curves only for the pairs that differ most between the two halves."""
    r = rounded(spark, sf)
    early = first_four_fifths(r)
    u, v = dependence.pseudo_obs(r.where(early)), dependence.pseudo_obs(r.where(~early))
    first, last = dependence.tail_dependence(u, 0.1), dependence.tail_dependence(v, 0.1).withColumnRenamed("lam", "other")
    top = first.join(last, ["i", "j"]).withColumn("gap", F.round(F.abs(F.col("lam") - F.col("other")), 10)).orderBy(F.desc("gap"), "i", "j").limit(5).select("i", "j")
    curves = None
    for q in Q_GRID:
        part = dependence.tail_dependence(u, q).join(F.broadcast(top), ["i", "j"], "left_semi").withColumn("q", F.lit(q))  # five rows
        curves = part if curves is None else curves.unionByName(part)
    return curves.select("i", "j", "q", r8("lam"))


def spearman_pairs(spark, sf):
    return dependence.pairs_on_rows(dependence.pseudo_obs(rounded(spark, sf)), "u").groupBy("i", "j").agg(r6(F.corr("a", "b"), "rho"))


def dependence_summary(spark, sf):
    c = dependence.pairs_on_rows(rets(spark, sf), "x").groupBy("i", "j").agg(F.corr("a", "b").alias("c"))
    return c.agg(F.count("*").alias("pairs"), r6(F.avg("c"), "mean"), r6(F.percentile("c", F.lit(0.95)), "q95"), r6(F.max("c"), "largest"), F.count_if(F.abs("c") > 0.02).alias("n_over"))


def covariance_sums(spark, sf):
    return dependence.gram(rets(spark, sf)).select("i", "j", r6("g"))


def eigen_spectrum(spark, sf):
    """Of the features' covariance and correlation matrices; an eigenvalue problem has no SQL."""
    ship(spark)
    return dependence.spectrum(rets(spark, sf))


def eigen_rank(spark, sf):
    """Effective ranks of both matrices."""
    return dependence.effective_rank(eigen_spectrum(spark, sf))


def normal_ranks(spark, sf):
    """Later rows ranked in the earlier rows of their feature."""
    r = rounded(spark, sf)
    early = first_four_fifths(r)
    w = Window.partitionBy("j").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    n = F.sum(early.cast("int")).over(Window.partitionBy("j"))
    return r.withColumn("u", F.sum(early.cast("int")).over(w) / n).where(~early).select("t", "j", "u")


def ad_stat(spark, sf):
    return dependence.anderson_darling(normal_ranks(spark, sf)).select("j", F.round("ad", 4).alias("ad"))


def ks_uniform(spark, sf):
    return dependence.ks_uniform(normal_ranks(spark, sf)).select("j", "n", r6("ks"))


def samples(spark, sf):
    r = rounded(spark, sf)
    return r.select("j", "x", (~first_four_fifths(r)).cast("int").alias("s"))


def ks_2samp(spark, sf):
    return dependence.two_samples(samples(spark, sf), "j").select("j", r8("ks"))


def wasserstein1(spark, sf):
    return dependence.two_samples(samples(spark, sf), "j").select("j", r6("w1"))


def sq_acf(spark, sf):
    return dependence.window_acf(train_windows(spark, sf), 5).select("j", "lag", r6("acf"))


def window_rms(spark, sf):
    per = train_windows(spark, sf).groupBy("w", "j").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    return per.groupBy("j").agg(r6(F.stddev_pop("rms"), "sd"), r6(F.avg("rms"), "mean"))


def kurtosis_table(spark, sf):
    return rets(spark, sf).groupBy("j").agg(r6(F.kurtosis("x") + 3, "kurtosis"), r6(F.stddev_pop("x"), "sd"), r8(F.percentile("x", F.lit(0.01)), "q01"), r8(F.percentile("x", F.lit(0.05)), "q05"))


def histogram(spark, sf):
    p = pnl(spark, sf)
    ends = p.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    b = F.least(F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 80), F.lit(79))
    return p.join(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # one row


def kde_grid(spark, sf):
    p = pnl(spark, sf).select(F.col("r").alias("x"))
    grid = spark.range(512).select((F.lit(-1.0) + F.col("id") * 2.0 / 511).alias("g"))
    curves = [dependence.kde(p, grid, rule).select(F.lit(rule).alias("bandwidth"), r8("g"), r6("density")) for rule in ("scott", "robust")]
    return curves[0].unionByName(curves[1])


def survival_curve(spark, sf):
    w = Window.orderBy("r")
    return pnl(spark, sf).select(r8("r"), r8(1 - F.row_number().over(w) / (F.count("*").over(Window.partitionBy()) + 1.0), "s"))


def qq_points(spark, sf):
    """Quantiles of earlier and later rows by feature, and of all features together as feature 0."""
    ps = [0.001 + k * (0.049 / 149) for k in range(150)]
    r = rets(spark, sf).withColumn("j", F.explode(F.array(F.col("j"), F.lit(0))))
    early = first_four_fifths(r)
    two = r.groupBy("j").agg(*[F.percentile(F.when(c, F.col("x")), F.array(*[F.lit(p) for p in ps])).alias(n) for n, c in (("a", early), ("b", ~early))])
    places = two.select("j", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(149))).alias("k"))  # a sample without rows has nulls
    return places.select("j", "k", r8(F.get("a", F.col("k")), "first"), r8(F.get("b", F.col("k")), "last"))


def worst_features(spark, sf):
    return rets(spark, sf).groupBy("j").agg(r8(F.percentile(-F.col("x"), F.lit(0.99)), "loss")).orderBy(F.desc("loss"), "j").limit(3)


def nn_novelty(spark, sf):
    """Distances of vectors with even identifiers to their nearest odd one, against those among the odd ones."""
    ship(spark)
    e = table(spark, sf, "embeddings")
    odd = e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("b"), F.col("embedding").cast("array<double>").alias("v"))
    own = dependence.nearest(odd.select(F.col("b").alias("q"), "v"), odd).withColumn("side", F.lit("real"))
    even = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").cast("array<double>").alias("v"))
    new = dependence.nearest(even, odd).withColumn("side", F.lit("new"))
    return own.unionByName(new).groupBy("side").agg(F.count("*").alias("n"), F.round(F.median("d"), 5).alias("median"), F.round(F.min("d"), 5).alias("least"), F.round(F.percentile("d", F.lit(0.05)), 5).alias("q05"))


def hs_generator(spark, sf):
    """Train windows as scenarios, and the law of their ten-step profit."""
    w = train_windows(spark, sf)
    losses = risk.window_losses(w, 10).select(F.lit("hs").alias("label"), F.round(-F.col("loss"), 12).alias("r"))
    return risk.law_var_es(risk.law(losses, ["label"]), [0.05], ["label"]).select("label", r8("alpha"), r8("var"), r8("es"), "m")


def window_prices(spark, sf):
    return strategies.prices(train_windows(spark, sf).where("k < 23")).withColumn("p", F.round("p", 10))


def buy_hold_pnl(spark, sf):
    return strategies.buy_and_hold(window_prices(spark, sf)).select("w", "j", r8("pnl"))


def static_portfolios(spark, sf):
    weights = spark.createDataFrame([(p, j, float((-1) ** (j * p) * j)) for p in (1, 2) for j in range(1, 8)], "portfolio int, j int, weight double")
    return strategies.static_portfolios(window_prices(spark, sf), weights).select("w", "portfolio", r8("pnl"))


def cumulative_windows(spark, sf):
    return window_prices(spark, sf).select("w", "j", "k", "p")


def smoothed_windows(spark, sf):
    return strategies.moving_average(window_prices(spark, sf), 5, "ma").select("w", "j", "k", r8("ma"))


def signal(spark, sf, trend):
    p = window_prices(spark, sf)
    s = strategies.trend_signal(p, 5) if trend else strategies.mean_reversion_signal(p, 5)
    return s.withColumn("z", F.round("z", 6))


def signal_thresholds(spark, sf):
    low, high = strategies.thresholds(signal(spark, sf, False))
    low2, high2 = strategies.thresholds(signal(spark, sf, True))
    return spark.createDataFrame([("mean_rev", low, high), ("trend", low2, high2)], "strategy string, lo double, hi double").select("strategy", r6("lo"), r6("hi"))


def mean_rev_pnl(spark, sf):
    """Bought below the low threshold of the signal and sold above the high one."""
    z = signal(spark, sf, False)
    low, high = (round(c, 6) for c in strategies.thresholds(z))
    held = strategies.positions(z, low, high, trend=False)
    return strategies.strategy_pnl(held).select("w", "j", r6("pnl"))


def ma_crossover_pnl(spark, sf):
    """Bought above the high threshold of the signal and sold below the low one."""
    z = signal(spark, sf, True)
    low, high = (round(c, 6) for c in strategies.thresholds(z))
    held = strategies.positions(z, high, low, trend=True)
    return strategies.strategy_pnl(held).select("w", "j", r6("pnl"))


def strategy_table(spark, sf):
    """All strategies under one key."""
    parts = [("buy_hold", buy_hold_pnl), ("static", static_portfolios), ("mean_rev", mean_rev_pnl), ("trend", ma_crossover_pnl)]
    both = None
    for name, f in parts:
        part = f(spark, sf).select("w", "pnl", F.lit(name).alias("strategy"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg("pnl"), 5).alias("mean"))


def var_es_score(spark, sf):
    b = strategies.buy_and_hold(window_prices(spark, sf))
    return strategies.joint_score(b, F.lit(-0.6), F.lit(-0.8), 0.05).select(r6("score"), "n")


def minmax_scale(spark, sf):
    return strategies.minmax(train_windows(spark, sf)).select("w", "k", "j", r8("y"))


def symmetric_scale(spark, sf):
    return strategies.symmetric(train_windows(spark, sf)).select("w", "k", "j", r8("y"))


QUERIES = {f.__name__: f for f in (
    pseudo_obs, tail_dep_matrix, tail_dep_curve_top, spearman_pairs, dependence_summary, covariance_sums, eigen_spectrum, eigen_rank, ad_stat, ks_uniform, ks_2samp, wasserstein1, sq_acf, window_rms, kurtosis_table,
    histogram, kde_grid, survival_curve, qq_points, worst_features, nn_novelty, hs_generator, buy_hold_pnl, static_portfolios, cumulative_windows, smoothed_windows, signal_thresholds, mean_rev_pnl,
    ma_crossover_pnl, strategy_table, var_es_score, minmax_scale, symmetric_scale,
)}

R10 = "ret10 AS (SELECT t, j, round(x, 10) AS x FROM ret)"


def obs(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT t, j, row_number() OVER (PARTITION BY j ORDER BY x, t) / (count(*) OVER (PARTITION BY j) + 1.0::DOUBLE) AS u FROM ret10 WHERE {where})"


def lam(src: str, q: str, upper: bool = False) -> str:
    c = f"u > 1 - {q}::DOUBLE" if upper else f"u < {q}::DOUBLE"
    return f"(SELECT a.j AS i, b.j AS j, count_if(a.h AND b.h)::DOUBLE / count(*) / {q}::DOUBLE AS lam FROM (SELECT t, j, {c} AS h FROM {src}) a JOIN (SELECT t, j, {c} AS h FROM {src}) b ON a.t = b.t AND a.j < b.j GROUP BY 1, 2)"


RANKS = f"{R10}, ranks AS (SELECT t, j, sum(CASE WHEN t < {EARLY} THEN 1 ELSE 0 END) OVER (PARTITION BY j ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST({EARLY} AS DOUBLE) AS u FROM ret10 QUALIFY t >= {EARLY})"
SAMP = f"{R10}, sa AS (SELECT j, x, CASE WHEN t >= {EARLY} THEN 1 ELSE 0 END AS s FROM ret10), ga AS (SELECT j, x, abs(sum(1 - s) OVER w::DOUBLE / nullif(sum(1 - s) OVER (PARTITION BY j), 0) - sum(s) OVER w::DOUBLE / nullif(sum(s) OVER (PARTITION BY j), 0)) AS gap, lead(x) OVER (PARTITION BY j ORDER BY x) - x AS st FROM sa WINDOW w AS (PARTITION BY j ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))".replace("sum(1 - s) OVER w::DOUBLE", "CAST(sum(1 - s) OVER w AS DOUBLE)").replace("sum(s) OVER w::DOUBLE", "CAST(sum(s) OVER w AS DOUBLE)")
WIN = f"{BASE}, {SPLIT}, {STARTS}, {WINDOWS}"
PRICES = f"{WIN}, pr AS (SELECT w, j, k, round(p, 10) AS p FROM (SELECT w, j, 0 AS k, 1.0::DOUBLE AS p FROM wins WHERE k = 0 UNION ALL SELECT w, j, k + 1, 1.0 + sum(x) OVER (PARTITION BY w, j ORDER BY k) FROM wins WHERE k < 23))"
BH = "bh AS (SELECT w, j, arg_max(p, k) - arg_min(p, k) AS pnl FROM pr GROUP BY w, j)"
MR = "mr AS (SELECT pr.w, pr.j, pr.k, p, round((p - m) / 0.01::DOUBLE, 6) AS z FROM pr JOIN (SELECT w, j, avg(p) AS m FROM pr WHERE k <= 5 GROUP BY w, j) USING (w, j))"
TF = "tf AS (SELECT w, j, k, p, round(((CASE WHEN k < 4 THEN p ELSE avg(p) OVER (PARTITION BY w, j ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END) - (CASE WHEN k < 9 THEN p ELSE avg(p) OVER (PARTITION BY w, j ORDER BY k ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END)) / 0.01::DOUBLE, 6) AS z FROM pr)"


def held(src: str, long_at: str, short_at: str, trend: bool, out: str) -> str:
    up, down = "coalesce(b < {a} AND z >= {a}, false)", "coalesce(b > {a} AND z <= {a}, false)"
    short, long = (down.format(a=short_at), up.format(a=long_at)) if trend else (up.format(a=short_at), down.format(a=long_at))
    o = out
    return f"""{o}0 AS (SELECT *, lag(z) OVER (PARTITION BY w, j ORDER BY k) AS b, max(k) OVER (PARTITION BY w, j) AS kl FROM {src}),
{o}1 AS (SELECT *, CASE WHEN {short} THEN 1 WHEN b IS NULL OR (b < 0 AND z >= 0) OR (b > 0 AND z <= 0) THEN -1 END AS ss, CASE WHEN {long} THEN 1 WHEN b IS NULL OR (b < 0 AND z >= 0) OR (b > 0 AND z <= 0) THEN -1 END AS ls FROM {o}0),
{o}2 AS (SELECT *, last_value(ss IGNORE NULLS) OVER v AS sp, last_value(ls IGNORE NULLS) OVER v AS lp FROM {o}1 WINDOW v AS (PARTITION BY w, j ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{o}3 AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN ss = 1 AND sp = -1 THEN -1 WHEN ss = -1 AND sp = 1 THEN 1 ELSE 0 END + CASE WHEN k = 0 THEN 0 WHEN ls = 1 AND lp = -1 THEN 1 WHEN ls = -1 AND lp = 1 THEN -1 ELSE 0 END AS st FROM {o}2),
{o}4 AS (SELECT w, j, k, p, kl, lead(p) OVER (PARTITION BY w, j ORDER BY k) AS nx, CASE WHEN k = kl THEN 0 ELSE sum(st) OVER (PARTITION BY w, j ORDER BY k) END AS pos FROM {o}3),
{o} AS (SELECT w, j, sum(pos * (nx - p)) AS pnl FROM {o}4 GROUP BY w, j)"""


def cut_at(src: str, p: float) -> str:
    return f"(SELECT round(quantile_cont(z, {p}::DOUBLE), 6) FROM {src})"


STATIC = "wt AS (SELECT p AS portfolio, j, (CASE WHEN (j * p) % 2 = 0 THEN 1 ELSE -1 END) * j / 28::DOUBLE AS weight FROM (SELECT unnest([1, 2]) AS p), (SELECT unnest(range(1, 8)) AS j)), st AS (SELECT w, portfolio, sum(weight * pnl) AS pnl FROM bh JOIN wt USING (j) GROUP BY 1, 2)"
MRP, TFP = f"{MR}, {held('mr', cut_at('mr', 0.31), cut_at('mr', 0.69), False, 'mrp')}", f"{TF}, {held('tf', cut_at('tf', 0.69), cut_at('tf', 0.31), True, 'tfp')}"
_ps = ", ".join(f"{0.001 + k * (0.049 / 149)!r}::DOUBLE" for k in range(150))
NN = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), nn AS (SELECT 'real' AS side, a.vec_id, min(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON b.vec_id % 2 = 1 AND a.vec_id % 2 = 1 AND a.vec_id <> b.vec_id GROUP BY 2 UNION ALL SELECT 'new', a.vec_id, min(list_distance(a.v, b.v)) FROM e a JOIN e b ON b.vec_id % 2 = 1 AND a.vec_id % 2 = 0 GROUP BY 2)"

SQL = {
    "pseudo_obs": f"{BASE}, {R10}, {obs('o')} SELECT t, j, round(u, 8) AS u FROM o",
    "tail_dep_matrix": f"{BASE}, {R10}, {obs('o')} SELECT i, j, round(a.lam, 8) AS lower, round(b.lam, 8) AS upper FROM {lam('o', '0.05')} a JOIN {lam('o', '0.05', True)} b USING (i, j)",
    "tail_dep_curve_top": f"{BASE}, {R10}, {obs('o', f't < {EARLY}')}, {obs('o2', f't >= {EARLY}')}, top AS (SELECT i, j FROM {lam('o', '0.1')} a JOIN {lam('o2', '0.1')} b USING (i, j) ORDER BY round(abs(a.lam - b.lam), 10) DESC, i, j LIMIT 5) SELECT i, j, q, round(lam, 8) AS lam FROM (" + " UNION ALL ".join(f"SELECT *, {q}::DOUBLE AS q FROM {lam('o', q)}" for q in map(str, Q_GRID)) + ") SEMI JOIN top USING (i, j)",
    "spearman_pairs": f"{BASE}, {R10}, {obs('o')} SELECT a.j AS i, b.j AS j, round(corr(a.u, b.u), 6) AS rho FROM o a JOIN o b ON a.t = b.t AND a.j < b.j GROUP BY 1, 2",
    "dependence_summary": f"{BASE}, c AS (SELECT a.j AS i, b.j AS j, corr(a.x, b.x) AS c FROM ret a JOIN ret b ON a.t = b.t AND a.j < b.j GROUP BY 1, 2) SELECT count(*) AS pairs, round(avg(c), 6) AS mean, round(quantile_cont(c, 0.95::DOUBLE), 6) AS q95, round(max(c), 6) AS largest, count_if(abs(c) > 0.02) AS n_over FROM c",
    "covariance_sums": f"{BASE} SELECT a.j AS i, b.j AS j, round(sum(a.x * b.x), 6) AS g FROM ret a JOIN ret b ON a.t = b.t AND a.j <= b.j GROUP BY 1, 2",
    "ad_stat": f"{BASE}, {RANKS}, o AS (SELECT j, least(greatest(u, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS u, row_number() OVER (PARTITION BY j ORDER BY u) AS i, count(*) OVER (PARTITION BY j) AS n FROM ranks) SELECT j, round(-n - sum((2 * i - 1) * ln(u) + (2 * n + 1 - 2 * i) * ln(1 - u)) / n, 4) AS ad FROM o GROUP BY j, n",
    "ks_uniform": f"{BASE}, {RANKS}, o AS (SELECT j, u, row_number() OVER (PARTITION BY j ORDER BY u) AS i, count(*) OVER (PARTITION BY j) AS n FROM ranks) SELECT j, n, round(max(greatest(i / n::DOUBLE - u, u - (i - 1) / n::DOUBLE)), 6) AS ks FROM o GROUP BY j, n",
    "ks_2samp": f"{BASE}, {SAMP} SELECT j, round(max(gap), 8) AS ks FROM ga GROUP BY j",
    "wasserstein1": f"{BASE}, {SAMP} SELECT j, round(sum(gap * coalesce(st, 0)), 6) AS w1 FROM ga GROUP BY j",
    "sq_acf": f"{WIN}, c AS (SELECT w, j, k, x * x - avg(x * x) OVER (PARTITION BY w, j) AS c FROM wins), p AS (SELECT a.w, a.j, lag, sum(a.c * coalesce(b.c, 0)) / (sum(a.c * a.c) + 1e-12::DOUBLE) AS r FROM c a CROSS JOIN (SELECT unnest(range(1, 6)) AS lag) LEFT JOIN c b ON b.w = a.w AND b.j = a.j AND b.k = a.k + lag GROUP BY 1, 2, 3) SELECT j, CAST(lag AS INT) AS lag, round(avg(r), 6) AS acf FROM p GROUP BY 1, 2",
    "window_rms": f"{WIN} SELECT j, round(stddev_pop(m), 6) AS sd, round(avg(m), 6) AS mean FROM (SELECT w, j, sqrt(avg(x * x)) AS m FROM wins GROUP BY w, j) GROUP BY j",
    "kurtosis_table": f"{BASE} SELECT j, round(kurtosis_pop(x) + 3, 6) AS kurtosis, round(stddev_pop(x), 6) AS sd, round(quantile_cont(x, 0.01::DOUBLE), 8) AS q01, round(quantile_cont(x, 0.05::DOUBLE), 8) AS q05 FROM ret GROUP BY j",
    "histogram": f"{PNL} SELECT CAST(least(floor((r - lo) / (hi - lo) * 80), 79) AS INT) AS bin, count(*) AS n FROM pnl, (SELECT min(r) AS lo, max(r) AS hi FROM pnl) GROUP BY 1",
    "kde_grid": f"{PNL}, h AS (SELECT 'scott' AS bandwidth, stddev_samp(r) * count(*) ** (-0.2::DOUBLE) AS h, count(*) AS n FROM pnl UNION ALL SELECT 'robust', 0.9 * least(stddev_samp(r), (quantile_cont(r, 0.75::DOUBLE) - quantile_cont(r, 0.25::DOUBLE)) / 1.349) * count(*) ** (-0.2::DOUBLE), count(*) FROM pnl) SELECT bandwidth, round(g, 8) AS g, round(sum(exp(-0.5 * ((g - r) / h) ** 2)) / (n * h * sqrt(2 * pi())), 6) AS density FROM pnl, h, (SELECT -1.0 + i * 2.0::DOUBLE / 511 AS g FROM range(0, 512) q(i)) GROUP BY bandwidth, g, n, h",
    "survival_curve": f"{PNL} SELECT round(r, 8) AS r, round(1 - row_number() OVER (ORDER BY r) / (count(*) OVER () + 1.0::DOUBLE), 8) AS s FROM pnl",
    "qq_points": f"{BASE}, q AS (SELECT j, quantile_cont(x, [{_ps}]) FILTER (t < {EARLY}) AS a, quantile_cont(x, [{_ps}]) FILTER (t >= {EARLY}) AS b FROM (SELECT t, j, x FROM ret UNION ALL SELECT t, 0, x FROM ret) GROUP BY j) SELECT j, CAST(k AS INT) AS k, round(a[k + 1], 8) AS first, round(b[k + 1], 8) AS last FROM q, range(0, 150) r(k)",
    "worst_features": f"{BASE} SELECT j, round(quantile_cont(-x, 0.99::DOUBLE), 8) AS loss FROM ret GROUP BY j ORDER BY loss DESC, j LIMIT 3",
    "nn_novelty": f"WITH {NN} SELECT side, count(*) AS n, round(median(d), 5) AS median, round(min(d), 5) AS least, round(quantile_cont(d, 0.05::DOUBLE), 5) AS q05 FROM nn GROUP BY side",
    "hs_generator": f"{WIN}, l AS (SELECT round(sum(x) / count(DISTINCT j), 12) AS r FROM wins WHERE k < 10 GROUP BY w), law AS (SELECT r AS x, row_number() OVER (ORDER BY r) AS i, count(*) OVER () AS m FROM l), a AS (SELECT 0.05::DOUBLE AS alpha) SELECT 'hs' AS label, alpha, round(-max(CASE WHEN i = ceil(alpha * m) THEN x END), 8) AS var, round(-sum(CASE WHEN i <= floor(alpha * m) THEN x / m WHEN i = floor(alpha * m) + 1 THEN (alpha - floor(alpha * m) / m) * x ELSE 0 END) / alpha, 8) AS es, max(m) AS m FROM law, a GROUP BY alpha",
    "buy_hold_pnl": f"{PRICES}, {BH} SELECT w, j, round(pnl, 8) AS pnl FROM bh",
    "static_portfolios": f"{PRICES}, {BH}, {STATIC} SELECT w, portfolio, round(pnl, 8) AS pnl FROM st",
    "cumulative_windows": f"{PRICES} SELECT w, j, CAST(k AS INT) AS k, p FROM pr",
    "smoothed_windows": f"{PRICES} SELECT w, j, CAST(k AS INT) AS k, round(CASE WHEN k < 4 THEN p ELSE avg(p) OVER (PARTITION BY w, j ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END, 8) AS ma FROM pr",
    "signal_thresholds": f"{PRICES}, {MR}, {TF} SELECT 'mean_rev' AS strategy, round(quantile_cont(z, 0.31::DOUBLE), 6) AS lo, round(quantile_cont(z, 0.69::DOUBLE), 6) AS hi FROM mr UNION ALL SELECT 'trend', round(quantile_cont(z, 0.31::DOUBLE), 6), round(quantile_cont(z, 0.69::DOUBLE), 6) FROM tf",
    "mean_rev_pnl": f"{PRICES}, {MRP} SELECT w, j, round(pnl, 6) AS pnl FROM mrp",
    "ma_crossover_pnl": f"{PRICES}, {TFP} SELECT w, j, round(pnl, 6) AS pnl FROM tfp",
    "strategy_table": f"{PRICES}, {BH}, {STATIC}, {MRP}, {TFP} SELECT strategy, count(*) AS n, round(avg(pnl), 5) AS mean FROM (SELECT 'buy_hold' AS strategy, pnl FROM bh UNION ALL SELECT 'static', pnl FROM st UNION ALL SELECT 'mean_rev', pnl FROM mrp UNION ALL SELECT 'trend', pnl FROM tfp) GROUP BY 1",
    "var_es_score": f"{PRICES}, {BH} SELECT round(avg((CASE WHEN pnl <= -0.6 THEN 1 ELSE 0 END - 0.05::DOUBLE) * (-10 * 0.36::DOUBLE / 2 + 10 * pnl * pnl / 2) - 0.8::DOUBLE * (CASE WHEN pnl <= -0.6 THEN 1 ELSE 0 END) * (-0.6::DOUBLE - pnl) + 0.05::DOUBLE * -0.8 * (-0.8 + 0.6::DOUBLE) - 0.05::DOUBLE * 0.64 / 2), 6) AS score, count(*) AS n FROM bh",
    "minmax_scale": f"{WIN} SELECT w, CAST(k AS INT) AS k, j, round(y, 8) AS y FROM (SELECT w, k, j, (x - min(x) OVER (PARTITION BY j)) / (max(x) OVER (PARTITION BY j) - min(x) OVER (PARTITION BY j) + 1e-7::DOUBLE) AS y FROM wins)",
    "symmetric_scale": f"{WIN} SELECT w, CAST(k AS INT) AS k, j, round(y, 8) AS y FROM (SELECT w, k, j, x / (max(abs(x)) OVER (PARTITION BY j) + 1e-12::DOUBLE) AS y FROM wins)",
}
