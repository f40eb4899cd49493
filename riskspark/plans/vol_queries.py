"""Volatility, regimes, filtered simulation and tests of expected shortfall."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.functions.tests import traffic_light
from riskspark.operators import dependence, risk, shortfall, vol, volmodels
from riskspark.session import ship

from .risk_queries import ALPHAS, CUT, LAW, LEVELS, VARES, first_four_fifths, pnl, r8, rets, train_pnl
from .sql import BASE, PNL

LAM = 0.94
#: Samples that the p-values of Z1 and Z2 rest on.
SIMULATIONS = 10_000


def filtered(spark, sf):
    ship(spark)
    r = rets(spark, sf)
    return vol.ewma(r, first_four_fifths(r), LAM)


def ewma_sigma(spark, sf):
    return filtered(spark, sf).select("t", "j", r8("sigma"))


def standardised_returns(spark, sf):
    return vol.standardised(filtered(spark, sf)).select("t", "j", F.round("e", 6).alias("e"))


def relative_vol(spark, sf):
    f = filtered(spark, sf)
    rel = f.join(f.groupBy("j").agg(F.median("sigma").alias("mid")), "j").withColumn("rel", F.col("sigma") / F.col("mid"))
    return rel.groupBy("t").agg(F.round(F.median("rel"), 6).alias("level"))


def vol_percentile_u(spark, sf):
    """Rank of each instrument's volatility among its earlier rows."""
    f = filtered(spark, sf)
    ranked = vol.percentile_rank(f.withColumn("sigma", F.round("sigma", 10)), "sigma", first_four_fifths(f), ["j"])
    return ranked.select("t", "j", r8("u"))


def regimes(spark, sf):
    v = vol.trailing_vol(pnl(spark, sf)).withColumn("vol", F.round("vol", 10))
    return vol.terciles(v, "vol")


def trailing_vol_regime(spark, sf):
    return regimes(spark, sf).select("t", "vol", "regime")


def scored(spark, sf):
    train, test = train_pnl(spark, sf)
    return risk.exceptions(test, risk.law_var_es(risk.law(train), ALPHAS))


def exceptions_by_regime(spark, sf):
    each = scored(spark, sf).join(regimes(spark, sf).select("t", "regime"), "t")
    return each.groupBy(r8("alpha"), "regime").agg(F.count("*").alias("n"), F.count_if("exc").alias("x"))


def exc_given_prev(spark, sf):
    w = Window.partitionBy("alpha").orderBy("t")
    each = scored(spark, sf).withColumn("before", F.when(F.lag("t").over(w) == F.col("t") - 1, F.lag("exc").over(w)))
    return each.groupBy(r8("alpha")).agg(F.count_if("before").alias("n_before"), F.count_if(F.col("before") & F.col("exc")).alias("n_both"))


def regime_episodes(spark, sf):
    calm = regimes(spark, sf).where("regime = 0").select("t")
    return vol.episodes(calm).orderBy(F.desc("n"), "first_t").limit(8)


def regime_band(spark, sf):
    """Days on which an instrument's rank of volatility lies in a band, both ends inside."""
    f = filtered(spark, sf).withColumn("sigma", F.round("sigma", 10))
    u = vol.percentile_rank(f, "sigma", first_four_fifths(f), ["j"]).where(F.col("u").between(0.4, 0.6))
    return u.join(pnl(spark, sf), "t").groupBy("j").agg(F.count("*").alias("n"), r8(F.avg("r"), "mean"), r8(F.stddev_pop("r"), "sd"))


def rolling_pair_corr(spark, sf):
    """Of every pair of instruments over 63 rows."""
    two = dependence.pairs_on_rows(rets(spark, sf), "x")
    w = Window.partitionBy("i", "j").orderBy("t").rowsBetween(-62, 0)
    return two.withColumn("n", F.count("*").over(w)).withColumn("c", F.corr("a", "b").over(w)).where("n = 63").select("i", "j", "t", F.round("c", 6).alias("c"))


def pair_moments(spark, sf, group):
    """Correlation of each pair of features over each group of rows; pairs of features only, i < j."""
    r = rets(spark, sf)
    g = group.select("t", "g")
    a, b = r.select("t", F.col("j").alias("i"), F.col("x").alias("a")), r.select("t", "j", F.col("x").alias("b"))
    return a.join(b, "t").where("i < j").join(g, "t").groupBy("g", "i", "j").agg(F.corr("a", "b").alias("c"))


def corr_by_regime(spark, sf):
    g = regimes(spark, sf).where("regime IS NOT NULL").select("t", F.col("regime").alias("g"))
    return pair_moments(spark, sf, g).groupBy("g").agg(F.round(F.avg("c"), 6).alias("mean_corr"), F.count("*").alias("pairs")).withColumnRenamed("g", "regime")


def rolling_mean_corr(spark, sf):
    """Mean correlation of all pairs over 63 rows, every 5 rows."""
    days = rets(spark, sf).select("t").distinct()
    ends = days.where("t >= 62 AND (t - 62) % 5 = 0").select(F.col("t").alias("g"), F.explode(F.sequence(F.col("t") - 62, F.col("t"))).alias("t"))
    return pair_moments(spark, sf, ends).groupBy("g").agg(F.round(F.avg("c"), 6).alias("c")).withColumnRenamed("g", "t")


def days_per_year(spark, sf):
    return rets(spark, sf).select("t", "d").distinct().groupBy(F.year("d").alias("y")).agg(F.count("*").alias("n"))


def acf_squares(spark, sf):
    """Lag-one correlation of squares for each feature."""
    w = Window.partitionBy("j").orderBy("t")
    sq = rets(spark, sf).withColumn("a", F.col("x") * F.col("x")).withColumn("b", F.lag("a").over(w))
    return sq.where("b IS NOT NULL").groupBy("j").agg(F.round(F.corr("a", "b"), 6).alias("c"))


def z1_z2(spark, sf):
    z = shortfall.z1_z2(scored(spark, sf))
    return z.select(r8("alpha"), "n", "n_exc", r8("z1"), r8("z2"))


def z2_traffic_light(spark, sf):
    return shortfall.z1_z2(scored(spark, sf)).select(r8("alpha"), r8("z2"), traffic_light(F.col("z2")).alias("zone"))


def z3(spark, sf):
    ship(spark)
    train, test = train_pnl(spark, sf)
    alpha = ALPHAS[1]
    return shortfall.z3(risk.law(train), test, alpha, test.count(), train.count()).select("n", "m", F.round("z3", 6).alias("z3"))


def z_mc_pvalues(spark, sf):
    train, test = train_pnl(spark, sf)
    law = risk.law(train)
    var = risk.law_var_es(law, [ALPHAS[1]])
    sims = shortfall.simulated(law, test.count(), SIMULATIONS, train.count(), seed=3)
    found = shortfall.z1_z2(sims.join(F.broadcast(var)), ["sim"])  # one row
    return shortfall.p_values(shortfall.z1_z2(risk.exceptions(test, var)), found).select(r8("z1"), r8("z2"), r8("p1"), r8("p2"))


def es_ratio(spark, sf):
    each = scored(spark, sf).where("exc")
    return each.groupBy(r8("alpha")).agg(r8(F.sum(-F.col("r")) / F.sum("es"), "ratio"), F.count("*").alias("n"))


def fhs_scenarios(spark, sf):
    f = vol.standardised(filtered(spark, sf))
    early = first_four_fifths(f)
    innovations = f.where(early).select(F.col("t").alias("s"), "j", "e")
    return vol.fhs_laws(innovations, f.where(~early).select("t", "j", "sigma"))


def conditional(spark, sf):
    laws = risk.law(fhs_scenarios(spark, sf).withColumn("x", F.round("x", 12)), ["t"], "x")
    return risk.law_var_es(laws, ALPHAS, ["t"])


def fhs_law_h1(spark, sf):
    return conditional(spark, sf).select("t", r8("alpha"), F.round("var", 6).alias("var"), F.round("es", 6).alias("es"), "m")


def cond_z_tests(spark, sf):
    each = conditional(spark, sf).join(pnl(spark, sf), "t")
    z = shortfall.z1_z2(each)
    return z.select(r8("alpha"), "n", "n_exc", F.round("z1", 5).alias("z1"), F.round("z2", 5).alias("z2"))


def fhs_law_h10(spark, sf):
    """Ten-step scenarios, the recursion run along each path; a recursion for each scenario and date has no SQL."""
    f = vol.standardised(filtered(spark, sf))
    early = first_four_fifths(f)
    days = f.where(early & (F.col("t") + 9 < f.where(early).agg(F.max("t") + 1).first()[0])).select("t").distinct()  # no path runs into the held-out rows
    places = days.select(F.col("t").alias("w"), F.posexplode(F.sequence("t", F.col("t") + 9)).alias("k", "t"))
    start = f.where(early).groupBy("j").agg(F.var_pop("x").alias("v"))
    scen = vol.fhs_path_laws(places.join(f, "t").select("w", "k", "j", "e"), f.where(~early).select("t", "j", "sigma"), start, 10, LAM)
    return risk.law_var_es(risk.law(scen, ["t"], "x"), ALPHAS, ["t"])


def gjr_sigma(spark, sf):
    """The asymmetric recursion at each feature's own optimum; an optimiser has no SQL."""
    ship(spark)
    r = rets(spark, sf)
    late = r.where(~first_four_fifths(r)).agg(F.sort_array(F.collect_set("t")).alias("held")).select(F.lit(0).cast("long").alias("split"), "held")  # the dates held out
    fit = volmodels.filtered(r, late, ["GJR"])
    return fit.select("j", "theta", F.posexplode("sigma").alias("t", "sigma")).select(F.col("t").cast("long").alias("t"), "j", "sigma", *[F.col("theta")[k + 2].alias(n) for k, n in enumerate("agb")])


QUERIES = {f.__name__: f for f in (
    ewma_sigma, standardised_returns, relative_vol, vol_percentile_u, trailing_vol_regime, exceptions_by_regime, exc_given_prev, regime_episodes, regime_band, rolling_pair_corr, corr_by_regime,
    rolling_mean_corr, days_per_year, acf_squares, z1_z2, z2_traffic_light, z3, z_mc_pvalues, es_ratio, fhs_law_h1, cond_z_tests, fhs_law_h10, gjr_sigma,
)}

C5 = "floor((1.0::DOUBLE - 0.2::DOUBLE) * (SELECT max(t) + 1 FROM ret))"
EWMA = f"""start AS (SELECT j, var_pop(x) AS v FROM ret WHERE t < {C5} GROUP BY j),
sig AS (SELECT 0::BIGINT AS t, j, v, v AS s2 FROM start
  UNION ALL SELECT sig.t + 1, sig.j, sig.v, greatest(0.94::DOUBLE * sig.s2 + (1 - 0.94::DOUBLE) * ret.x * ret.x, (0.05::DOUBLE * 0.05::DOUBLE) * sig.v)
  FROM sig JOIN ret ON ret.t = sig.t AND ret.j = sig.j WHERE sig.t + 1 <= (SELECT max(t) FROM ret)),
filt AS (SELECT t, j, x, sqrt(s2) AS sigma FROM sig JOIN ret USING (t, j))"""
REG = """tv AS (SELECT t, r, CASE WHEN count(r) OVER w = 63 THEN round(stddev_pop(r) OVER w, 10) END AS vol FROM pnl WINDOW w AS (ORDER BY t ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
tc AS (SELECT quantile_cont(vol, 1 / 3::DOUBLE) AS c1, quantile_cont(vol, 2 / 3::DOUBLE) AS c2 FROM tv),
reg AS (SELECT t, r, vol, CAST(CASE WHEN vol >= c2 THEN 2 WHEN vol >= c1 THEN 1 WHEN vol IS NOT NULL THEN 0 END AS INT) AS regime FROM tv, tc)"""
SCORED = f"{CUT}, {LEVELS}, {LAW}, {VARES}, scored AS (SELECT t, r, alpha, var, es, r + var < 0 AS exc FROM test, vares)"
Z = "z AS (SELECT {by} alpha, count(*) AS n, count_if(r + var < 0) AS n_exc, CASE WHEN count_if(r + var < 0) > 0 THEN sum(CASE WHEN r + var < 0 THEN r / es ELSE 0 END) / count_if(r + var < 0) + 1 END AS z1, sum(CASE WHEN r + var < 0 THEN r / es ELSE 0 END) / (count(*) * alpha) + 1 AS z2 FROM {src} GROUP BY {by} alpha)"
U = "up AS (SELECT t, j, sum(CASE WHEN t < (SELECT floor((1.0::DOUBLE - 0.2::DOUBLE) * (max(t) + 1)) FROM ret) THEN 1 ELSE 0 END) OVER (PARTITION BY j ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(floor((1.0::DOUBLE - 0.2::DOUBLE) * (SELECT max(t) + 1 FROM ret)) AS DOUBLE) AS u FROM (SELECT t, j, round(sigma, 10) AS s FROM filt))"
FHS = f"""scen AS (SELECT a.t, b.t AS s, round(sum(b.x / b.sigma * a.sigma) / count(*), 12) AS x FROM filt a JOIN filt b USING (j) WHERE a.t >= {C5} AND b.t < {C5} GROUP BY 1, 2),
law AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY x) AS i, x, count(*) OVER (PARTITION BY t) AS m FROM scen), {LEVELS},
vares AS (SELECT t, alpha, -max(CASE WHEN i = ceil(alpha * m) THEN x END) AS var, -sum(CASE WHEN i <= floor(alpha * m) THEN x / m WHEN i = floor(alpha * m) + 1 THEN (alpha - floor(alpha * m) / m) * x ELSE 0 END) / alpha AS es, max(m) AS m FROM law, alphas GROUP BY t, alpha)"""
PAIRS = "pc AS (SELECT g, a.j AS i, b.j AS j, corr(a.x, b.x) AS c FROM ret a JOIN ret b ON a.t = b.t AND a.j < b.j JOIN grp ON grp.t = a.t GROUP BY 1, 2, 3)"
# With n rows, m = floor(n alpha) and M cells, the expected mean of the m least: (1 / m) sum over k < m of the chance of more than k successes in n trials.
Z3 = f"""nm AS (SELECT (SELECT count(*) FROM test) AS n, CAST(floor((SELECT count(*) FROM test) * (1.0::DOUBLE - 0.975::DOUBLE)) AS BIGINT) AS m, (SELECT count(*) FROM train) AS cells),
edge AS (SELECT i, p, n, m, unnest(range(0, m)) AS k FROM (SELECT unnest(range(1, cells)) AS i, cells FROM nm), LATERAL (SELECT i / cells::DOUBLE AS p), nm),
pmf AS (SELECT i, k, m, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) AS f FROM edge),
cum AS (SELECT i, m, 1 - sum(f) OVER (PARTITION BY i ORDER BY k) AS tail FROM pmf),
w0 AS (SELECT i, sum(tail) / any_value(m) AS w FROM cum GROUP BY i UNION ALL SELECT 0, 0.0 UNION ALL SELECT cells, 1.0 FROM nm),
wt AS (SELECT i, w - lag(w) OVER (ORDER BY i) AS w FROM w0),
den AS (SELECT -sum(wt.w * law.x) AS den FROM wt JOIN law ON wt.i = law.i),
deep AS (SELECT r, (SELECT count(*) FROM law WHERE law.x <= q.r) / (SELECT cells FROM nm)::DOUBLE AS u FROM (SELECT r, row_number() OVER (ORDER BY r, t) AS k FROM test) q WHERE k <= (SELECT m FROM nm)),
es AS (SELECT -sum(law.x) / (SELECT m FROM nm) AS es FROM deep JOIN law ON law.i = ceil(greatest(least(u, 1 - 0.5 / (SELECT cells FROM nm)), 0.5 / (SELECT cells FROM nm)) * (SELECT cells FROM nm)))"""

SQL = {
    "ewma_sigma": f"{BASE}, {EWMA} SELECT t, j, round(sigma, 8) AS sigma FROM filt",
    "standardised_returns": f"{BASE}, {EWMA} SELECT t, j, round(x / sigma, 6) AS e FROM filt",
    "relative_vol": f"{BASE}, {EWMA}, mids AS (SELECT j, median(sigma) AS mid FROM filt GROUP BY j) SELECT t, round(median(sigma / mid), 6) AS level FROM filt JOIN mids USING (j) GROUP BY t",
    "vol_percentile_u": f"{BASE}, {EWMA}, {U} SELECT t, j, round(u, 8) AS u FROM up",
    "trailing_vol_regime": f"{PNL}, {REG} SELECT t, vol, regime FROM reg",
    "exceptions_by_regime": f"{PNL}, {REG}, {SCORED} SELECT round(alpha, 8) AS alpha, regime, count(*) AS n, count_if(exc) AS x FROM scored JOIN reg USING (t) GROUP BY 1, 2",
    "exc_given_prev": f"{PNL}, {SCORED} SELECT round(alpha, 8) AS alpha, count_if(b) AS n_before, count_if(b AND exc) AS n_both FROM (SELECT alpha, exc, CASE WHEN lag(t) OVER w = t - 1 THEN lag(exc) OVER w END AS b FROM scored WINDOW w AS (PARTITION BY alpha ORDER BY t)) GROUP BY 1",
    "regime_episodes": f"{PNL}, {REG} SELECT min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM (SELECT t, sum(nw) OVER (ORDER BY t) AS run FROM (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) > 5 THEN 1 ELSE 0 END AS nw FROM reg WHERE regime = 0)) GROUP BY run ORDER BY n DESC, first_t LIMIT 8",
    "regime_band": f"{PNL}, {EWMA}, {U} SELECT j, count(*) AS n, round(avg(r), 8) AS mean, round(stddev_pop(r), 8) AS sd FROM up JOIN pnl USING (t) WHERE u BETWEEN 0.4::DOUBLE AND 0.6::DOUBLE GROUP BY j",
    "rolling_pair_corr": f"{BASE}, two AS (SELECT a.t, a.j AS i, b.j AS j, a.x AS a, b.x AS b FROM ret a JOIN ret b ON a.t = b.t AND a.j < b.j) SELECT i, j, t, round(c, 6) AS c FROM (SELECT i, j, t, count(*) OVER w AS n, corr(a, b) OVER w AS c FROM two WINDOW w AS (PARTITION BY i, j ORDER BY t ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) WHERE n = 63",
    "corr_by_regime": f"{PNL}, {REG}, grp AS (SELECT t, regime AS g FROM reg WHERE regime IS NOT NULL), {PAIRS} SELECT g AS regime, round(avg(c), 6) AS mean_corr, count(*) AS pairs FROM pc GROUP BY g",
    "rolling_mean_corr": f"{BASE}, grp AS (SELECT g, unnest(range(g - 62, g + 1)) AS t FROM (SELECT DISTINCT t AS g FROM ret WHERE t >= 62 AND (t - 62) % 5 = 0)), {PAIRS} SELECT g AS t, round(avg(c), 6) AS c FROM pc GROUP BY g",
    "days_per_year": f"{BASE} SELECT CAST(year(d) AS INT) AS y, count(DISTINCT t) AS n FROM ret GROUP BY 1",
    "acf_squares": f"{BASE} SELECT j, round(corr(a, b), 6) AS c FROM (SELECT j, x * x AS a, lag(x * x) OVER (PARTITION BY j ORDER BY t) AS b FROM ret) WHERE b IS NOT NULL GROUP BY j",
    "z1_z2": f"{PNL}, {SCORED}, {Z.format(by='', src='scored')} SELECT round(alpha, 8) AS alpha, n, n_exc, round(z1, 8) AS z1, round(z2, 8) AS z2 FROM z",
    "z2_traffic_light": f"{PNL}, {SCORED}, {Z.format(by='', src='scored')} SELECT round(alpha, 8) AS alpha, round(z2, 8) AS z2, CASE WHEN z2 < -1.80 THEN 'red' WHEN z2 < -0.70 THEN 'yellow' ELSE 'green' END AS zone FROM z",
    "z3": f"{PNL}, {CUT}, {LAW}, {Z3} SELECT n, m, round(-es / den + 1, 6) AS z3 FROM nm, es, den",
    "z_mc_pvalues": f"{PNL}, {CUT}, alphas AS (SELECT 1.0::DOUBLE - 0.975::DOUBLE AS alpha), {LAW}, {VARES}, draws AS (SELECT sim, k, CAST(('0x' || substr(md5('3:' || sim || ':' || k), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496 AS u, CAST(greatest(1, least(cells, ceil(greatest(least(u, 1 - 1e-12::DOUBLE), 1e-12::DOUBLE) * cells))) AS BIGINT) AS place FROM (SELECT count(*) AS cells FROM train), (SELECT unnest(range(0, 10000)) AS sim), (SELECT unnest(range(0, (SELECT count(*) FROM test))) AS k)), sims AS (SELECT sim, law.x AS r, alpha, var, es FROM draws JOIN law ON law.i = place, vares), {Z.format(by='sim,', src='sims')}, obs AS (SELECT sum(CASE WHEN r + var < 0 THEN r / es ELSE 0 END) / nullif(count_if(r + var < 0), 0) + 1 AS z1, sum(CASE WHEN r + var < 0 THEN r / es ELSE 0 END) / (count(*) * any_value(alpha)) + 1 AS z2 FROM test, vares) SELECT round(obs.z1, 8) AS z1, round(obs.z2, 8) AS z2, round(avg(CASE WHEN z.z1 IS NOT NULL AND obs.z1 IS NOT NULL THEN CASE WHEN z.z1 < obs.z1 THEN 1 ELSE 0 END END), 8) AS p1, round(avg(CASE WHEN z.z2 < obs.z2 THEN 1 ELSE 0 END), 8) AS p2 FROM z, obs GROUP BY obs.z1, obs.z2",
    "es_ratio": f"{PNL}, {SCORED} SELECT round(alpha, 8) AS alpha, round(sum(-r) / sum(es), 8) AS ratio, count(*) AS n FROM scored WHERE exc GROUP BY 1",
    "fhs_law_h1": f"{BASE}, {EWMA}, {FHS} SELECT t, round(alpha, 8) AS alpha, round(var, 6) AS var, round(es, 6) AS es, m FROM vares",
    "cond_z_tests": f"{PNL}, {EWMA}, {FHS}, sc AS (SELECT t, r, alpha, var, es FROM vares JOIN pnl USING (t)), {Z.format(by='', src='sc')} SELECT round(alpha, 8) AS alpha, n, n_exc, round(z1, 5) AS z1, round(z2, 5) AS z2 FROM z",
}
