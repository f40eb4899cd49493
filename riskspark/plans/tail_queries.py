"""Extreme-value marginals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.functions.special import t_cdf, t_ppf
from riskspark.functions.tests import uniform
from riskspark.operators import tails
from riskspark.session import ship

from .risk_queries import EARLY, first_four_fifths, n_rows, pnl, r8, rets
from .sql import BASE, PNL


#: Bootstrap samples.
REPLICATES = 200


def r5(c, name=None):
    return F.round(c, 5).alias(name or c)


def hill_index(spark, sf):
    return tails.hill(rets(spark, sf)).select("j", "side", "k", F.round("alpha", 6).alias("alpha"))


def fits(spark, sf):
    ship(spark)
    return tails.zhang_stephens(tails.exceedances(rets(spark, sf)), ["j", "side"])


def gpd_zhang_stephens(spark, sf):
    return fits(spark, sf).select("j", "side", "n", r5("xi"), r5("beta"))


def eb_shrink_xi(spark, sf):
    return tails.shrunk(fits(spark, sf), ["side"]).select("j", "side", r5("xi"), r5("xi_shrunk"))


def marginal_thresholds(spark, sf):
    return tails.thresholds(rets(spark, sf)).select("j", r8("u_lo"), r8("u_hi"))


def marginal_body_knots(spark, sf):
    return tails.body_knots(rets(spark, sf).withColumn("x", F.round("x", 10))).select("j", "x", r8("p"))


def marginal_cdf(spark, sf):
    return tails.marginal_cdf(rets(spark, sf).withColumn("x", F.round("x", 10)), fits(spark, sf)).select("t", "j", r5("u"))


def marginal_ppf(spark, sf):
    return tails.tail_quantiles(rets(spark, sf), fits(spark, sf), [0.04, 0.01, 0.002]).select("j", "side", "level", r5("x"))


def rank_recalibrate(spark, sf):
    """Later rows of each feature replaced by the earlier rows' quantile at their own rank."""
    r = rets(spark, sf).withColumn("x", F.round("x", 10))
    w = Window.partitionBy("j").orderBy("x", "t")
    lead = first_four_fifths(r)
    late = r.where(~lead).withColumn("p", F.row_number().over(w) / (F.count("*").over(Window.partitionBy("j")) + 1.0))
    early = r.where(lead)
    place = Window.partitionBy("j").orderBy("x")
    knots = early.select("j", "x", (F.row_number().over(place) - 1.0).alias("i"), F.count("*").over(Window.partitionBy("j")).alias("n")).select("j", (F.col("i") / (F.col("n") - 1)).alias("p"), "x")
    return tails.interpolate(late.select("t", "j", "p"), knots, ["j"], "p", "x", "p", "x").select("t", "j", r8("x"))


def gpd_var_es_zs(spark, sf):
    ship(spark)
    return tails.gpd_var_es(pnl(spark, sf).select((-F.col("r")).alias("loss")), [0.95, 0.99, 0.995]).select("level", "n", r5("u"), r5("xi"), r5("beta"), r5("var"), r5("es"))


def shrunk_fits(spark, sf):
    """Shapes pooled over features, and the scale of greatest likelihood at each of them."""
    ship(spark)
    return tails.fitted(tails.exceedances(rets(spark, sf)), xi=tails.shrunk(fits(spark, sf), ["side"]))


def marginal_cdf_shrunk(spark, sf):
    """The marginals with pooled tails."""
    return tails.marginal_cdf(rets(spark, sf).withColumn("x", F.round("x", 10)), shrunk_fits(spark, sf)).select("t", "j", r5("u"))


def gpd_risk_interval(spark, sf):
    """VaR and ES of each feature and of the portfolio by a generalised Pareto tail, with the percentiles of 200 bootstrap replicates; an optimiser, so no SQL."""
    ship(spark)
    each = rets(spark, sf).select(F.col("j").cast("string").alias("series"), (-F.col("x")).alias("loss"))
    whole = pnl(spark, sf).select(F.lit("portfolio").alias("series"), (-F.col("r")).alias("loss"))
    return tails.risk_intervals(tails.gpd_risk(each.unionByName(whole), [0.95, 0.99, 0.995], ["series"], REPLICATES, seed=11), ["series"])


def gpd_mle(spark, sf):
    """An optimiser for each tail, and then the scale at shrunk shapes; no SQL."""
    ship(spark)
    exc = tails.exceedances(rets(spark, sf))
    free = tails.fitted(exc)
    held = shrunk_fits(spark, sf).select("j", "side", F.col("xi").alias("xi_shrunk"), F.col("beta").alias("beta_shrunk"))
    return free.join(held, ["j", "side"])


def pit_student(spark, sf):
    """Marginal ranks as Student-t scores with five degrees of freedom, and back; special functions have no SQL."""
    ship(spark)

    @F.pandas_udf("double")
    def score(u: pd.Series) -> pd.Series:
        return pd.Series(t_ppf(np.clip(u.to_numpy(), 1e-12, 1 - 1e-12), 5.0))

    @F.pandas_udf("double")
    def back(z: pd.Series) -> pd.Series:
        return pd.Series(t_cdf(z.to_numpy(), 5.0))

    u = tails.marginal_cdf(rets(spark, sf), fits(spark, sf))
    return u.withColumn("z", score("u")).withColumn("u_back", back("z"))


def risk_interval(spark, sf):
    """VaR and CVaR of hashed bootstrap replicates of the loss, and their 2.5 and 97.5 percentiles."""
    loss = pnl(spark, sf).select("t", (-F.col("r")).alias("loss"))
    rows = n_rows(loss)
    draws = loss.select("t", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("b"))
    at = F.floor(uniform(F.concat_ws(":", F.lit("boot"), F.col("b").cast("string"), F.col("t").cast("string"))) * rows).cast("long")
    each = draws.select("b", at.alias("t")).join(loss, "t")
    var = each.groupBy("b").agg(F.percentile("loss", F.lit(0.95)).alias("var"))
    cvar = each.join(var, "b").where("loss >= var").groupBy("b", "var").agg(F.avg("loss").alias("cvar"))
    pick = lambda c, p: F.round(F.percentile(c, F.lit(p)), 8)
    return cvar.agg(pick("var", 0.025).alias("var_lo"), pick("var", 0.975).alias("var_hi"), pick("cvar", 0.025).alias("cvar_lo"), pick("cvar", 0.975).alias("cvar_hi"))


QUERIES = {f.__name__: f for f in (
    hill_index, gpd_zhang_stephens, eb_shrink_xi, marginal_thresholds, marginal_body_knots, marginal_cdf, marginal_ppf, rank_recalibrate, gpd_var_es_zs, marginal_cdf_shrunk, gpd_risk_interval, gpd_mle, pit_student, risk_interval,
)}

TH = "th AS (SELECT j, quantile_cont(x, 0.05::DOUBLE) AS u_lo, quantile_cont(x, 1 - 0.05::DOUBLE) AS u_hi FROM ret GROUP BY j)"
EXC = f"{TH}, exc AS (SELECT j, 'lower' AS side, u_lo - x AS y FROM ret JOIN th USING (j) WHERE x < u_lo UNION ALL SELECT j, 'upper', x - u_hi FROM ret JOIN th USING (j) WHERE x > u_hi)"


def zs_sql(by: str) -> str:
    return f"""ord AS (SELECT {by}, y, row_number() OVER (PARTITION BY {by} ORDER BY y) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM exc),
zone AS (SELECT {by}, n, max(CASE WHEN i = floor(n / 4::DOUBLE + 0.5) THEN y END) AS q, max(y) AS mx, CAST(30 + floor(sqrt(n)) AS BIGINT) AS gg FROM ord GROUP BY {by}, n),
zgrid AS (SELECT {by}, n, k, (1.0 - sqrt(gg / (k - 0.5::DOUBLE))) / (3.0 * q) + 1.0 / mx AS b FROM (SELECT *, unnest(range(1, gg + 1)) AS k FROM zone)),
zxi AS (SELECT {by}, n, k, b, avg(ln(1 + (-b * y))) AS xi FROM zgrid JOIN exc USING ({by}) GROUP BY {by}, n, k, b),
zl AS (SELECT *, n * (ln(-b / xi) - xi - 1.0) AS l FROM zxi), zw AS (SELECT *, exp(l - max(l) OVER (PARTITION BY {by})) AS w FROM zl),
zb AS (SELECT {by}, n, sum(w * b) / sum(w) AS b FROM zw GROUP BY {by}, n),
fit AS (SELECT {by}, n, avg(ln(1 + (-b * y))) AS xi, any_value(b) AS b FROM exc JOIN zb USING ({by}) GROUP BY {by}, n),
fits AS (SELECT {by}, n, xi, greatest(-xi / b, 1e-12::DOUBLE) AS beta FROM fit)"""


FITS = f"{EXC}, {zs_sql('j, side')}"
R10 = "ret10 AS (SELECT t, j, round(x, 10) AS x FROM ret), th10 AS (SELECT j, quantile_cont(x, 0.05::DOUBLE) AS u_lo, quantile_cont(x, 1 - 0.05::DOUBLE) AS u_hi FROM ret10 GROUP BY j), knots AS (SELECT j, x, min(p) AS p FROM (SELECT j, x, (row_number() OVER (PARTITION BY j ORDER BY x) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY j) AS p FROM ret10) JOIN th10 USING (j) WHERE x BETWEEN u_lo AND u_hi GROUP BY j, x)"
INV = "CASE WHEN abs(xi) < 1e-8 THEN -beta * ln({p}) ELSE beta / xi * (({p}) ** (-xi) - 1.0) END"


def cdf_sql(fits: str, rows: str = "ret10") -> str:
    """u of all rows, by thresholds th10, knots and the given fits."""
    return f"""kn AS (SELECT j, x, max(p) AS p FROM (SELECT * FROM knots UNION ALL SELECT j, u_lo, 0.05::DOUBLE FROM th10 UNION ALL SELECT j, u_hi, 1 - 0.05::DOUBLE FROM th10) GROUP BY j, x),
seg AS (SELECT j, x AS x0, p AS p0, lead(x) OVER w AS x1, lead(p) OVER w AS p1 FROM kn WINDOW w AS (PARTITION BY j ORDER BY x)),
body AS (SELECT r.t, r.j, r.x, CASE WHEN x0 IS NULL THEN NULL WHEN x1 IS NULL OR r.x = x0 THEN p0 ELSE p0 + (r.x - x0) * (p1 - p0) / (x1 - x0) END AS b FROM {rows} r ASOF LEFT JOIN seg ON r.j = seg.j AND r.x >= seg.x0),
both_ AS (SELECT body.*, u_lo, u_hi, lo.xi AS xl, lo.beta AS bl, hi.xi AS xh, hi.beta AS bh FROM body JOIN th10 USING (j) JOIN {fits} lo ON lo.j = body.j AND lo.side = 'lower' JOIN {fits} hi ON hi.j = body.j AND hi.side = 'upper'),
cdf AS (SELECT t, j, CASE WHEN x < u_lo THEN 0.05 * CASE WHEN abs(xl) < 1e-8 THEN exp(-(u_lo - x) / bl) ELSE greatest(1 + xl * (u_lo - x) / bl, 0) ** (-1 / xl) END
  WHEN x > u_hi THEN 1 - 0.05 * CASE WHEN abs(xh) < 1e-8 THEN exp(-(x - u_hi) / bh) ELSE greatest(1 + xh * (x - u_hi) / bh, 0) ** (-1 / xh) END ELSE b END AS u FROM both_)"""


POOLED = "s AS (SELECT *, (1 + xi) ** 2 / n AS s2 FROM fits), p AS (SELECT *, avg(xi) OVER w AS mu, greatest(0, var_samp(xi) OVER w - avg(s2) OVER w) AS tau2 FROM s WINDOW w AS (PARTITION BY side)), m AS (SELECT *, (1 - tau2 / (tau2 + s2)) * (xi - mu) AS mv FROM p), pooled AS (SELECT j, side, n, xi, xi - sign(mv) * least(abs(mv), (1 + xi) / sqrt(n)) AS xi_shrunk FROM m)"
# The score falls as the scale grows, so halving an interval finds where it vanishes.
SHRUNK = f"""{POOLED}, tail AS (SELECT pooled.j, pooled.side, greatest(any_value(xi_shrunk), 0) AS xi, list(y ORDER BY y) AS ys FROM pooled JOIN exc ON exc.j = pooled.j AND exc.side = pooled.side GROUP BY pooled.j, pooled.side),
half AS (SELECT j, side, xi, ys, 0.0::DOUBLE AS lo, 50 * list_avg(ys) AS hi, 0 AS i FROM tail
  UNION ALL SELECT j, side, xi, ys, CASE WHEN g > 1 / (1 + xi) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN g > 1 / (1 + xi) THEN hi ELSE (lo + hi) / 2 END, i + 1
  FROM (SELECT *, list_avg([y / ((lo + hi) / 2 + xi * y) FOR y IN ys]) AS g FROM half WHERE i < 70)),
held AS (SELECT j, side, xi, (lo + hi) / 2 AS beta FROM half WHERE i = 70)"""

SQL = {
    "hill_index": f"{BASE}, sided AS (SELECT j, 'lower' AS side, -x AS y FROM ret UNION ALL SELECT j, 'upper', x FROM ret), ks AS (SELECT j, CAST(greatest(10, floor(0.02::DOUBLE * count(*))) AS BIGINT) AS k FROM ret GROUP BY j), top AS (SELECT j, side, ln(y) AS l, row_number() OVER (PARTITION BY j, side ORDER BY y DESC) AS i FROM sided WHERE y > 0) SELECT j, side, k, round(1.0 / (avg(l) FILTER (i <= k) - max(l) FILTER (i = k + 1)), 6) AS alpha FROM top JOIN ks USING (j) WHERE i <= k + 1 GROUP BY j, side, k",
    "gpd_zhang_stephens": f"{BASE}, {FITS} SELECT j, side, n, round(xi, 5) AS xi, round(beta, 5) AS beta FROM fits",
    "eb_shrink_xi": f"{BASE}, {FITS}, {POOLED} SELECT j, side, round(xi, 5) AS xi, round(xi_shrunk, 5) AS xi_shrunk FROM pooled",
    "marginal_thresholds": f"{BASE}, {TH} SELECT j, round(u_lo, 8) AS u_lo, round(u_hi, 8) AS u_hi FROM th",
    "marginal_body_knots": f"{BASE}, {R10} SELECT j, x, round(p, 8) AS p FROM knots",
    "marginal_cdf": f"{BASE}, {FITS}, {R10}, {cdf_sql('fits')} SELECT t, j, round(u, 5) AS u FROM cdf",
    "marginal_cdf_shrunk": f"{BASE}, {FITS}, {R10}, {SHRUNK}, {cdf_sql('held')} SELECT t, j, round(u, 5) AS u FROM cdf",
    "marginal_ppf": f"{BASE}, {FITS}, lv AS (SELECT unnest([0.04::DOUBLE, 0.01::DOUBLE, 0.002::DOUBLE]) AS level), e AS (SELECT *, {INV.format(p='level / 0.05::DOUBLE')} AS y FROM fits JOIN th USING (j), lv) SELECT j, side, level, round(CASE WHEN side = 'lower' THEN u_lo - y ELSE u_hi + y END, 5) AS x FROM e",
    "rank_recalibrate": f"{BASE}, {R10}, late AS (SELECT t, j, row_number() OVER (PARTITION BY j ORDER BY x, t) / (count(*) OVER (PARTITION BY j) + 1.0::DOUBLE) AS p FROM ret10 WHERE t >= {EARLY}), kn AS (SELECT j, (row_number() OVER (PARTITION BY j ORDER BY x) - 1.0::DOUBLE) / (count(*) OVER (PARTITION BY j) - 1) AS p, x FROM ret10 WHERE t < {EARLY}), seg AS (SELECT j, p AS p0, x AS x0, lead(p) OVER w AS p1, lead(x) OVER w AS x1 FROM kn WINDOW w AS (PARTITION BY j ORDER BY p)) SELECT t, late.j, round(CASE WHEN p1 IS NULL OR late.p = p0 THEN x0 ELSE x0 + (late.p - p0) * (x1 - x0) / (p1 - p0) END, 8) AS x FROM late ASOF LEFT JOIN seg ON late.j = seg.j AND late.p >= seg.p0",
    "gpd_var_es_zs": f"{PNL}, losses AS (SELECT -r AS loss FROM pnl), uu AS (SELECT quantile_cont(loss, 0.9::DOUBLE) AS u, count(*) AS nn FROM losses), exc AS (SELECT 1 AS g, loss - u AS y FROM losses, uu WHERE loss > u), {zs_sql('g')}, e AS (SELECT level, n, u, nn, least(xi, 0.95::DOUBLE) AS xi, beta FROM fits, uu, (SELECT unnest([0.95::DOUBLE, 0.99::DOUBLE, 0.995::DOUBLE]) AS level)), v AS (SELECT *, u + {INV.format(p='(1.0 - level) * nn / n')} AS var FROM e) SELECT level, n, round(u, 5) AS u, round(xi, 5) AS xi, round(beta, 5) AS beta, round(var, 5) AS var, round((var + beta - xi * u) / (1 - xi), 5) AS es FROM v",
    "risk_interval": f"{PNL}, losses AS (SELECT t, -r AS loss FROM pnl), draws AS (SELECT b, CAST(floor(CAST(('0x' || substr(md5('boot:' || b || ':' || t), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496 * (SELECT max(t) + 1 FROM pnl)) AS BIGINT) AS t FROM losses, (SELECT unnest(range(0, 200)) AS b)), e AS (SELECT b, loss FROM draws JOIN losses USING (t)), v AS (SELECT b, quantile_cont(loss, 0.95::DOUBLE) AS var FROM e GROUP BY b), c AS (SELECT b, var, avg(loss) AS cvar FROM e JOIN v USING (b) WHERE loss >= var GROUP BY b, var) SELECT round(quantile_cont(var, 0.025::DOUBLE), 8) AS var_lo, round(quantile_cont(var, 0.975::DOUBLE), 8) AS var_hi, round(quantile_cont(cvar, 0.025::DOUBLE), 8) AS cvar_lo, round(quantile_cont(cvar, 0.975::DOUBLE), 8) AS cvar_hi FROM c",
}
