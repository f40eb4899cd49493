"""p-values, records of tests, reports over several diagnostics, picks and samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskspark.functions.tests import CHI2_95, chi2_p, ks_p, pf_lr, tuff_lr, uniform
from riskspark.functions.special import t_ppf
from riskspark.operators import coverage, dependence, risk, split, tails
from riskspark.session import ship
from riskspark.sources.panels import lineitem_panel
from riskspark.sources.shared import kept

from . import diag_queries, risk_queries, tail_queries, vol_queries
from .diag_queries import lam, obs, r6, rounded
from .risk_queries import CUT, EARLY, HORIZON, LAW, LEVELS, N, PMF, SPLIT, STARTS, VARES, WINDOWS, first_four_fifths, hashed_split, n_rows, pf_sql, pnl, r8, rets, train_windows, tuff_sql
from .sql import BASE, PNL
from .tail_queries import R10, cdf_sql, zs_sql

#: Ranks among windows by loss from which one window each is shown.
PICKS = [float(q) for q in np.linspace(0.5, 0.995, 5)]
LEVELS_U = [0.1, 0.3, 0.5, 0.7, 0.9]


def coverage_pvalues(spark, sf):
    """Both coverage tests with their p-values, two-sided and one-sided; a sample without failures is censored."""
    ship(spark)
    each = vol_queries.scored(spark, sf)
    n = each.groupBy("alpha").agg(F.count("*").alias("n"), F.count_if("exc").alias("failures"), F.min(F.when(F.col("exc"), F.col("t"))).alias("_t"), F.min("t").alias("_s"))
    n = n.withColumn("v", F.col("_t") - F.col("_s") + 1).withColumn("pf", pf_lr(F.col("failures"), F.col("n"), F.col("alpha"))).withColumn("tuff", tuff_lr(F.col("v"), F.col("alpha")))
    pmf = coverage.with_binomial(n.select("n", "alpha").distinct(), "n", "alpha")
    part = lambda keep: F.round(F.sum(F.when(keep, F.col("pmf")).otherwise(0.0)), 8)
    tails = n.select("n", "alpha", "failures").join(pmf, ["n", "alpha"]).groupBy("alpha").agg(part(F.col("x") >= F.col("failures")).alias("p_upper"), part(F.col("x") <= F.col("failures")).alias("p_lower"))
    return n.join(tails, "alpha").select(
        r8("alpha"), "n", "failures", r8(F.col("failures") / F.col("n"), "rate"), r6("pf"), r8(chi2_p("pf"), "pf_p"), "p_upper", "p_lower",
        F.col("v").isNull().alias("censored"), r6("tuff"), F.when(F.col("v").isNotNull(), F.round(chi2_p("tuff"), 8)).alias("tuff_p"),
    )


def es_test_records(spark, sf):
    """A record for each test of expected shortfall and level; one that is not defined says why."""
    z = vol_queries.z1_z2(spark, sf)
    record = lambda name, z, needed, reason: F.struct(F.lit(name).alias("test"), F.when(needed, F.col(z)).alias("statistic"), needed.alias("defined"), F.when(~needed, reason).otherwise("").alias("reason"))
    two = F.array(record("Z1", "z1", F.col("n_exc") > 0, "no exception"), record("Z2", "z2", F.col("n") > 0, "no observation"))
    return z.select("alpha", "n", "n_exc", r6(F.col("n") * F.col("alpha"), "expected"), F.inline(two))


def ks_pvalues(spark, sf):
    ship(spark)
    return dependence.ks_uniform(diag_queries.normal_ranks(spark, sf)).select("j", "n", r6("ks"), r6(ks_p("ks", "n"), "p"))


def rejection_rates(spark, sf):
    """Share of months whose first failure comes too early or too late, by level: a month without a failure has no such test, and counts once as not rejected and once not at all."""
    ship(spark)
    month = rets(spark, sf).select("t", F.date_format("d", "yyyy-MM").alias("month")).distinct()
    each = vol_queries.scored(spark, sf).join(month, "t")
    first = F.min(F.when(F.col("exc"), F.col("t"))) - F.min("t") + 1
    p = each.groupBy("alpha", "month").agg(first.alias("v")).withColumn("p", F.when(F.col("v").isNotNull(), chi2_p(tuff_lr(F.col("v"), F.col("alpha")))))
    hit = F.col("p") < 0.05
    return p.groupBy(r8("alpha")).agg(r8(F.avg(F.coalesce(hit, F.lit(False)).cast("int")), "all_tests"), r8(F.avg(hit.cast("int")), "defined_tests"), F.count("*").alias("tests"), F.count("p").alias("defined"))


def lam_of(rows, q=0.1):
    return dependence.tail_dependence(dependence.pseudo_obs(rows), q)


def pair_slope(spark, sf):
    """Tail dependence of later rows against that of earlier ones, over all pairs."""
    r = rounded(spark, sf)
    early = first_four_fifths(r)
    both = lam_of(r.where(early)).join(lam_of(r.where(~early)).withColumnRenamed("lam", "later"), ["i", "j"])
    return both.agg(F.count("*").alias("pairs"), r6(F.avg("lam"), "mean"), r6(F.corr("lam", "later"), "corr"), r6(F.regr_slope("later", "lam"), "slope"), r6(F.avg(F.abs(F.col("later") - F.col("lam"))), "error"))


def half_split_floor(spark, sf):
    """What the error of pair_slope would be by chance: the dates in a random order, their first half against the second."""
    r = rounded(spark, sf)
    days = split.permuted(r.select("t").distinct(), "t", 11)
    half = n_rows(r) // 2
    sides = r.join(days.where(F.col("place") < 2 * half), "t").withColumn("side", (F.col("place") >= half).cast("int"))
    lams = dependence.tail_dependence(dependence.pseudo_obs(sides, ["side"]), 0.1, by=["side"])
    both = lams.where("side = 0").join(lams.where("side = 1").select("i", "j", F.col("lam").alias("other")), ["i", "j"])
    return both.agg(F.count("*").alias("pairs"), r6(F.avg(F.abs(F.col("lam") - F.col("other"))), "floor"))


def labelled_rows(spark, sf):
    """label, t, j, x: two sources of rows held against the held-out ones: all training rows of the drawn split, and those of its calm and middle days."""
    flags = split.split_rows(spark, hashed_split(spark, sf))
    train = rounded(spark, sf).join(flags.where("NOT is_test").select("t"), "t")
    quiet = train.join(vol_queries.regimes(spark, sf).where("regime < 2").select("t"), "t")
    return train.withColumn("label", F.lit("all")).unionByName(quiet.withColumn("label", F.lit("quiet"))).select("label", "t", "j", "x")


def run_summary(spark, sf):
    """One row a label: tail dependence against that of the held-out rows (mean, correlation, slope, error), the error of two random halves of the label's own rows, the slope after each
    feature's rows are shuffled, and VaR and CVaR at 99.5 %."""
    q = 0.1
    rows = labelled_rows(spark, sf)
    flags = split.split_rows(spark, hashed_split(spark, sf))
    real = lam_of(rounded(spark, sf).join(flags.where("is_test").select("t"), "t"), q).withColumnRenamed("lam", "real")
    lam = dependence.tail_dependence(dependence.pseudo_obs(rows, ["label"]), q, by=["label"])
    fit = lam.join(real, ["i", "j"]).groupBy("label").agg(
        r6(F.avg("lam"), "lam_mean"), r6(F.corr("lam", "real"), "corr"), r6(F.regr_slope("lam", "real"), "slope"), r6(F.avg(F.abs(F.col("lam") - F.col("real"))), "error")
    )
    days = rows.select("label", "t").distinct()
    size = days.groupBy("label").agg(F.floor(F.count("*") / 2).alias("half"), F.count("*").alias("days"))
    placed = split.permuted(days, "t", 11, ["label"]).join(F.broadcast(size), "label").where("place < 2 * half")  # a row a label
    sides = rows.join(placed.select("label", "t", (F.col("place") >= F.col("half")).cast("int").alias("side")), ["label", "t"])
    halves = dependence.tail_dependence(dependence.pseudo_obs(sides, ["label", "side"]), q, by=["label", "side"])
    floor = halves.groupBy("label", "i", "j").agg(F.abs(F.max("lam") - F.min("lam")).alias("d")).groupBy("label").agg(r6(F.avg("d"), "floor"))
    cells = rows.withColumn("key", F.concat_ws("/", F.col("j").cast("string"), F.col("t").cast("string")))
    mixed = split.permuted(cells, "key", 13, ["label", "j"]).select("label", F.col("place").alias("t"), "j", "x")
    null = dependence.tail_dependence(dependence.pseudo_obs(mixed, ["label"]), q, by=["label"])
    null = null.join(real, ["i", "j"]).groupBy("label").agg(r6(F.regr_slope("lam", "real"), "null_slope"))
    loss = rows.groupBy("label", "t").agg(F.round(-F.sum("x") / F.count("*"), 10).alias("loss"))
    tail = risk.var_cvar(loss, [0.995], by=["label"]).select("label", r8("var"), r8("cvar"))
    return size.drop("half").join(fit, "label").join(floor, "label").join(null, "label").join(tail, "label")


def spread_pairs(spark, sf):
    """Five pairs spread evenly over the ranking by tail dependence."""
    ranked = lam_of(rounded(spark, sf)).withColumn("lam", F.round("lam", 10))
    ranked = ranked.withColumn("k", F.row_number().over(Window.orderBy("lam", "i", "j")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))  # a row for each pair of features
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (F.col("n") - 1) / 4))
    return ranked.where(F.array_contains(picks, F.col("k").cast("long"))).select("i", "j", r8("lam"))


def dependent_group(spark, sf):
    """The strongest pair and then, one by one, the feature most dependent on those chosen."""
    return dependence.dependent_group(lam_of(rounded(spark, sf)).withColumn("lam", F.round("lam", 10)), 4)


def ranked_windows(spark, sf):
    loss = risk.window_losses(train_windows(spark, sf), HORIZON).withColumn("loss", F.round("loss", 10))
    return loss.withColumn("k", F.row_number().over(Window.orderBy("loss", "w")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))  # a row for each window of dates


def matched_windows(spark, sf):
    """Windows at given ranks by loss, and the five worst."""
    ranked = ranked_windows(spark, sf)
    at = F.array(*[F.struct(F.lit(q).alias("q"), F.floor(F.lit(q) * (F.col("n") - 1)).alias("at")) for q in PICKS])
    chosen = ranked.withColumn("pick", F.explode(at)).where("k = pick.at").select(F.lit("rank").alias("side"), F.round("pick.q", 6).alias("q"), "w", r8("loss"))
    worst = ranked.where("k >= n - 5").select(F.lit("worst").alias("side"), F.lit(None).cast("double").alias("q"), "w", r8("loss"))
    return chosen.unionByName(worst)


def seeded_sample(spark, sf):
    """A hundred dates, the same ones whatever the partitions."""
    days = rets(spark, sf).select("t", "d").distinct()
    return days.orderBy(uniform(F.concat(F.lit("5:"), F.col("t").cast("string"))), "t").limit(100)


def pooled_density(spark, sf):
    """Densities of earlier and later rows over bins that both share."""
    r = rounded(spark, sf)
    r = r.withColumn("side", F.when(first_four_fifths(r), "early").otherwise("late"))
    range_ = r.groupBy("j").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    n = r.groupBy("j", "side").agg(F.count("*").alias("n"))
    bins = r.join(range_, "j").withColumn("bin", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 119), F.lit(118)))
    each = bins.groupBy("j", "side", "bin", "lo", "hi").agg(F.count("*").alias("count")).join(n, ["j", "side"])
    return each.select("j", "side", "bin", "count", r6(F.col("count") / F.col("n") / ((F.col("hi") - F.col("lo")) / 119), "density"))


def eps_diagnostics(spark, sf):
    """Standardised returns of earlier and later rows: the equal-weight sum's law, the mean correlation of pairs, and how the size of the sum varies between stretches of a window's length."""
    e = vol_queries.standardised_returns(spark, sf).withColumnRenamed("e", "x")
    e = e.withColumn("side", F.when(first_four_fifths(e), "train").otherwise("held out"))
    p = e.groupBy("side", "t").agg(F.avg("x").alias("p"))
    law = p.groupBy("side").agg(r6(F.stddev_pop("p"), "sd"), r6(F.percentile("p", F.lit(0.01)), "q01"), r6(F.percentile("p", F.lit(0.05)), "q05"), r6(F.kurtosis("p") + 3, "kurtosis"))
    pairs = e.select("side", "t", F.col("j").alias("i"), F.col("x").alias("a")).join(e.select("t", "j", F.col("x").alias("b")), "t").where("i < j")
    mean = pairs.groupBy("side", "i", "j").agg(F.corr("a", "b").alias("c")).groupBy("side").agg(r6(F.avg("c"), "mean_corr"))
    rms = p.groupBy("side", F.floor(F.col("t") / N).alias("w")).agg(F.sqrt(F.avg(F.col("p") * F.col("p"))).alias("rms")).groupBy("side").agg(r6(F.stddev_pop("rms"), "rms_sd"))
    return law.join(mean, "side").join(rms, "side")


def corr_and_level(spark, sf):
    """How the mean correlation of pairs moves with the level of volatility at the same date."""
    both = vol_queries.rolling_mean_corr(spark, sf).join(vol_queries.relative_vol(spark, sf), "t")
    return both.agg(F.count("*").alias("n"), r6(F.stddev_pop("c"), "sd"), r6(F.corr("c", F.ln("level")), "corr"))


def level_moments(spark, sf):
    """Returns near a level of each instrument's volatility: all days of it, and the first days of training windows that start there."""
    u = vol_queries.vol_percentile_u(spark, sf).withColumn("level", F.explode(F.array(*[F.lit(v) for v in LEVELS_U]))).where("abs(u - level) <= 0.05").select("t", "j", "level")
    days = pnl(spark, sf).select("t", "r")
    starts = train_windows(spark, sf).where("k = 0").select(F.col("w").alias("t")).distinct()
    near = u.join(days, "t")
    both = near.withColumn("side", F.lit("days")).unionByName(near.join(starts, "t").withColumn("side", F.lit("windows")))
    return both.groupBy("side", "j", "level").agg(F.count("*").alias("n"), r6(F.avg("r"), "mean"), r6(F.stddev_pop("r"), "sd"), r6(-F.percentile("r", F.lit(0.05)), "var95"), r6(-F.percentile("r", F.lit(0.01)), "var99"))


def leading_marginals(spark, sf):
    """t, j, x, u, late: marginals learned from the leading rows alone, for all rows. Written once."""
    ship(spark)

    def build():
        r = rounded(spark, sf)
        lead = r.where(first_four_fifths(r))
        u = tails.marginal_cdf(r, tails.zhang_stephens(tails.exceedances(lead), ["j", "side"]), sample=lead)
        return u.join(r.select("t", "j", "x", (~first_four_fifths(r)).alias("late")), ["t", "j"])

    return kept(spark, "leading-marginals", [f"{sf}/lineitem.parquet"], build)


def pit_report(spark, sf):
    """Fit of the marginals by feature, to the rows they were learned from and to the later ones, the worst of the later first."""
    u = leading_marginals(spark, sf)
    ks = lambda rows, name: dependence.ks_uniform(rows).select("j", r6("ks", f"ks_{name}"), r6(ks_p("ks", "n"), f"p_{name}"))
    ad = lambda rows, name: dependence.anderson_darling(rows).select("j", F.round("ad", 3).alias(f"ad_{name}"))
    early, late = u.where("NOT late"), u.where("late")
    ends = early.groupBy("j").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    beyond = late.join(ends, "j").groupBy("j").agg(F.count_if((F.col("x") < F.col("lo")) | (F.col("x") > F.col("hi"))).alias("n_beyond"))
    whole = ks(early, "train").join(ks(late, "test"), "j").join(ad(early, "train"), "j").join(ad(late, "test"), "j").join(beyond, "j")
    return whole.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ad_test"), "j")))  # a row for each feature


def pit_extremes(spark, sf):
    """The largest Student-t score (five degrees of freedom) of each feature's earlier and later rows, and the verdict of the validator; no SQL has the quantile function."""

    @F.pandas_udf("double")
    def score(u):
        return pd.Series(t_ppf(np.clip(u.to_numpy(), 1e-12, 1 - 1e-12), 5.0))

    z = leading_marginals(spark, sf).withColumn("z", F.abs(score("u")))
    per = z.groupBy("j").agg(F.max(F.when(~F.col("late"), F.col("z"))).alias("z_train"), F.max(F.when(F.col("late"), F.col("z"))).alias("z_test"))
    return per.withColumn("verdict", F.when(F.col("z_train") > 100, "fail").when(F.col("z_train") > 50, "warn").otherwise("pass"))


def panel_validation(spark, sf):
    """The validator over prices, returns and fitted marginals: rule, severity, value, passed. Scores are Student-t with four degrees of freedom, whose quantiles have a closed form."""
    prices, r = lineitem_panel(spark, sf), rounded(spark, sf)
    exc = tails.exceedances(r)
    fits = tails.zhang_stephens(exc, ["j", "side"])
    u = tails.marginal_cdf(r, fits).withColumn("z", F.abs(tails.student4(F.least(F.greatest("u", F.lit(1e-12)), F.lit(1 - 1e-12)))))
    per = u.groupBy("j").agg(F.max("z").alias("z"))
    name = F.col("valor").cast("string")
    rule = lambda name, severity, value, passed: F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.round(value.cast("double"), 4).alias("value"), passed.alias("passed"))
    parts = [
        prices.agg(F.count_if(F.coalesce(name, F.lit("")) == "").alias("a"), F.count_distinct(F.when(name.rlike(r"^[0-9.\-]+$"), name)).alias("b"), F.count_if(F.col("value") <= 0).alias("c"), F.avg(F.abs("value")).alias("d"))
        .select(F.array(rule("names", "fail", F.col("a"), F.col("a") == 0), rule("numeric names", "warn", F.col("b"), F.col("b") == 0), rule("positive prices", "fail", F.col("c"), F.col("c") == 0), rule("price level", "warn", F.col("d"), F.col("d") >= 0.5)).alias("r")),
        r.agg(F.count_if(F.col("x").isNull() | F.isnan("x") | (F.abs("x") == float("inf"))).alias("a"), F.avg(F.abs("x")).alias("b"), F.max(F.abs("x")).alias("c"))
        .select(F.array(rule("finite", "fail", F.col("a"), F.col("a") == 0), rule("mean size", "fail", F.col("b"), F.col("b") <= 1), rule("largest", "warn", F.col("c"), F.col("c") <= 1)).alias("r")),
        fits.agg(F.min("n").alias("a"), F.count("*").alias("b"), F.count_if(F.col("xi") > 1).alias("c"), F.count_if(F.col("xi") < 0).alias("d"))
        .select(F.array(rule("exceedances", "fail", F.col("a"), F.col("a") >= tails.LEAST), rule("fits", "fail", F.col("b"), F.col("b") > 0), rule("shapes over 1", "warn", F.col("c"), F.col("c") == 0), rule("shapes under 0", "info", F.col("d"), F.lit(True))).alias("r")),
        per.agg(F.max("z").alias("a"), F.count_if(F.col("z") > 100).alias("b"), F.count_if((F.col("z") > 50) & (F.col("z") <= 100)).alias("c"))
        .select(F.array(rule("largest score", "info", F.col("a"), F.lit(True)), rule("scores over 100", "fail", F.col("b"), F.col("b") == 0), rule("scores over 50", "warn", F.col("c"), F.col("c") == 0)).alias("r")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(F.inline("r"))


def coverage_exhibits(spark, sf):
    """For the held-out days and failures of each year and level: the coverage ratio, the failures that are not rejected, and the largest sample in which so many failures still reject."""
    year = rets(spark, sf).select("t", F.year("d").alias("year")).distinct()
    cases = vol_queries.scored(spark, sf).join(year, "t").groupBy("year", "alpha").agg(F.count("*").alias("n"), F.count_if("exc").cast("int").alias("x")).withColumn("p", F.round("alpha", 6))
    region = coverage.pf_region(cases.select("n", "p").distinct())
    most = coverage.pf_max_n(cases.where("x > 0").select("x", "p").distinct()).withColumnRenamed("n", "max_n")
    lr = pf_lr(F.col("x"), F.col("n"), F.col("p"))
    return cases.join(region, ["n", "p"], "left").join(most, ["x", "p"], "left").select("year", "p", "n", "x", r6(lr, "lr"), "lo", "hi", "max_n")


#: Queries that the full report puts together: what each row is known by, and its numbers.
REPORT = {
    "hill_index": (["j", "side"], ["alpha"]), "tail_dep_matrix": (["i", "j"], ["lower", "upper"]), "tail_dep_curve_top": (["i", "j", "q"], ["lam"]),
    "marginal_var_cvar": (["j", "level"], ["var", "cvar"]), "sq_acf": (["j", "lag"], ["acf"]),
}


def full_report(spark, sf):
    """All diagnostics of the returns in one long table: section, key, measure, value."""
    out = None
    for name, (keys, measures) in REPORT.items():
        query = next(p.QUERIES[name] for p in (diag_queries, tail_queries, risk_queries) if name in p.QUERIES)
        key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        part = query(spark, sf).select(key.alias("key"), *measures).unpivot("key", measures, "measure", "value").select(F.lit(name).alias("section"), "key", "measure", "value")
        out = part if out is None else out.unionByName(part)
    return out


def band_labels(spark, sf):
    """The band of levels that labels name, where all those of a set name the same."""
    sets = spark.createDataFrame(SETS, "g int, label string")
    level = F.regexp_extract("label", r"_u(\d*\.\d+)", 1).try_cast("double")
    per = sets.groupBy("g").agg(F.count("*").alias("n"), F.count(level).alias("named"), F.countDistinct(level).alias("levels"), F.max(level).alias("u"))
    one = (F.col("named") == F.col("n")) & (F.col("levels") == 1)
    return per.select("g", F.when(one, F.round(F.greatest(F.col("u") - 0.05, F.lit(0.0)), 8)).alias("lo"), F.when(one, F.round(F.least(F.col("u") + 0.05, F.lit(1.0)), 8)).alias("hi"))


SETS = [(0, "windows_u0.90"), (0, "other_u0.90"), (1, "windows_u0.10"), (1, "windows_u0.90"), (2, "windows"), (3, "windows_u0.50"), (3, "plain"), (4, "low_u.02")]

QUERIES = {f.__name__: f for f in (
    coverage_pvalues, es_test_records, ks_pvalues, rejection_rates, pair_slope, half_split_floor, run_summary, spread_pairs, dependent_group, matched_windows, seeded_sample, pooled_density,
    eps_diagnostics, corr_and_level, level_moments, pit_report, pit_extremes, panel_validation, coverage_exhibits, full_report, band_labels,
)}


def chi2_sql(x: str) -> str:
    """By the series of the error function; beyond 60 nothing is left of it."""
    term = f"exp(k * ln(greatest({x}, 1e-300::DOUBLE)) - (lgamma(2 * k + 2.0::DOUBLE) - k * ln(2.0::DOUBLE) - lgamma(k + 1.0::DOUBLE)))"
    return f"(CASE WHEN {x} > 60 THEN 0.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * exp(-greatest({x}, 0) / 2) * sqrt(greatest({x}, 0) / 2) * list_sum([{term} FOR k IN range(0, 250)]) END)"


def ks_p_sql(d: str, n: str) -> str:
    z = f"((sqrt({n}) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt({n})) * {d})"
    return f"(CASE WHEN {z} < 0.2 THEN 1.0::DOUBLE ELSE greatest(least(2 * list_sum([(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * {z} * {z} * k * k) FOR k IN range(1, 101)]), 1), 0) END)"


def hashed_sql(seed: str, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496)"


def fit_sql(src: str, name: str) -> str:
    """Distances of uniform numbers u of each feature j."""
    return f"{name} AS (SELECT j, count(*) AS n, max(greatest(i / n::DOUBLE - u, u - (i - 1) / n::DOUBLE)) AS ks, -any_value(n) - sum((2 * i - 1) * ln(least(greatest(u, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)) + (2 * n + 1 - 2 * i) * ln(1 - least(greatest(u, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE))) / any_value(n) AS ad FROM (SELECT j, u, row_number() OVER (PARTITION BY j ORDER BY u) AS i, count(*) OVER (PARTITION BY j) AS n FROM {src}) GROUP BY j)"


_ks = f"{BASE}, {diag_queries.RANKS}, {fit_sql('ranks', 'fit')} SELECT j, n, round(ks, 6) AS ks, round({ks_p_sql('ks', 'n')}, 6) AS p FROM fit"
_cases = "cases AS (SELECT DISTINCT n, alpha AS p FROM cnt)"
_cut = "(SELECT CAST(floor((1.0::DOUBLE - 0.2::DOUBLE) * (max(t) + 1)) AS BIGINT) FROM src)"
_picks = ", ".join(f"{q!r}::DOUBLE" for q in PICKS)
_sets = ", ".join(f"({g}, '{s}')" for g, s in SETS)

def report_sql() -> str:
    parts = []
    for name, (keys, measures) in REPORT.items():
        sql = next(p.SQL[name] for p in (diag_queries, tail_queries, risk_queries) if name in p.SQL)
        key = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
        parts += [f"SELECT '{name}' AS section, {key} AS key, '{m}' AS measure, {m} AS value FROM ({sql})" for m in measures]
    return " UNION ALL ".join(parts)


SQL = {
    "coverage_pvalues": f"{PNL}, {CUT}, {LEVELS}, {LAW}, {VARES}, cnt AS (SELECT alpha, count(*) AS n, count_if(r + var < 0) AS f, min(t) FILTER (r + var < 0) - min(t) + 1 AS v FROM test, vares GROUP BY alpha), {_cases}, {PMF.format(p='p')}, "
    f"tails AS (SELECT alpha, sum(pmf) FILTER (x >= f) AS up, sum(pmf) FILTER (x <= f) AS low FROM cnt JOIN pmf ON cnt.n = pmf.n AND cnt.alpha = pmf.p GROUP BY alpha), lrs AS (SELECT *, {pf_sql('f', 'n', 'alpha')} AS pf, {tuff_sql('v', 'alpha')} AS tuff FROM cnt JOIN tails USING (alpha)) "
    f"SELECT round(alpha, 8) AS alpha, n, f AS failures, round(f / n, 8) AS rate, round(pf, 6) AS pf, round({chi2_sql('pf')}, 8) AS pf_p, round(coalesce(up, 0), 8) AS p_upper, round(coalesce(low, 0), 8) AS p_lower, v IS NULL AS censored, round(tuff, 6) AS tuff, CASE WHEN v IS NOT NULL THEN round({chi2_sql('tuff')}, 8) END AS tuff_p FROM lrs",
    "es_test_records": f"WITH z AS ({vol_queries.SQL['z1_z2']}) SELECT alpha, n, n_exc, round(n * alpha, 6) AS expected, 'Z1' AS test, CASE WHEN n_exc > 0 THEN z1 END AS statistic, n_exc > 0 AS defined, CASE WHEN n_exc > 0 THEN '' ELSE 'no exception' END AS reason FROM z UNION ALL SELECT alpha, n, n_exc, round(n * alpha, 6), 'Z2', CASE WHEN n > 0 THEN z2 END, n > 0, CASE WHEN n > 0 THEN '' ELSE 'no observation' END FROM z",
    "ks_pvalues": _ks,
    "rejection_rates": f"{PNL}, {CUT}, {LEVELS}, {LAW}, {VARES}, v AS (SELECT alpha, strftime(d, '%Y-%m') AS month, min(t) FILTER (r + var < 0) - min(t) + 1 AS v FROM test, vares GROUP BY 1, 2), l AS (SELECT alpha, {tuff_sql('v', 'alpha')} AS tuff FROM v), p AS (SELECT alpha, CASE WHEN tuff IS NOT NULL THEN {chi2_sql('tuff')} END AS p FROM l) SELECT round(alpha, 8) AS alpha, round(avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END), 8) AS all_tests, round(avg(CAST(p < 0.05 AS INT)), 8) AS defined_tests, count(*) AS tests, count(p) AS defined FROM p GROUP BY 1",
    "pair_slope": f"{BASE}, {R10}, {obs('o', f't < {EARLY}')}, {obs('o2', f't >= {EARLY}')} SELECT count(*) AS pairs, round(avg(a.lam), 6) AS mean, round(corr(a.lam, b.lam), 6) AS corr, round(regr_slope(b.lam, a.lam), 6) AS slope, round(avg(abs(b.lam - a.lam)), 6) AS error FROM {lam('o', '0.1')} a JOIN {lam('o2', '0.1')} b USING (i, j)",
    "half_split_floor": f"{BASE}, {R10}, placed AS (SELECT t, row_number() OVER (ORDER BY {hashed_sql('11', 't')}, t) - 1 AS place, count(*) OVER () // 2 AS half FROM (SELECT DISTINCT t FROM ret10)), side0 AS (SELECT t FROM placed WHERE place < half), side1 AS (SELECT t FROM placed WHERE place >= half AND place < 2 * half), {obs('o', 't IN (SELECT t FROM side0)')}, {obs('o2', 't IN (SELECT t FROM side1)')} SELECT count(*) AS pairs, round(avg(abs(a.lam - b.lam)), 6) AS floor FROM {lam('o', '0.1')} a JOIN {lam('o2', '0.1')} b USING (i, j)",
    "run_summary": f"{PNL}, {vol_queries.REG}, {R10}, {SPLIT}, lab AS (SELECT 'all' AS label, ret10.* FROM ret10 JOIN rows_ USING (t) WHERE NOT is_test UNION ALL SELECT 'quiet', ret10.* FROM ret10 JOIN rows_ USING (t) JOIN reg USING (t) WHERE NOT is_test AND regime < 2), "
    f"{obs('ro', 't IN (SELECT t FROM rows_ WHERE is_test)')}, realv AS {lam('ro', '0.1')}, days AS (SELECT label, t, row_number() OVER (PARTITION BY label ORDER BY {hashed_sql('11', 't')}, t) - 1 AS place, count(*) OVER (PARTITION BY label) AS days FROM (SELECT DISTINCT label, t FROM lab)), "
    f"hv AS (SELECT label, t, CASE WHEN place >= days // 2 THEN 1 ELSE 0 END AS side FROM days WHERE place < 2 * (days // 2)), mixed AS (SELECT label, j, x, row_number() OVER (PARTITION BY label, j ORDER BY {hashed_sql('13', f"(j || '/' || t)")}, j || '/' || t) - 1 AS t FROM lab), "
    f"sets AS (SELECT label || '/own' AS s, t, j, x FROM lab UNION ALL SELECT label || '/' || side, t, j, x FROM lab JOIN hv USING (label, t) UNION ALL SELECT label || '/null', t, j, x FROM mixed), u AS (SELECT s, t, j, row_number() OVER (PARTITION BY s, j ORDER BY x, t) / (count(*) OVER (PARTITION BY s, j) + 1.0::DOUBLE) < 0.1 AS h FROM sets), "
    "l AS (SELECT split_part(a.s, '/', 1) AS label, split_part(a.s, '/', 2) AS part, a.j AS i, b.j AS j, count_if(a.h AND b.h)::DOUBLE / count(*) / 0.1::DOUBLE AS lam FROM u a JOIN u b ON a.s = b.s AND a.t = b.t AND a.j < b.j GROUP BY ALL), "
    "fit AS (SELECT label, round(avg(l.lam), 6) AS lam_mean, round(corr(l.lam, r.lam), 6) AS corr, round(regr_slope(l.lam, r.lam), 6) AS slope, round(avg(abs(l.lam - r.lam)), 6) AS error FROM l JOIN realv r USING (i, j) WHERE part = 'own' GROUP BY label), "
    "nul AS (SELECT label, round(regr_slope(l.lam, r.lam), 6) AS null_slope FROM l JOIN realv r USING (i, j) WHERE part = 'null' GROUP BY label), flo AS (SELECT label, round(avg(d), 6) AS floor FROM (SELECT label, i, j, max(lam) - min(lam) AS d FROM l WHERE part IN ('0', '1') GROUP BY ALL) GROUP BY label), "
    "loss AS (SELECT label, t, round(-sum(x) / count(*), 10) AS loss FROM lab GROUP BY label, t), va AS (SELECT label, quantile_cont(loss, 0.995::DOUBLE) AS var FROM loss GROUP BY label), tl AS (SELECT label, round(var, 8) AS var, round(avg(loss), 8) AS cvar FROM loss JOIN va USING (label) WHERE loss >= var GROUP BY label, var), dn AS (SELECT label, any_value(days) AS days FROM days GROUP BY label) "
    "SELECT * FROM dn JOIN fit USING (label) JOIN flo USING (label) JOIN nul USING (label) JOIN tl USING (label)",
    "spread_pairs": f"{BASE}, {R10}, {obs('o')}, ranked AS (SELECT i, j, lam, row_number() OVER (ORDER BY round(lam, 10), i, j) - 1 AS k, count(*) OVER () AS n FROM {lam('o', '0.1')}) SELECT i, j, round(lam, 8) AS lam FROM ranked WHERE list_contains([CAST(floor(g * (n - 1) / 4.0::DOUBLE) AS BIGINT) FOR g IN range(0, 5)], k)",
    "matched_windows": f"{BASE}, {SPLIT}, {STARTS}, {WINDOWS}, losses AS (SELECT w, round(-sum(x) / count(DISTINCT j), 10) AS loss FROM wins WHERE k < {HORIZON} GROUP BY w), ranked AS (SELECT w, loss, row_number() OVER (ORDER BY loss, w) - 1 AS k, count(*) OVER () AS n FROM losses) SELECT 'rank' AS side, round(q, 6) AS q, w, round(loss, 8) AS loss FROM ranked, (SELECT unnest([{_picks}]) AS q) WHERE k = floor(q * (n - 1)) UNION ALL SELECT 'worst', NULL, w, round(loss, 8) FROM ranked WHERE k >= n - 5",
    "seeded_sample": f"{BASE} SELECT t, d FROM (SELECT DISTINCT t, d FROM ret) ORDER BY {hashed_sql('5', 't')}, t LIMIT 100",
    "pooled_density": f"{BASE}, {R10}, s AS (SELECT j, x, CASE WHEN t < {EARLY} THEN 'early' ELSE 'late' END AS side, min(x) OVER (PARTITION BY j) AS lo, max(x) OVER (PARTITION BY j) AS hi FROM ret10), b AS (SELECT j, side, lo, hi, least(CAST(floor((x - lo) / (hi - lo) * 119) AS BIGINT), 118) AS bin, count(*) OVER (PARTITION BY j, side) AS n FROM s) SELECT j, side, bin, count(*) AS count, round(count(*) / any_value(n) / ((any_value(hi) - any_value(lo)) / 119), 6) AS density FROM b GROUP BY j, side, bin",
    "eps_diagnostics": f"WITH src AS ({vol_queries.SQL['standardised_returns']}), e AS (SELECT t, j, e AS x, CASE WHEN t < {_cut} THEN 'train' ELSE 'held out' END AS side FROM src), p AS (SELECT side, t, avg(x) AS p FROM e GROUP BY ALL), law AS (SELECT side, round(stddev_pop(p), 6) AS sd, round(quantile_cont(p, 0.01::DOUBLE), 6) AS q01, round(quantile_cont(p, 0.05::DOUBLE), 6) AS q05, round(kurtosis_pop(p) + 3, 6) AS kurtosis FROM p GROUP BY side), c AS (SELECT a.side, corr(a.x, b.x) AS c FROM e a JOIN e b ON a.t = b.t AND a.j < b.j GROUP BY a.side, a.j, b.j) SELECT law.*, m.mean_corr, q.rms_sd FROM law JOIN (SELECT side, round(avg(c), 6) AS mean_corr FROM c GROUP BY side) m USING (side) JOIN (SELECT side, round(stddev_pop(rms), 6) AS rms_sd FROM (SELECT side, t // {N} AS w, sqrt(avg(p * p)) AS rms FROM p GROUP BY 1, 2) GROUP BY side) q USING (side)",
    "corr_and_level": f"WITH c AS ({vol_queries.SQL['rolling_mean_corr']}), v AS ({vol_queries.SQL['relative_vol']}) SELECT count(*) AS n, round(stddev_pop(c), 6) AS sd, round(corr(c, ln(level)), 6) AS corr FROM c JOIN v USING (t)",
    "level_moments": f"{PNL}, {SPLIT}, {STARTS}, us AS (SELECT t, j, unnest([{', '.join(f'{v}::DOUBLE' for v in LEVELS_U)}]) AS level, u FROM ({vol_queries.SQL['vol_percentile_u']})), near AS (SELECT pnl.t, j, level, r FROM us JOIN pnl USING (t) WHERE abs(u - level) <= 0.05::DOUBLE), b AS (SELECT 'days' AS side, * FROM near UNION ALL SELECT 'windows', * FROM near WHERE t IN (SELECT t FROM starts)) SELECT side, j, level, count(*) AS n, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS sd, round(-quantile_cont(r, 0.05::DOUBLE), 6) AS var95, round(-quantile_cont(r, 0.01::DOUBLE), 6) AS var99 FROM b GROUP BY side, j, level",
    "pit_report": f"{BASE}, ret10 AS (SELECT t, j, round(x, 10) AS x FROM ret), lead10 AS (SELECT * FROM ret10 WHERE t < {EARLY}), th10 AS (SELECT j, quantile_cont(x, 0.05::DOUBLE) AS u_lo, quantile_cont(x, 1 - 0.05::DOUBLE) AS u_hi FROM lead10 GROUP BY j), "
    f"knots AS (SELECT j, x, min(p) AS p FROM (SELECT j, x, (row_number() OVER (PARTITION BY j ORDER BY x) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY j) AS p FROM lead10) JOIN th10 USING (j) WHERE x BETWEEN u_lo AND u_hi GROUP BY j, x), "
    f"exc AS (SELECT j, 'lower' AS side, u_lo - x AS y FROM lead10 JOIN th10 USING (j) WHERE x < u_lo UNION ALL SELECT j, 'upper', x - u_hi FROM lead10 JOIN th10 USING (j) WHERE x > u_hi), {zs_sql('j, side')}, {cdf_sql('fits')}, "
    f"tr AS (SELECT j, u FROM cdf WHERE t < {EARLY}), te AS (SELECT j, u FROM cdf WHERE t >= {EARLY}), {fit_sql('tr', 'f1')}, {fit_sql('te', 'f2')}, ends AS (SELECT j, min(x) AS lo, max(x) AS hi FROM lead10 GROUP BY j), beyond AS (SELECT j, count_if(x < lo OR x > hi) AS n_beyond FROM ret10 JOIN ends USING (j) WHERE t >= {EARLY} GROUP BY j) "
    f"SELECT j, round(f1.ks, 6) AS ks_train, round({ks_p_sql('f1.ks', 'f1.n')}, 6) AS p_train, round(f2.ks, 6) AS ks_test, round({ks_p_sql('f2.ks', 'f2.n')}, 6) AS p_test, round(f1.ad, 3) AS ad_train, round(f2.ad, 3) AS ad_test, n_beyond, row_number() OVER (ORDER BY round(f2.ad, 3) DESC, j) AS place FROM f1 JOIN f2 USING (j) JOIN beyond USING (j)",
    "panel_validation": f"{BASE}, {R10}, exc AS (SELECT j, 'lower' AS side, u_lo - x AS y FROM ret10 JOIN th10 USING (j) WHERE x < u_lo UNION ALL SELECT j, 'upper', x - u_hi FROM ret10 JOIN th10 USING (j) WHERE x > u_hi), {zs_sql('j, side')}, {cdf_sql('fits')}, "
    "pz AS (SELECT j, max(abs(sign(p - 0.5) * 2.0 * sqrt(greatest(cos(acos(least(sqrt(4.0 * p * (1.0 - p)), 1.0)) / 3.0) / sqrt(4.0 * p * (1.0 - p)) - 1.0, 0.0)))) AS z FROM (SELECT j, least(greatest(u, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) AS p FROM cdf) GROUP BY j), "
    "v AS (SELECT count_if(valor IS NULL) AS a, count(DISTINCT valor) AS b, count_if(value <= 0) AS c, avg(abs(value)) AS d FROM p1), w AS (SELECT count_if(x IS NULL OR isnan(x) OR isinf(x)) AS a, avg(abs(x)) AS b, max(abs(x)) AS c FROM ret10), f AS (SELECT min(n) AS a, count(*) AS b, count_if(xi > 1) AS c, count_if(xi < 0) AS d FROM fits), g AS (SELECT max(z) AS a, count_if(z > 100) AS b, count_if(z > 50 AND z <= 100) AS c FROM pz), "
    "rules AS (SELECT 'names' AS rule, 'fail' AS severity, a::DOUBLE AS value, a = 0 AS passed FROM v UNION ALL SELECT 'numeric names', 'warn', b, b = 0 FROM v UNION ALL SELECT 'positive prices', 'fail', c, c = 0 FROM v UNION ALL SELECT 'price level', 'warn', d, d >= 0.5 FROM v UNION ALL SELECT 'finite', 'fail', a, a = 0 FROM w UNION ALL SELECT 'mean size', 'fail', b, b <= 1 FROM w UNION ALL SELECT 'largest', 'warn', c, c <= 1 FROM w "
    "UNION ALL SELECT 'exceedances', 'fail', a, a >= 5 FROM f UNION ALL SELECT 'fits', 'fail', b, b > 0 FROM f UNION ALL SELECT 'shapes over 1', 'warn', c, c = 0 FROM f UNION ALL SELECT 'shapes under 0', 'info', d, true FROM f UNION ALL SELECT 'largest score', 'info', a, true FROM g UNION ALL SELECT 'scores over 100', 'fail', b, b = 0 FROM g UNION ALL SELECT 'scores over 50', 'warn', c, c = 0 FROM g) SELECT rule, severity, round(value, 4) AS value, passed FROM rules",
    "full_report": report_sql(),
    "coverage_exhibits": f"{PNL}, {CUT}, {LEVELS}, {LAW}, {VARES}, c AS (SELECT CAST(year(d) AS INT) AS year, round(alpha, 6) AS p, count(*) AS n, CAST(count_if(r + var < 0) AS INT) AS x FROM test, vares GROUP BY 1, alpha), xs AS (SELECT *, unnest(range(0, n + 1)) AS q FROM (SELECT DISTINCT n, p FROM c)), reg AS (SELECT n, p, CAST(min(q) AS INT) AS lo, CAST(max(q) AS INT) AS hi FROM xs WHERE {pf_sql('q', 'n', 'p')} <= {CHI2_95}::DOUBLE GROUP BY n, p), "
    f"ns AS (SELECT *, unnest(range(x, 2001)) AS q FROM (SELECT DISTINCT x, p FROM c WHERE x > 0)), mx AS (SELECT x, p, CAST(max(q) AS INT) AS max_n FROM ns WHERE {pf_sql('x', 'q', 'p')} > {CHI2_95}::DOUBLE AND x / q > p GROUP BY x, p) SELECT year, p, n, x, round({pf_sql('x', 'n', 'p')}, 6) AS lr, lo, hi, max_n FROM c LEFT JOIN reg USING (n, p) LEFT JOIN mx USING (x, p)",
    "band_labels": f"WITH s AS (SELECT g, try_cast(regexp_extract(label, '_u([0-9]*\\.[0-9]+)', 1) AS DOUBLE) AS u FROM (VALUES {_sets}) v(g, label)), p AS (SELECT g, count(u) = count(*) AND count(DISTINCT u) = 1 AS one, max(u) AS u FROM s GROUP BY g) SELECT g, CASE WHEN one THEN round(greatest(u - 0.05, 0), 8) END AS lo, CASE WHEN one THEN round(least(u + 0.05, 1), 8) END AS hi FROM p",
}
