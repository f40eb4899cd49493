"""Studies over many random splits: placebo splits, volatility models, and conditional tests of one split."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.operators import conditional, dependence, generators, split, tails, vol, volmodels
from riskspark.session import ship
from riskspark.sources import sinks
from riskspark.sources.shared import kept, new_folder

from . import vol_queries
from .risk_queries import BLOCK, HORIZON, N, SPLIT, STARTS, WINDOWS, first_four_fifths, hashed_split, n_rows, pf_sql, pnl, r8, rets, train_windows
from .report_queries import chi2_sql, hashed_sql
from .sql import BASE, PNL

#: Tail probabilities, and the places of those that coverage and expected shortfall are tested at.
ALPHAS = [1.0 - 0.95, 1.0 - 0.975, 1.0 - 0.99]
COVERED, SHORT = [0, 2], [1, 2]
PLACEBO_SPLITS, PLACEBO_SIMS, PLACEBO_MODELS = 50, 2000, ["HS", "EWMA 0.94"]
MODEL_SPLITS, MODEL_SIMS, MODEL_NAMES = 20, 1000, ["EWMA 0.90", "EWMA 0.94", "EWMA 0.97"]
SEED = 17


def r5(c, name=None):
    return F.round(c, 5).alias(name or c)


def study(spark, sf, tag, splits, models, horizons, sims):
    """(laws, tests, flags) of random splits, each table written once."""
    ship(spark)
    source = [f"{sf}/lineitem.parquet"]
    rows = n_rows(rets(spark, sf))
    draws = kept(spark, f"{tag}-draws", source, lambda: split.drawn_blocks(spark, rows, BLOCK, 0.2, F.sequence(F.lit(0), F.lit(splits - 1))))
    marked = kept(spark, f"{tag}-flags", source, lambda: conditional.flags(draws, rows, BLOCK))
    dates = conditional.forecast_dates(draws, BLOCK, horizons)
    laws = kept(spark, f"{tag}-laws", source, lambda: conditional.laws(rets(spark, sf), pnl(spark, sf), marked, dates, models, ALPHAS, N))
    records = kept(spark, f"{tag}-tests", source, lambda: conditional.tests(laws, ALPHAS, sims, SEED, SHORT))
    return laws, records, marked


def chosen(records):
    """Coverage at the first and last level, expected shortfall at the last two."""
    wanted = F.when(F.col("test") == "PF", F.col("alpha").isin([ALPHAS[k] for k in COVERED])).otherwise(F.col("alpha").isin([ALPHAS[k] for k in SHORT]))
    return records.where(wanted)


def rates(records):
    out = conditional.rejection_rates(chosen(records), ["model", "h", "test", "alpha"])
    return out.select("model", "h", "test", r8("alpha"), "tests", "defined", r8("all_tests"), r8("defined_tests"), r5("median"))


def placebo(spark, sf):
    return study(spark, sf, "placebo", PLACEBO_SPLITS, PLACEBO_MODELS, [1], PLACEBO_SIMS)


def placebo_rates(spark, sf):
    """How often each test rejects over 50 random splits, for historical and filtered historical simulation, one step ahead."""
    return rates(placebo(spark, sf)[1])


def placebo_regimes(spark, sf):
    """Exception rates in calm, middle and stressed days, pooled over the splits."""
    laws, _, marked = placebo(spark, sf)
    found = conditional.regime_rates(laws, marked, volmodels.trailing_volatility(pnl(spark, sf)).withColumn("vol", F.round("vol", 10)), ALPHAS)
    return found.select("model", r8("alpha"), "regime", "days", "exceptions", r8(F.col("exceptions") / F.col("days"), "rate"))


def placebo_rates_h10(spark, sf):
    """The same ten steps ahead, the recursion run along each path of each date; a recursion for each of them has no SQL of reasonable size."""
    return rates(study(spark, sf, "placebo-h10", PLACEBO_SPLITS, PLACEBO_MODELS, [HORIZON], PLACEBO_SIMS)[1])


def compared(laws, records, marked, pnl_rows):
    """One row for each model and horizon: exception rates, loss over shortfall, persistence, regimes."""
    seen = conditional.observed(laws, ALPHAS)
    rate = lambda k, name: r8(F.sum(F.when(F.col("a") == k, F.col("n_exc"))) / F.sum(F.when(F.col("a") == k, F.col("n"))), name)
    pooled = seen.groupBy("model", "h").agg(rate(0, "exc95"), rate(2, "exc99"), r5(F.sum(F.when(F.col("a") == 1, F.col("loss"))) / F.sum(F.when(F.col("a") == 1, F.col("shortfall"))), "es_ratio"))
    again = conditional.persistence(laws, ALPHAS).where(F.col("alpha") == ALPHAS[0]).select("model", F.lit(1).alias("h"), r8(F.col("both") / F.greatest("before", F.lit(1)), "exc_after_exc"))
    vol = volmodels.trailing_volatility(pnl_rows).withColumn("vol", F.round("vol", 10))
    regimes = conditional.regime_rates(laws, marked, vol, ALPHAS).where(F.col("alpha") == ALPHAS[0])
    of = lambda k, name: r8(F.max(F.when(F.col("regime") == k, F.col("exceptions") / F.col("days"))), name)
    regimes = regimes.groupBy("model").agg(of(0, "calm95"), of(1, "middle95"), of(2, "stressed95")).withColumn("h", F.lit(1))
    return pooled.join(again, ["model", "h"], "left").join(regimes, ["model", "h"], "left")


def ewma_study(spark, sf):
    return study(spark, sf, "ewma", MODEL_SPLITS, MODEL_NAMES, [1], MODEL_SIMS)


def vol_model_rates(spark, sf):
    """Three decays of the exponential filter over 20 random splits: pooled exception rates, loss over shortfall, persistence of exceptions and rates by regime."""
    laws, records, marked = ewma_study(spark, sf)
    return compared(laws, records, marked, pnl(spark, sf))


def vol_model_tests(spark, sf):
    """How often each test rejects for each decay."""
    return rates(ewma_study(spark, sf)[1])


def vol_model_comparison(spark, sf):
    """All volatility models, the asymmetric one with its fit by split and instrument, one and ten steps ahead; the fit has no SQL."""
    laws, records, marked = study(spark, sf, "vol-models", MODEL_SPLITS, [*MODEL_NAMES, "GJR"], [1, HORIZON], MODEL_SIMS)
    tested = rates(records).groupBy("model", "h").agg(F.sort_array(F.collect_list(F.struct("test", "alpha", "defined", "defined_tests"))).alias("rejected"))
    return compared(laws, records, marked, pnl(spark, sf)).join(tested, ["model", "h"])


def conditional_es_tests(spark, sf):
    """The last fifth held out: coverage and all three tests of expected shortfall under the law of each date, with p-values of 2,000 simulations."""
    ship(spark)
    source = [f"{sf}/lineitem.parquet"]
    rows = n_rows(rets(spark, sf))
    cut = int((1.0 - 0.2) * rows)
    draws = spark.createDataFrame([(0, 0, cut)], "split long, b long, s long")
    marked = conditional.flags(draws, rows, rows - cut)
    dates = conditional.forecast_dates(draws, rows - cut, [1])
    laws = kept(spark, "late-laws", source, lambda: conditional.laws(rets(spark, sf), pnl(spark, sf), marked, dates, PLACEBO_MODELS, ALPHAS, 1))
    out = conditional.tests(laws, ALPHAS, PLACEBO_SIMS, SEED, SHORT)
    return out.select("model", r8("alpha"), "n", "n_exc", "test", r5("statistic"), r8("p"))


def labelled_backtest(spark, sf, windows, horizons, tag):
    """Tests of every label's laws on the held-out blocks of the drawn split, and coverage by the first failure."""
    made = hashed_split(spark, sf)
    draws = split.blocks_table(spark, made).select(F.lit(0).cast("long").alias("split"), "b", "s")
    known = conditional.forecast_dates(draws, made.block, horizons).join(conditional.horizon_sums(pnl(spark, sf), horizons), ["t", "h"])
    found = kept(spark, f"{tag}-laws", [f"{sf}/lineitem.parquet"], lambda: conditional.label_laws(windows, known, ALPHAS))
    each = conditional.forecasts(found)
    first = each.groupBy(*conditional.KEY, "a").agg((F.min(F.when(F.col("exc"), F.col("k"))) + 1).alias("first_failure"), F.first("var").alias("var"), F.first("es").alias("es"))
    records = conditional.tests(found, ALPHAS, PLACEBO_SIMS, SEED, SHORT)
    first = first.withColumn("alpha", conditional.per_level(ALPHAS)).drop("a")
    return records.join(first, [*conditional.KEY, "alpha"]).select(F.col("model").alias("label"), "h", r8("alpha"), r8("var"), r8("es"), "n", "n_exc", "first_failure", "test", r5("statistic"), r8("p"))


def historical_labels(spark, sf):
    """Two labels: all training windows, and those that start on calm or middle days."""
    w = train_windows(spark, sf)
    quiet = vol_queries.regimes(spark, sf).where("regime < 2").select(F.col("t").alias("w"))
    return generators.historical(w, "hs").unionByName(generators.historical(w.join(quiet, "w"), "hs_quiet"))


def label_backtest(spark, sf):
    """All tests for two labelled generators, ten steps ahead."""
    ship(spark)
    return labelled_backtest(spark, sf, historical_labels(spark, sf), [HORIZON], "labels-h10")


def generated(spark, sf):
    """Windows of every generator: history, and 5,000 of a Student-t source carried by a flow that has the training rows' means and covariance, mixed by window or by step. Written once."""
    ship(spark)

    def build():
        flags = split.split_rows(spark, hashed_split(spark, sf))
        train = rets(spark, sf).join(flags.where("NOT is_test").select("t"), "t")
        names, a, b = generators.fitted_flow(dependence.together(dependence.moments(train)))
        flow = [generators.flow_windows(spark, f"flow_{mix}", 5000, N, names, a, b, seed=SEED, mix=mix) for mix in ("window", "step")]
        return generators.historical(train_windows(spark, sf), "hs").unionByName(flow[0]).unionByName(flow[1])

    return kept(spark, "generated", [f"{sf}/lineitem.parquet"], build)


def generator_backtest(spark, sf):
    """All tests for every generator, one and ten steps ahead; numbers drawn by numpy have no SQL."""
    return labelled_backtest(spark, sf, generated(spark, sf), [1, HORIZON], "generators")


def generator_moments(spark, sf):
    """label, j: mean, sd, kurtosis and 1 % quantile of every generator's cells."""
    g = generated(spark, sf).groupBy("label", "j")
    return g.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), (F.kurtosis("x") + 3).alias("kurtosis"), F.percentile("x", F.lit(0.01)).alias("q01"))


def window_vectors(windows, scale):
    """w, v: each window as one vector, over the training rows' standard deviations."""
    cells = windows.join(F.broadcast(scale), "j").select("w", "k", "j", (F.col("x") / F.col("sd")).alias("x"))  # a row a feature
    return cells.groupBy("w").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "j", "x"))), lambda c: c["x"]).alias("v"))


def novelty_windows(spark, sf):
    """Distances to the nearest training window: of training windows to the others, of a bootstrap copy, and of the windows that touch held-out rows."""
    ship(spark)
    r, flags = rets(spark, sf), split.split_rows(spark, hashed_split(spark, sf))
    sd = r.join(flags.where("NOT is_test").select("t"), "t").groupBy("j").agg(F.stddev_pop("x").alias("sd")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    starts = split.window_starts(flags, N)
    every = flags.select("t").where(F.col("t") <= n_rows(r) - N)
    real = window_vectors(split.windows(r, starts, N), sd).select(F.col("w").alias("b"), "v")
    other = window_vectors(split.windows(r, every.join(starts, "t", "left_anti"), N), sd).select(F.lit("touching").alias("sample"), F.col("w").alias("q"), "v")
    count = starts.count()
    places = split.permuted(starts, "t", 0).select(F.col("t").alias("b"), "place")
    at = F.floor(conditional.uniform(F.concat(F.lit("novelty:"), F.col("id").cast("string"))) * count)
    copies = spark.range(count).select(F.col("id").alias("q"), at.alias("place")).join(places, "place").join(real, "b").select(F.lit("bootstrap").alias("sample"), "q", "v")
    found = dependence.novelty(other.unionByName(copies), real)
    return found.select("sample", "n", *[F.round(c, 4).alias(c) for c in ("median", "ratio", "least", "q05", "close")])


def mixture_recalibrated(spark, sf):
    """Standardised later returns, mapped so that the earlier ones have Student-t marginals with four degrees of freedom; beyond their range with the slope of their outer hundredth."""
    e = vol_queries.standardised_returns(spark, sf).withColumnRenamed("e", "x")
    lead = first_four_fifths(e)
    found = tails.recalibrated(e.where(~lead).select("t", "j", "x"), e.where(lead).select("j", "x"), tails.student4)
    return found.select("t", "j", "x", r5("y"))


def generated_store(spark, sf):
    """Two labels written with their split, read back under a guard that all were made under one, and counted."""
    base, made = new_folder(spark, "generated"), hashed_split(spark, sf)
    w = historical_labels(spark, sf)
    for label in ("hs", "hs_quiet"):
        sinks.write_generated(w.where(F.col("label") == label).drop("label"), made, f"{base}/{label}")
    again, one = sinks.read_generated(spark, [f"{label}={base}/{label}" for label in ("hs", "hs_quiet")], n_rows(rets(spark, sf)))
    return again.groupBy("label").agg(F.count_distinct("w").alias("windows"), F.count("*").alias("cells"), r5(F.sum("x"), "total")).withColumn("blocks", F.lit(len(one.test_starts)).cast("long"))


def market_rank(spark, sf):
    """t, u: rank of the market's relative volatility among the earlier rows."""
    level = vol_queries.relative_vol(spark, sf).withColumn("all", F.lit(1))
    return vol.percentile_rank(level, "level", first_four_fifths(level), ["all"]).select("t", F.round("u", 10).alias("u"), "level")


LEVELS_U = [0.1, 0.5, 0.9]


def level_labels(spark, sf):
    """Training windows under the label of each level that their first day is within 0.05 of."""
    at = F.explode(F.array(*map(F.lit, LEVELS_U)))
    near = market_rank(spark, sf).withColumn("level", at).where("abs(u - level) <= 0.05").select(F.col("t").alias("w"), F.concat(F.lit("hs_u"), F.format_string("%.2f", "level")).alias("label"))
    return train_windows(spark, sf).join(near, "w").select("label", "w", "k", "j", "x")


def band_windows(spark, sf):
    """The band of levels that each label names, the label's windows, and the days that lie in its band."""
    w = level_labels(spark, sf)
    found = generators.bands(w.select("label").distinct())
    days = market_rank(spark, sf).join(F.broadcast(found), F.col("u").between(F.col("lo"), F.col("hi"))).groupBy("label").agg(F.count("*").alias("days"))  # a row a label
    count = w.groupBy("label").agg(F.count_distinct("w").alias("windows"))
    return found.join(count, "label").join(days, "label").select("label", r8("lo"), r8("hi"), "windows", "days")


def moments_of(rows, by):
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), (-F.percentile("r", F.lit(0.05))).alias("var95"), (-F.percentile("r", F.lit(0.01))).alias("var99"))


def conditional_moments(spark, sf):
    """Days in the band of each level against the first days of windows generated for it: the flow, scaled by the volatility that the level stands for. Numpy's numbers have no SQL."""
    ship(spark)
    rank = market_rank(spark, sf)
    flags = split.split_rows(spark, hashed_split(spark, sf))
    e = vol_queries.standardised_returns(spark, sf).withColumnRenamed("e", "x").join(flags.where("NOT is_test").select("t"), "t")
    names, a, b = generators.fitted_flow(dependence.together(dependence.moments(e)))
    sigma = vol_queries.filtered(spark, sf).join(rank.select("t", "u"), "t")
    windows = None
    for level in LEVELS_U:
        near = sigma.where(F.abs(F.col("u") - level) <= 0.05).groupBy("j").agg(F.avg("sigma").alias("s"))
        one = generators.flow_windows(spark, f"flow_u{level:.2f}", 3000, 1, names, a, b, seed=SEED).join(F.broadcast(near), "j").select("label", "w", (F.col("x") * F.col("s")).alias("x"))  # a row a feature
        windows = one if windows is None else windows.unionByName(one)
    drawn = windows.groupBy("label", "w").agg(F.avg("x").alias("r"))
    found = generators.bands(drawn.select("label").distinct())
    real = rank.join(F.broadcast(found), F.col("u").between(F.col("lo"), F.col("hi"))).join(pnl(spark, sf), "t")  # a row a label
    return moments_of(real, ["label"]).withColumn("side", F.lit("days")).unionByName(moments_of(drawn, ["label"]).withColumn("side", F.lit("generated")))


QUERIES = {f.__name__: f for f in (placebo_rates, placebo_regimes, placebo_rates_h10, vol_model_rates, vol_model_tests, vol_model_comparison, conditional_es_tests, label_backtest, generator_backtest, generator_moments, novelty_windows, mixture_recalibrated, generated_store, band_windows, conditional_moments)}

_LAMS = {"EWMA 0.90": 0.90, "EWMA 0.94": 0.94, "EWMA 0.97": 0.97}
_HASH = "CAST(('0x' || substr(md5({key}), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496"
_PLACE = "CAST(least(greatest(ceil(least(greatest({p}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) * cells), 1), cells) AS BIGINT)"


#: Orders of a law that the SQL keeps beside its sums; a rank beyond them would leave a statistic null, and so differ.
LOW = 400


def random_splits_sql(splits: int) -> str:
    """blocks (split, s) as drawn_blocks() draws them."""
    key = _HASH.format(key="split || ':' || card")
    return f"""size AS (SELECT max(t) + 1 AS rows_n, (max(t) + 1) // {BLOCK} AS cards, CAST(round_even(0.2::DOUBLE * ((max(t) + 1) // {BLOCK}), 0) AS BIGINT) AS wanted FROM ret),
deck AS (SELECT split, card, card * wanted // cards AS heap, {key} AS u FROM (SELECT *, unnest(range(0, cards)) AS card FROM (SELECT *, unnest(range(0, {splits})) AS split FROM size))),
blocks AS (SELECT split, arg_min(card, u) * {BLOCK} AS s FROM deck GROUP BY split, heap), len AS (SELECT {BLOCK} AS len)"""


LATE_SQL = "cutoff AS (SELECT CAST(floor((1.0::DOUBLE - 0.2::DOUBLE) * (max(t) + 1)) AS BIGINT) AS s, max(t) + 1 AS e FROM ret), blocks AS (SELECT 0 AS split, s FROM cutoff), len AS (SELECT e - s AS len FROM cutoff)"


def study_sql(blocks: str, models: list[str], sims: int, window: int, h: int = 1, laws: str = "", sizes: str = "") -> str:
    """The records of all tests h steps ahead, as the table rec; a law is a sorted list. Laws that don't follow from the models, one step ahead, are given."""
    lams = ", ".join(f"('{m}', {_LAMS[m]!r}::DOUBLE)" for m in models if m != "HS")
    hs = "UNION ALL SELECT split, 'HS' AS model, k, t, n, xs FROM dates JOIN (SELECT split, list_sort(list(round(r, 12))) AS xs FROM starts JOIN pnl USING (t) GROUP BY split) USING (split)" if "HS" in models else ""
    sizes = sizes or "SELECT DISTINCT n, cells FROM dates JOIN (SELECT split, count(*) AS cells FROM starts GROUP BY split) USING (split)"
    source = laws or f"""var0 AS (SELECT split, j, greatest(var_pop(x), 1e-12::DOUBLE) AS v FROM ret JOIN rows_ USING (t) WHERE NOT is_test GROUP BY split, j),
sig AS (SELECT 0::BIGINT AS t, split, model, lam, j, v, v AS s2 FROM var0, (VALUES {lams}) q(model, lam)
  UNION ALL SELECT sig.t + 1, sig.split, sig.model, sig.lam, sig.j, sig.v, greatest(sig.lam * sig.s2 + (1 - sig.lam) * ret.x * ret.x, (0.05::DOUBLE * 0.05::DOUBLE) * sig.v)
  FROM sig JOIN ret ON ret.t = sig.t AND ret.j = sig.j WHERE sig.t + 1 <= (SELECT max(t) FROM ret)),
vec AS (SELECT split, model, t, list(sqrt(s2) ORDER BY j) AS sg, list(x / sqrt(s2) ORDER BY j) AS e FROM sig JOIN ret USING (t, j) GROUP BY split, model, t),
runs AS MATERIALIZED (SELECT split, model, e FROM vec JOIN starts USING (split, t)),
asked AS MATERIALIZED (SELECT d.split, v.model, d.k, d.t, d.n, v.sg FROM dates d JOIN vec v ON v.split = d.split AND v.t = d.t),
laws AS (SELECT d.split, d.model, d.k, d.t, d.n, list_sort(list(round(list_inner_product(r.e, d.sg) / len(r.e), 12))) AS xs FROM asked d JOIN runs r ON r.split = d.split AND r.model = d.model GROUP BY d.split, d.model, d.k, d.t, d.n {hs})"""
    levels = ", ".join(f"({k}, {a!r}::DOUBLE)" for k, a in enumerate(ALPHAS))
    short = ", ".join(map(str, SHORT))
    return f"""{PNL}, {blocks},
test AS (SELECT DISTINCT split, s + i AS t FROM (SELECT split, s, unnest(range(0, len)) AS i FROM blocks, len) WHERE s + i <= (SELECT max(t) FROM ret)),
rows_ AS (SELECT p.split, d.t, tt.t IS NOT NULL AS is_test FROM (SELECT DISTINCT split FROM blocks) p CROSS JOIN (SELECT DISTINCT t FROM ret) d LEFT JOIN test tt ON tt.split = p.split AND tt.t = d.t),
starts AS (SELECT split, t FROM (SELECT split, t, sum(CASE WHEN is_test THEN 0 ELSE 1 END) OVER (PARTITION BY split ORDER BY t ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS free FROM rows_) WHERE free = {window}),
fwd AS (SELECT t, round(r, 12) AS r FROM (SELECT t, sum(r) OVER w AS r, count(*) OVER w AS c FROM pnl WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING)) WHERE c = {h}),
dates AS (SELECT split, t, row_number() OVER (PARTITION BY split ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY split) AS n FROM (SELECT split, s + i * {h} AS t FROM (SELECT split, s, unnest(range(0, len // {h})) AS i FROM blocks, len)) JOIN fwd USING (t)),
{source},
levels AS (SELECT * FROM (VALUES {levels}) q(a, alpha)),
shape AS (SELECT DISTINCT n, cells, a, CAST(floor(n * alpha) AS BIGINT) AS m FROM ({sizes}), levels WHERE floor(n * alpha) >= 1),
edge AS (SELECT n, cells, a, m, i, unnest(range(0, m)) AS q FROM (SELECT *, unnest(range(1, cells)) AS i FROM shape)),
cum AS (SELECT n, cells, a, m, i, 1 - sum(exp(lgamma(n + 1) - lgamma(q + 1) - lgamma(n - q + 1) + q * ln(i / cells::DOUBLE) + (n - q) * ln(1 - i / cells::DOUBLE))) OVER (PARTITION BY n, cells, a, i ORDER BY q) AS tail FROM edge),
upto AS (SELECT n, cells, a, i, sum(tail) / m AS w FROM cum GROUP BY n, cells, a, m, i UNION ALL SELECT n, cells, a, 0, 0.0 FROM shape UNION ALL SELECT n, cells, a, cells, 1.0 FROM shape),
wt AS (SELECT n, cells, a, list(w ORDER BY i) AS w FROM (SELECT n, cells, a, i, w - lag(w) OVER (PARTITION BY n, cells, a ORDER BY i) AS w FROM upto) WHERE i > 0 GROUP BY n, cells, a),
weights AS (SELECT n, cells, any_value(w) FILTER (a = 0) AS w0, any_value(w) FILTER (a = 1) AS w1, any_value(w) FILTER (a = 2) AS w2 FROM wt GROUP BY n, cells),
law AS MATERIALIZED (SELECT split, model, k, t, laws.n, r AS x, len(xs) AS cells, least(greatest(len(list_filter(xs, lambda y: y <= r)) / len(xs)::DOUBLE, 0.5 / len(xs)), 1 - 0.5 / len(xs)) AS u, [-list_inner_product(w0, xs), -list_inner_product(w1, xs), -list_inner_product(w2, xs)] AS dens, xs[1:{LOW}] AS xs FROM laws JOIN fwd USING (t) LEFT JOIN weights ON weights.n = laws.n AND weights.cells = len(xs)),
sc AS (SELECT split, model, k, t, n, x, cells, u, a, alpha, -xs[{_PLACE.format(p='alpha')}] AS var, -(coalesce(list_sum(xs[1:CAST(floor(alpha * cells) AS BIGINT)]), 0) / cells + (alpha - floor(alpha * cells) / cells) * xs[CAST(floor(alpha * cells) AS BIGINT) + 1]) / alpha AS es, CAST(floor(n * alpha) AS BIGINT) AS m FROM law, levels),
den AS (SELECT split, model, k, a, dens[a + 1] AS den FROM law, levels WHERE dens[a + 1] IS NOT NULL),
seen_o AS (SELECT split, model, a, {_PLACE.format(p='u')} AS o FROM (SELECT *, row_number() OVER (PARTITION BY split, model, a ORDER BY u, k) AS i FROM sc) WHERE i <= m),
ranks AS (SELECT *, row_number() OVER (PARTITION BY n, sim ORDER BY u, k) AS rnk FROM (SELECT n, sim, k, {_HASH.format(key=f"'{SEED}:' || sim || ':' || k")} AS u FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT n, unnest(range(0, {sims})) AS sim FROM (SELECT DISTINCT n FROM dates))))),
draws AS (SELECT * FROM ranks WHERE u <= {ALPHAS[SHORT[0]]!r}::DOUBLE OR rnk <= floor(n * {ALPHAS[SHORT[0]]!r}::DOUBLE)),
base AS (SELECT split, model, a, alpha, n, m, any_value(cells) AS cells, count_if(x + var < 0) AS n_exc, sum(CASE WHEN x + var < 0 THEN x / es ELSE 0 END) AS ratio, sum(CASE WHEN x + var < 0 THEN -x ELSE 0 END) AS loss, sum(CASE WHEN x + var < 0 THEN es ELSE 0 END) AS shortfall FROM sc GROUP BY split, model, a, alpha, n, m),
deep AS (SELECT split, model, a, sim, {_PLACE.format(p='u')} AS o FROM (SELECT b.split, b.model, b.a, b.cells, d.sim, d.u FROM draws d JOIN base b ON b.n = d.n AND d.rnk <= b.m WHERE b.a IN ({short}))),
far AS (SELECT split, model, max(o) AS far FROM (SELECT split, model, o FROM seen_o UNION ALL SELECT split, model, o FROM deep UNION ALL SELECT split, model, {_PLACE.format(p='alpha')} FROM base) GROUP BY split, model),
low AS (SELECT law.split, law.model, k, unnest(range(1, far + 1)) AS o, unnest(xs[1:far]) AS y FROM law JOIN far ON far.split = law.split AND far.model = law.model),
means AS (SELECT low.split, low.model, a, o, avg(y / den) AS g FROM low JOIN den ON den.split = low.split AND den.model = low.model AND den.k = low.k GROUP BY ALL),
third AS (SELECT split, model, a, avg(g) + 1 AS z3 FROM seen_o JOIN means USING (split, model, a, o) GROUP BY ALL),
obs AS (SELECT base.*, CASE WHEN n_exc > 0 THEN ratio / n_exc + 1 END AS z1, ratio / n / alpha + 1 AS z2, z3, {pf_sql('n_exc', 'n', 'alpha')} AS lr FROM base LEFT JOIN third USING (split, model, a)),
picked AS MATERIALIZED (SELECT sc.split, sc.model, sc.a, sc.k, sc.var, sc.es, d.sim, CAST(least(greatest(ceil(least(greatest(d.u, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) * sc.cells), 1), sc.cells) AS BIGINT) AS o FROM draws d JOIN sc ON sc.n = d.n AND sc.k = d.k AND d.u <= sc.alpha WHERE sc.a IN ({short})),
hit AS (SELECT split, model, a, sim, y / es AS q FROM picked JOIN low USING (split, model, k, o) WHERE y + var < 0),
two AS (SELECT obs.split, obs.model, obs.a, count(*) AS w, count_if(q / c + 1 < z1) AS l1, count_if(q / (n * alpha) + 1 < z2) AS l2 FROM (SELECT split, model, a, sim, count(*) AS c, sum(q) AS q FROM hit GROUP BY ALL) h JOIN obs ON obs.split = h.split AND obs.model = h.model AND obs.a = h.a GROUP BY obs.split, obs.model, obs.a),
three AS (SELECT h.split, h.model, h.a, count_if(z < z3) / {sims} AS p3 FROM (SELECT split, model, a, sim, avg(g) + 1 AS z FROM deep JOIN means USING (split, model, a, o) GROUP BY ALL) h JOIN obs ON obs.split = h.split AND obs.model = h.model AND obs.a = h.a GROUP BY h.split, h.model, h.a),
ps AS (SELECT obs.*, {chi2_sql('lr')} AS p0, CASE WHEN z1 IS NOT NULL THEN l1 / w END AS p1, CASE WHEN obs.a IN ({short}) THEN (coalesce(l2, 0) + CASE WHEN 1.0 < z2 THEN {sims} - coalesce(w, 0) ELSE 0 END) / {sims}::DOUBLE END AS p2, p3 FROM obs LEFT JOIN two USING (split, model, a) LEFT JOIN three USING (split, model, a)),
rec AS (SELECT split, model, alpha, a, n, n_exc, 'PF' AS test, lr AS statistic, p0 AS p FROM ps UNION ALL SELECT split, model, alpha, a, n, n_exc, 'Z1', z1, p1 FROM ps UNION ALL SELECT split, model, alpha, a, n, n_exc, 'Z2', z2, p2 FROM ps UNION ALL SELECT split, model, alpha, a, n, n_exc, 'Z3', z3, p3 FROM ps)"""


RATES_SQL = f"SELECT model, 1 AS h, test, round(alpha, 8) AS alpha, count(*) AS tests, count(p) AS defined, round(avg(CASE WHEN p < 0.05 THEN 1 ELSE 0 END), 8) AS all_tests, round(avg(CAST(p < 0.05 AS INT)), 8) AS defined_tests, round(median(statistic), 5) AS median FROM rec WHERE CASE WHEN test = 'PF' THEN a IN ({', '.join(map(str, COVERED))}) ELSE a IN ({', '.join(map(str, SHORT))}) END GROUP BY model, test, alpha"
REGIMES_SQL = """, tv AS (SELECT t, CASE WHEN count(r) OVER w = 63 THEN round(stddev_pop(r) OVER w, 10) END AS vol FROM pnl WINDOW w AS (ORDER BY t ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
cuts AS (SELECT split, quantile_cont(vol, 1 / 3::DOUBLE) AS c1, quantile_cont(vol, 2 / 3::DOUBLE) AS c2 FROM rows_ JOIN tv USING (t) WHERE NOT is_test GROUP BY split),
zones AS (SELECT model, alpha, a, CAST(CASE WHEN vol >= c2 THEN 2 WHEN vol >= c1 THEN 1 ELSE 0 END AS INT) AS regime, count(*) AS days, count_if(x + var < 0) AS exceptions FROM sc JOIN tv USING (t) JOIN cuts USING (split) WHERE vol IS NOT NULL GROUP BY ALL)"""
_placebo, _ewma = study_sql(random_splits_sql(PLACEBO_SPLITS), PLACEBO_MODELS, PLACEBO_SIMS, N), study_sql(random_splits_sql(MODEL_SPLITS), MODEL_NAMES, MODEL_SIMS, N)
_drawn = SPLIT.replace("blocks AS (SELECT row_number() OVER (ORDER BY s) - 1 AS b, s FROM", "blocks AS (SELECT 0 AS split, row_number() OVER (ORDER BY s) - 1 AS b, s FROM").rpartition("rows_ AS (")[0].rstrip().rstrip(",") + f", len AS (SELECT {BLOCK} AS len)"
_labels = f"""tv AS (SELECT t, CASE WHEN count(r) OVER w = 63 THEN round(stddev_pop(r) OVER w, 10) END AS vol FROM pnl WINDOW w AS (ORDER BY t ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)), tc AS (SELECT quantile_cont(vol, 2 / 3::DOUBLE) AS c2 FROM tv),
gen AS (SELECT 'hs' AS model, t FROM starts UNION ALL SELECT 'hs_quiet', t FROM starts JOIN tv USING (t), tc WHERE vol < c2),
laws AS (SELECT split, model, k, t, n, xs FROM dates, (SELECT model, list_sort(list(round(r, 12))) AS xs FROM gen JOIN fwd USING (t) GROUP BY model))"""

SQL = {
    "placebo_rates": f"{_placebo} {RATES_SQL}",
    "placebo_regimes": f"{_placebo}{REGIMES_SQL} SELECT model, round(alpha, 8) AS alpha, regime, days, exceptions, round(exceptions / days, 8) AS rate FROM zones",
    "vol_model_tests": f"{_ewma} {RATES_SQL}",
    "vol_model_rates": f"{_ewma}{REGIMES_SQL}, nxt AS (SELECT model, x + var < 0 AS exc, CASE WHEN lead(t) OVER w = t + 1 THEN lead(x + var < 0) OVER w END AS b FROM sc WHERE a = 0 WINDOW w AS (PARTITION BY split, model ORDER BY t)), again AS (SELECT model, round(count_if(exc AND b) / greatest(count_if(exc AND b IS NOT NULL), 1), 8) AS exc_after_exc FROM nxt GROUP BY model), "
    "pooled AS (SELECT model, round(sum(n_exc) FILTER (a = 0) / sum(n) FILTER (a = 0), 8) AS exc95, round(sum(n_exc) FILTER (a = 2) / sum(n) FILTER (a = 2), 8) AS exc99, round(sum(loss) FILTER (a = 1) / sum(shortfall) FILTER (a = 1), 5) AS es_ratio FROM obs GROUP BY model), "
    "z AS (SELECT model, round(max(exceptions / days) FILTER (regime = 0), 8) AS calm95, round(max(exceptions / days) FILTER (regime = 1), 8) AS middle95, round(max(exceptions / days) FILTER (regime = 2), 8) AS stressed95 FROM zones WHERE a = 0 GROUP BY model) SELECT model, 1 AS h, exc95, exc99, es_ratio, exc_after_exc, calm95, middle95, stressed95 FROM pooled JOIN again USING (model) JOIN z USING (model)",
    "conditional_es_tests": f"{study_sql(LATE_SQL, PLACEBO_MODELS, PLACEBO_SIMS, 1)} SELECT model, round(alpha, 8) AS alpha, n, n_exc, test, round(statistic, 5) AS statistic, round(p, 8) AS p FROM rec",
    "label_backtest": f"{study_sql(_drawn, [], PLACEBO_SIMS, N, HORIZON, _labels, 'SELECT DISTINCT n, cells FROM dates, (SELECT model, count(*) AS cells FROM gen JOIN fwd USING (t) GROUP BY model)')}, ff AS (SELECT model, a, min(k) FILTER (x + var < 0) + 1 AS first_failure, any_value(var) AS var, any_value(es) AS es FROM sc GROUP BY model, a) SELECT model AS label, {HORIZON} AS h, round(alpha, 8) AS alpha, round(var, 8) AS var, round(es, 8) AS es, n, n_exc, first_failure, test, round(statistic, 5) AS statistic, round(p, 8) AS p FROM rec JOIN ff USING (model, a)",
    "novelty_windows": f"{BASE}, {SPLIT}, {STARTS}, sds AS (SELECT j, stddev_pop(x) AS sd FROM ret JOIN rows_ USING (t) WHERE NOT is_test GROUP BY j), firsts AS (SELECT t AS w, t IN (SELECT t FROM starts) AS own FROM rows_ WHERE t <= (SELECT max(t) + 1 FROM ret) - {N}), vecs AS (SELECT w, own, list(x / sd ORDER BY ret.t, j) AS v FROM firsts JOIN ret ON ret.t BETWEEN w AND w + {N - 1} JOIN sds USING (j) GROUP BY w, own), "
    f"perm AS (SELECT t AS w, row_number() OVER (ORDER BY {hashed_sql('0', 't')}, t) - 1 AS place, count(*) OVER () AS n FROM starts), boot AS (SELECT p.w FROM (SELECT unnest(range(0, (SELECT count(*) FROM starts))) AS id) i JOIN perm p ON p.place = floor({hashed_sql('novelty', 'id')} * p.n)), "
    "nn AS (SELECT a.w, a.own, min(list_distance(a.v, b.v)) AS d FROM vecs a JOIN vecs b ON b.own AND a.w <> b.w GROUP BY a.w, a.own), ds AS (SELECT 'real' AS sample, d FROM nn WHERE own UNION ALL SELECT 'touching', d FROM nn WHERE NOT own UNION ALL SELECT 'bootstrap', 0.0 FROM boot), mid AS (SELECT median(d) AS m FROM ds WHERE sample = 'real') "
    "SELECT sample, count(*) AS n, round(median(d), 4) AS median, round(median(d) / any_value(m), 4) AS ratio, round(min(d), 4) AS least, round(quantile_cont(d, 0.05::DOUBLE), 4) AS q05, round(avg(CASE WHEN d < 0.5 * m THEN 1 ELSE 0 END), 4) AS close FROM ds, mid GROUP BY sample",
    "mixture_recalibrated": f"WITH src AS ({vol_queries.SQL['standardised_returns']}), cutoff AS (SELECT CAST(floor((1.0::DOUBLE - 0.2::DOUBLE) * (max(t) + 1)) AS BIGINT) AS c FROM src), kn AS (SELECT j, x, i, n, sign(p - 0.5) * 2.0 * sqrt(greatest(cos(acos(least(sqrt(4.0 * p * (1.0 - p)), 1.0)) / 3.0) / sqrt(4.0 * p * (1.0 - p)) - 1.0, 0.0)) AS y FROM (SELECT j, e AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY j) AS n, row_number() OVER w / (count(*) OVER (PARTITION BY j) + 1.0::DOUBLE) AS p FROM src WHERE t < (SELECT c FROM cutoff) WINDOW w AS (PARTITION BY j ORDER BY e))), "
    "one AS (SELECT j, x, min(y) AS y FROM kn GROUP BY j, x), seg AS (SELECT j, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM one WINDOW w AS (PARTITION BY j ORDER BY x)), m AS (SELECT *, greatest(CAST(floor(n * 0.01::DOUBLE) AS BIGINT), 1) AS m FROM kn), "
    "ends AS (SELECT j, max(x) FILTER (i = 1) AS xa, max(y) FILTER (i = 1) AS ya, max(x) FILTER (i = m + 1) AS xb, max(y) FILTER (i = m + 1) AS yb, max(x) FILTER (i = n - m) AS xc, max(y) FILTER (i = n - m) AS yc, max(x) FILTER (i = n) AS xd, max(y) FILTER (i = n) AS yd FROM m GROUP BY j), late AS (SELECT t, j, e AS x FROM src WHERE t >= (SELECT c FROM cutoff)) "
    "SELECT l.t, l.j, l.x, round(CASE WHEN l.x < xa THEN ya + (l.x - xa) * (yb - ya) / (xb - xa) WHEN l.x > xd THEN yd + (l.x - xd) * (yd - yc) / (xd - xc) WHEN x1 IS NULL OR l.x = x0 THEN y0 ELSE y0 + (l.x - x0) * (y1 - y0) / (x1 - x0) END, 5) AS y FROM late l JOIN ends USING (j) ASOF LEFT JOIN seg ON l.j = seg.j AND l.x >= seg.x0",
    "generated_store": f"{PNL}, {SPLIT}, {STARTS}, {WINDOWS}, {vol_queries.REG}, both_ AS (SELECT 'hs' AS label, * FROM wins UNION ALL SELECT 'hs_quiet', wins.* FROM wins JOIN reg ON reg.t = wins.w WHERE regime < 2) SELECT label, count(DISTINCT w) AS windows, count(*) AS cells, round(sum(x), 5) AS total, (SELECT count(*) FROM blocks) AS blocks FROM both_ GROUP BY label",
    "band_windows": f"{BASE}, {SPLIT}, {STARTS}, lv AS ({vol_queries.SQL['relative_vol']}), rk AS (SELECT t, round(sum(CASE WHEN t < (SELECT CAST(floor((1.0::DOUBLE - 0.2::DOUBLE) * (max(t) + 1)) AS BIGINT) FROM lv) THEN 1 ELSE 0 END) OVER (ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / (SELECT CAST(floor((1.0::DOUBLE - 0.2::DOUBLE) * (max(t) + 1)) AS BIGINT) FROM lv)::DOUBLE, 10) AS u FROM lv), "
    f"ls AS (SELECT unnest([{', '.join(f'{v}::DOUBLE' for v in LEVELS_U)}]) AS level), b AS (SELECT level, 'hs_u' || printf('%.2f', level) AS label, greatest(level - 0.05, 0) AS lo, least(level + 0.05, 1) AS hi FROM ls), w AS (SELECT label, count(*) AS windows FROM starts JOIN rk USING (t), b WHERE abs(u - level) <= 0.05 GROUP BY label), d AS (SELECT label, count(*) AS days FROM rk, b WHERE u BETWEEN lo AND hi GROUP BY label) SELECT label, round(lo, 8) AS lo, round(hi, 8) AS hi, windows, days FROM b JOIN w USING (label) JOIN d USING (label)",
}
