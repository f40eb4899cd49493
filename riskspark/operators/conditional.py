"""Backtests of laws that differ from date to date, for any number of splits, models and horizons in one job.

The split, the model and the horizon are columns. Scenarios are runs of standardised returns from the starts of whole training windows; each forecast date scales them by its own
volatility and rolls the model's recursion along each run. A date's law is sorted where it is made, and what goes on is its value at risk, shortfall, lower tail and the rank of
what happened. The tests of expected shortfall and their simulated p-values follow from these by joins and sums:

* the third statistic is linear in the laws' order statistics, so each split needs one number an order, the mean over dates of x(order) over its expectation;
* a simulation needs only the draws that fall into the tail or are among the m smallest, and all splits share the same draws.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.tests import chi2_p, pf_lr, uniform
from riskspark.sources.shared import written

from .risk import ordinal
from .volmodels import MODELS, by_row, filtered, parameters

KEY = ["split", "model", "h"]
#: Rows of time that make up one block of scenarios, and forecast dates that are worked on together.
CHUNK, SLICE = 4096, 256
#: Laws are rounded to so many digits, so that their order does not depend on the order of sums.
DIGITS = 12
LAW = "split long, model string, h int, slice long, k long, t long, x double, n long, cells int, u double, var array<double>, es array<double>, tail array<double>, g array<array<double>>"
PART = "split long, model string, h int, slice long, k long, t long, x double, n long, chunk long, values array<double>"


# ------------------------------------------------------------------------------------------------ splits as tables


def flags(draws: DataFrame, rows: int, block: int) -> DataFrame:
    """split, t, is_test for every row of every split; the rows of test blocks are exploded and meet the others in an equi-join."""
    splits = draws.select("split").distinct()
    test = draws.select("split", F.explode(F.sequence("s", F.col("s") + block - 1)).alias("t")).where(F.col("t") < rows).distinct().withColumn("is_test", F.lit(True))
    whole = splits.sparkSession.range(rows).select(F.col("id").alias("t")).crossJoin(F.broadcast(splits))  # all rows of all splits are what is asked for
    return whole.join(test, ["split", "t"], "left").select("split", "t", F.coalesce("is_test", F.lit(False)).alias("is_test"))


def held_rows(marked: DataFrame) -> DataFrame:
    """split, held: the rows that each split holds out."""
    return marked.groupBy("split").agg(F.sort_array(F.collect_list(F.when(F.col("is_test"), F.col("t")))).alias("held"))


def purged_starts(marked: DataFrame, n: int) -> DataFrame:
    """split, t: first rows of n training rows in a row."""
    ahead = Window.partitionBy("split").orderBy("t").rowsBetween(0, n - 1)
    return marked.withColumn("_n", F.sum((~F.col("is_test")).cast("int")).over(ahead)).where(F.col("_n") == n).select("split", "t")


def forecast_dates(draws: DataFrame, block: int, horizons: list[int]) -> DataFrame:
    """split, h, k, t: the first row of each whole h-step piece of each test block, numbered in order."""
    if max(horizons) > block or min(horizons) < 1:
        raise ValueError(f"a horizon of {horizons} rows does not fit a block of {block}")
    each = draws.withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).withColumn("_per", F.expr(f"{block} div h"))
    each = each.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_per") - 1)))
    return each.select("split", "h", (F.col("b") * F.col("_per") + F.col("_i")).alias("k"), (F.col("s") + F.col("_i") * F.col("h")).alias("t"))


def horizon_sums(pnl: DataFrame, horizons: list[int]) -> DataFrame:
    """t, h, x: the sum of h rows from t on, where there are so many."""
    ahead = lambda h: Window.orderBy("t").rowsBetween(0, h - 1)  # noqa: E731  one number a date
    sums = [F.when(F.count("r").over(ahead(h)) == h, F.struct(F.lit(h).alias("h"), F.round(F.sum("r").over(ahead(h)), DIGITS).alias("x"))) for h in horizons]
    return pnl.select("t", F.array(*sums).alias("s")).select("t", F.explode("s").alias("s")).where("s IS NOT NULL").select("t", "s.h", "s.x")


# --------------------------------------------------------------------------------------------------------- the laws


@lru_cache(maxsize=64)
def order_weights(n: int, m: int, cells: int) -> np.ndarray:
    """By place in a law of so many cells, its weight in the expected mean of the m least of n draws.

    Up to p the weights add up to the mean, over k < m, of the chance that more than k of n draws lie below p: binomial tails, whose terms follow from one another.
    """
    p = np.arange(cells + 1) / cells
    with np.errstate(divide="ignore", invalid="ignore"):
        odds, term = p / (1 - p), n * np.log1p(-p)
        total, below = np.zeros(cells + 1), np.zeros(cells + 1)
        for k in range(m):
            below = below + np.exp(term)
            total = total + (1 - np.minimum(below, 1))
            term = term + np.log((n - k) / (k + 1) * odds)
    total[0], total[-1] = 0.0, float(m)
    return np.diff(total / m)


def place(p: float, cells: int) -> int:
    """The order, from 1, of the generalised inverse at p."""
    return int(min(max(np.ceil(min(max(p, 1e-12), 1 - 1e-12) * cells), 1), cells))


def tail_means(xs: np.ndarray, alpha: float) -> np.ndarray:
    """Expected shortfall of each sorted law (a row each) with the part of the last order that belongs to it."""
    cells = xs.shape[1]
    k = int(np.floor(alpha * cells))
    whole = xs[:, :k].sum(axis=1) / cells
    return -(whole + ((alpha - k / cells) * xs[:, k] if k < cells else 0)) / alpha


def scenario_values(model: str, e: np.ndarray, starts: np.ndarray, sigma: np.ndarray, theta: np.ndarray, h: int) -> np.ndarray:
    """Dates by scenarios: the equal-weight sum of h steps. e: rows by instruments; sigma: dates by instruments. A constant model has one date."""
    rule, width = MODELS[model], e.shape[1]
    if rule.constant or h == 1:
        run = sum(e[starts + k] for k in range(h))
        return (np.ones((1, width)) if rule.constant else sigma) @ run.T / width
    out = np.empty((len(sigma), len(starts)))
    for row, first in enumerate(sigma):
        s2, total = np.broadcast_to(first**2, (len(starts), width)), 0.0
        for k in range(h):
            r = np.sqrt(s2) * e[starts + k]
            total = total + r.mean(axis=1)
            s2 = rule.step(s2, r, theta)
        out[row] = total
    return out


def described(key: tuple, dates: pd.DataFrame, values: np.ndarray, alphas: list[float]) -> pd.DataFrame:
    """The rows of LAW: one for each date, and one with the sums of x(order) over its expectation, by level, over these dates. values: a law a row, or one for all dates."""
    xs = np.sort(np.round(values, DIGITS), axis=1)
    laws, cells = xs.shape
    n, count, x = int(dates["n"].iloc[0]), len(dates), dates["x"].to_numpy(float)
    of = (lambda k: k) if laws > 1 or count == 1 else (lambda k: 0)
    var = np.stack([-xs[:, place(a, cells) - 1] for a in alphas], axis=1)
    es = np.stack([tail_means(xs, a) for a in alphas], axis=1)
    longest = max(place(a, cells) for a in alphas)
    u = np.array([np.searchsorted(xs[of(k)], x[k], side="right") / cells for k in range(count)])
    g = []
    for a in alphas:
        m = int(np.floor(n * a))
        if m < 1:
            g.append(None)
        else:
            per = xs / -(xs @ order_weights(n, m, cells))[:, None]
            g.append((per.sum(axis=0) if laws > 1 or count == 1 else per[0] * count).tolist())
    split, model, h, part = key
    at = lambda k: of(k) if k < count else None
    pick = lambda rows: [rows(at(k)) if k < count else None for k in range(count + 1)]
    padded = lambda values: [*values, None]
    return pd.DataFrame({
        "split": split, "model": model, "h": h, "slice": part, "k": pd.array(padded(dates["k"].tolist()), "Int64"), "t": pd.array(padded(dates["t"].tolist()), "Int64"), "x": padded(x.tolist()), "n": n,
        "cells": cells, "u": padded(np.clip(u, 0.5 / cells, 1 - 0.5 / cells).tolist()), "var": pick(lambda r: var[r].tolist()), "es": pick(lambda r: es[r].tolist()), "tail": pick(lambda r: xs[r, :longest].tolist()),
        "g": [*[None] * count, g],
    })


def laws(rets: DataFrame, pnl: DataFrame, marked: DataFrame, dates: DataFrame, models: list[str], alphas: list[float], window: int, chunk: int = 0, part: int = 0) -> DataFrame:
    """The rows of LAW for every split, model and forecast date.

    rets: t, j, x; pnl: t, r; marked: flags(); dates: forecast_dates(). Dates whose horizon runs past the end have no outcome and are left out. window: training rows that a scenario
    must start a run of, at least the longest horizon. Rows of time are dealt into chunks, each with what the horizon needs of the next, and dates into slices, so a task holds a
    chunk and a slice. If time has more than one chunk, the values of a date come together for sorting: one number a scenario.
    """
    spark, chunk = rets.sparkSession, chunk or CHUNK
    horizons = sorted(r["h"] for r in dates.select("h").distinct().collect())
    if not horizons:
        return spark.createDataFrame([], LAW)
    if max(horizons) > window or window > chunk:
        raise ValueError(f"horizons of {horizons}, windows of {window} and chunks of {chunk} rows have to follow one another in size")
    rows = rets.agg(F.max("t") + 1).first()[0]
    chunks = -(-rows // chunk)
    part = part or max(1, min(SLICE, SLICE * CHUNK // rows))
    paths = written(filtered(rets, held_rows(marked), models), "vol-paths")
    states, lead = by_row(paths), max(horizons) - 1
    starts = purged_starts(marked, window).withColumn("start", F.lit(True))
    here = F.expr(f"t div {chunk}")
    runs = states.join(starts, ["split", "t"], "left").select(
        "split", "model", "t", "e", here.alias("_own"), "start", F.explode(F.array_distinct(F.array(here, F.expr(f"greatest(t - {lead}, 0) div {chunk}")))).alias("chunk")
    ).withColumn("start", F.coalesce("start", F.lit(False)) & (F.col("chunk") == F.col("_own"))).drop("_own")
    known = dates.join(horizon_sums(pnl, horizons), ["t", "h"])
    known = known.withColumn("n", F.count("*").over(Window.partitionBy("split", "h"))).withColumn("slice", F.floor(F.col("k") / part))
    runs = runs.join(known.select("split", "h", "slice").distinct(), "split")
    asked = known.join(states.select("split", "model", "t", "sigma"), ["split", "t"]).join(F.broadcast(parameters(paths)), ["split", "model"])  # a row a split and model
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    columns = [c.split()[0] for c in (LAW if chunks == 1 else PART).split(", ")]

    def scenarios(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        split, model, h, at, block = key
        left, right = both[both["k"].notna()], both[both["k"].isna()].sort_values("t")
        at_start = np.flatnonzero(right["start"].to_numpy(bool)) if len(right) else []
        if not len(left) or not len(at_start):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
        left = left.sort_values("k").astype({"k": "int64", "n": "int64"})
        theta = np.stack([np.asarray(v) for v in left["theta"].iloc[0]]).T
        values = scenario_values(model, np.stack(right["e"].to_numpy()), at_start, np.stack(left["sigma"].to_numpy()), theta, h)
        if chunks == 1:
            return described(key[:4], left, values, alphas)
        values = np.broadcast_to(values, (len(left), values.shape[1]))
        return pd.DataFrame({"split": split, "model": model, "h": h, "slice": at, "k": left["k"], "t": left["t"], "x": left["x"], "n": left["n"], "chunk": block, "values": list(values)})

    def gathered(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        parts = [g.sort_values("chunk") for _, g in df.groupby("k", sort=True)]
        return described(key, pd.concat([g.iloc[:1] for g in parts]), np.stack([np.concatenate(list(g["values"])) for g in parts]), alphas)

    by = [*KEY, "slice", "chunk"]
    both = asked.unionByName(runs, allowMissingColumns=True)  # dates have a k, rows of time have none
    made = both.groupBy(*by).applyInPandas(scenarios, LAW if chunks == 1 else PART)
    return made if chunks == 1 else made.groupBy(*KEY, "slice").applyInPandas(gathered, LAW)


def label_laws(windows: DataFrame, known: DataFrame, alphas: list[float]) -> DataFrame:
    """The rows of LAW, with labels as models: each label's windows (label, w, k, j, x) give one law for each horizon, the equal-weight sum of a window's first h steps, for all
    dates. known: split, h, k, t, x, the outcomes. A law is one sample, a number a window, and is sorted as one.
    """
    horizons = [r["h"] for r in known.select("h").distinct().collect()]
    steps = windows.groupBy("label", "w", "k").agg((F.sum("x") / F.count("*")).alias("r"))
    sums = [F.struct(F.lit(h).alias("h"), F.sum(F.when(F.col("k") < h, F.col("r"))).alias("v"), F.count_if(F.col("k") < h).alias("n")) for h in horizons]
    runs = steps.groupBy("label", "w").agg(F.array(*sums).alias("s")).select("label", F.inline("s")).where("n = h")
    counted = known.withColumn("n", F.count("*").over(Window.partitionBy("split", "h")))
    asked = counted.join(F.broadcast(windows.select(F.col("label").alias("model")).distinct()))  # the labels
    splits = counted.select("split", "h").distinct()
    sample = runs.select(F.col("label").alias("model"), "h", "v").join(F.broadcast(splits), "h")

    def describe(key: tuple, both: pd.DataFrame) -> pd.DataFrame:
        dates, values = both[both["k"].notna()].sort_values("k").astype({"k": "int64", "n": "int64"}), both.loc[both["k"].isna(), "v"].to_numpy(float)
        if not len(dates) or not len(values):
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in LAW.split(", ")})
        return described((*key, 0), dates, values[None, :], alphas)

    return asked.unionByName(sample, allowMissingColumns=True).groupBy(*KEY).applyInPandas(describe, LAW)


# ------------------------------------------------------------------------------------------------------------ tests


def forecasts(found: DataFrame) -> DataFrame:
    """KEY, k, t, x, n, cells, u, a, var, es, tail, exc: a row for each forecast date and level, numbered a."""
    each = found.where("k IS NOT NULL").select(*KEY, "k", "t", "x", "n", "cells", "u", "tail", F.posexplode(F.arrays_zip("var", "es")).alias("a", "v"))
    return each.select(*KEY, "k", "t", "x", "n", "cells", "u", "tail", "a", "v.var", "v.es").withColumn("exc", F.col("x") + F.col("var") < 0)


def simulated_ranks(found: DataFrame, alphas: list[float], sims: int, seed: int) -> DataFrame:
    """n, sim, k, u, rank: of sims samples of n uniform numbers, those in the tail or among the least that the third statistic takes. All laws with n dates share them."""
    sizes = found.select("n").distinct()
    each = sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).select("n", "sim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    drawn = each.withColumn("u", uniform(F.concat_ws(":", F.lit(str(seed)), F.col("sim").cast("string"), F.col("k").cast("string"))))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("n", "sim").orderBy("u", "k")))
    return ranked.where((F.col("u") <= max(alphas)) | (F.col("rank") <= F.floor(F.col("n") * max(alphas))))


def per_level(alphas: list[float], a: str = "a"):
    return F.element_at(F.array(*map(F.lit, alphas)), F.col(a) + 1)


def observed(found: DataFrame, alphas: list[float]) -> DataFrame:
    """KEY, a, alpha, n, cells, n_exc, lr, z1, z2, z3, loss, shortfall: the coverage ratio, the three statistics of expected shortfall, and sums over days with an exception."""
    each = forecasts(found)
    ratio = F.sum(F.when(F.col("exc"), F.col("x") / F.col("es")).otherwise(0.0))
    hits = F.count_if("exc")
    base = each.groupBy(*KEY, "a").agg(
        F.count("*").alias("n"), F.first("cells").alias("cells"), hits.alias("n_exc"), F.when(hits > 0, ratio / hits + 1).alias("z1"), (ratio / F.count("*")).alias("_r"),
        F.sum(F.when(F.col("exc"), -F.col("x")).otherwise(0.0)).alias("loss"), F.sum(F.when(F.col("exc"), F.col("es")).otherwise(0.0)).alias("shortfall"),
    ).withColumn("alpha", per_level(alphas)).withColumn("z2", F.col("_r") / F.col("alpha") + 1).withColumn("lr", pf_lr(F.col("n_exc"), F.col("n"), F.col("alpha")))
    w = Window.partitionBy(*KEY, "a").orderBy("u", "k")
    least = each.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= F.floor(F.col("n") * per_level(alphas)))
    third = least.select(*KEY, "a", ordinal(F.col("u"), F.col("cells")).cast("int").alias("o")).join(order_means(found), [*KEY, "a", "o"]).groupBy(*KEY, "a").agg((F.avg("g") + 1).alias("z3"))
    return base.drop("_r").join(third, [*KEY, "a"], "left")


def order_means(found: DataFrame) -> DataFrame:
    """KEY, a, o, g: the mean over dates of the o-th least value over its expectation, by level."""
    sums = found.where("k IS NULL").select(*KEY, "n", F.posexplode("g").alias("a", "g")).select(*KEY, "n", "a", F.posexplode("g").alias("_o", "g"))
    return sums.groupBy(*KEY, "a", "_o").agg((F.sum("g") / F.first("n")).alias("g")).select(*KEY, "a", (F.col("_o") + 1).alias("o"), "g")


def simulated(found: DataFrame, seen: DataFrame, alphas: list[float], sims: int, seed: int, wanted: list[int]) -> DataFrame:
    """KEY, a, p1, p2, p3 at the wanted levels: how many simulations have a smaller statistic than `seen` (observed()). Those without an exception count for the second statistic alone, where it is 1."""
    ranks = written(simulated_ranks(found.where("k IS NOT NULL"), [alphas[k] for k in wanted], sims, seed), "ranks")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("a"), F.lit(alphas[k]).alias("alpha")) for k in wanted])).alias("l")
    each = forecasts(found).select(*KEY, "k", "n", "cells", "tail", "a", "var", "es")
    tail = ranks.select("n", "sim", "k", "u", levels).select("n", "sim", "k", "u", "l.a", "l.alpha").where(F.col("u") <= F.col("alpha")).join(each, ["n", "k", "a"])
    drawn = tail.withColumn("y", F.element_at("tail", ordinal(F.col("u"), F.col("cells")).cast("int"))).where(F.col("y") + F.col("var") < 0)
    two = drawn.groupBy(*KEY, "a", "sim").agg(F.count("*").alias("_hits"), F.sum(F.col("y") / F.col("es")).alias("_ratio"))
    mine = seen.where(F.col("a").isin(wanted)).select(*KEY, "a", "alpha", "n", "cells", "z1", "z2", "z3")
    two = two.join(mine, [*KEY, "a"]).groupBy(*KEY, "a").agg(
        F.count("*").alias("_with"), F.count_if(F.col("_ratio") / F.col("_hits") + 1 < F.col("z1")).alias("_less1"), F.count_if(F.col("_ratio") / (F.col("n") * F.col("alpha")) + 1 < F.col("z2")).alias("_less2"),
    )
    deep = ranks.select("n", "sim", "u", "rank").join(mine, "n").where(F.col("rank") <= F.floor(F.col("n") * F.col("alpha")))
    deep = deep.select(*KEY, "a", "sim", "z3", ordinal(F.col("u"), F.col("cells")).cast("int").alias("o")).join(order_means(found), [*KEY, "a", "o"])
    three = deep.groupBy(*KEY, "a", "sim").agg((F.avg("g") + 1 < F.first("z3")).alias("less")).groupBy(*KEY, "a").agg((F.count_if("less") / sims).alias("p3"))
    both = mine.join(two, [*KEY, "a"], "left").join(three, [*KEY, "a"], "left")
    none = F.lit(sims) - F.coalesce("_with", F.lit(0))
    return both.select(
        *KEY, "a", F.when(F.col("z1").isNotNull(), F.col("_less1") / F.col("_with")).alias("p1"), ((F.coalesce("_less2", F.lit(0)) + F.when(F.lit(1.0) < F.col("z2"), none).otherwise(0)) / sims).alias("p2"), "p3"
    )


def tests(found: DataFrame, alphas: list[float], sims: int, seed: int = 0, wanted: list[int] | None = None) -> DataFrame:
    """KEY, alpha, n, n_exc, test, statistic, p: coverage (PF) and the three tests of expected shortfall at every level. An undefined statistic and its p are null, and so are the
    simulated p at levels that are not wanted (places in alphas; all unless given)."""
    wanted = list(range(len(alphas))) if wanted is None else wanted
    seen = written(observed(found, alphas), "observed")
    both = seen.join(simulated(found, seen, alphas, sims, seed, wanted), [*KEY, "a"], "left").withColumn("p0", chi2_p("lr"))
    record = lambda name, z, p: F.struct(F.lit(name).alias("test"), F.col(z).alias("statistic"), F.col(p).alias("p"))
    return both.select(*KEY, "alpha", "n", "n_exc", F.inline(F.array(record("PF", "lr", "p0"), record("Z1", "z1", "p1"), record("Z2", "z2", "p2"), record("Z3", "z3", "p3"))))


def rejection_rates(records: DataFrame, by: list[str], level: float = 0.05) -> DataFrame:
    """by..., tests, defined, all_tests, defined_tests, median: the share of tests that reject, an undefined one as not rejecting or left out, and the median statistic."""
    hit = F.col("p") < level
    return records.groupBy(*by).agg(
        F.count("*").alias("tests"), F.count("p").alias("defined"), F.avg(F.coalesce(hit, F.lit(False)).cast("int")).alias("all_tests"), F.avg(hit.cast("int")).alias("defined_tests"), F.median("statistic").alias("median"),
    )


def regime_rates(found: DataFrame, marked: DataFrame, vol: DataFrame, alphas: list[float]) -> DataFrame:
    """model, alpha, regime, days, exceptions: one-step forecasts of all splits by the tercile of trailing volatility, whose cuts are those of each split's training rows. A value on a cut goes up."""
    cuts = marked.where(~F.col("is_test")).join(vol, "t").groupBy("split").agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    each = forecasts(found).where("h = 1").join(vol.where("vol IS NOT NULL"), "t").join(F.broadcast(cuts), "split")  # a row a split
    regime = F.when(F.col("vol") >= F.col("c")[1], 2).when(F.col("vol") >= F.col("c")[0], 1).otherwise(0)
    return each.withColumn("alpha", per_level(alphas)).groupBy("model", "alpha", regime.alias("regime")).agg(F.count("*").alias("days"), F.count_if("exc").alias("exceptions"))


def persistence(found: DataFrame, alphas: list[float]) -> DataFrame:
    """model, alpha, before, both: one-step exceptions, and how many of the next rows have one too; only rows that follow one another count."""
    w = Window.partitionBy("split", "model", "a").orderBy("t")
    each = forecasts(found).where("h = 1").withColumn("_b", F.when(F.lead("t").over(w) == F.col("t") + 1, F.lead("exc").over(w)))
    return each.withColumn("alpha", per_level(alphas)).groupBy("model", "alpha").agg(F.count_if(F.col("exc") & F.col("_b").isNotNull()).alias("before"), F.count_if(F.col("exc") & F.col("_b")).alias("both"))
