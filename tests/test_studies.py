"""Studies over splits, volatility models and tails against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions.special import chi2_sf
from riskspark.operators import conditional, dependence, split, tails, volmodels

ROWS, WIDTH, BLOCK, WINDOW, SIMS, SEED = 160, 3, 10, 5, 60, 9
ALPHAS = [0.1, 0.05]


def panel():
    rng = np.random.default_rng(5)
    return rng.standard_t(4, size=(ROWS, WIDTH)) * np.array([0.01, 0.02, 0.015]) * (1 + 0.5 * np.sin(np.arange(ROWS) / 15))[:, None]


def tables(spark):
    x = panel()
    rets = spark.createDataFrame([(t, j + 1, float(x[t, j])) for t in range(ROWS) for j in range(WIDTH)], "t long, j int, x double")
    pnl = spark.createDataFrame([(t, round(float(x[t].mean()), 12)) for t in range(ROWS)], "t long, r double")
    return rets, pnl


def uniform(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2**52


def place(p, m):
    return min(max(math.ceil(min(max(p, 1e-12), 1 - 1e-12) * m), 1), m)


def plain_weights(n, m, cells):
    """Each cell's part of the integral of (n / m) times the chance of fewer than m of n - 1 below p, by the midpoint rule."""
    fine = 400
    p = (np.arange(cells * fine) + 0.5) / (cells * fine)
    w = sum(math.comb(n - 1, k) * p**k * (1 - p) ** (n - 1 - k) for k in range(m)) * n / m
    return w.reshape(cells, fine).mean(axis=1) / cells


def plain_laws(draws, model, h):
    """For one split: (k, t, x, sorted law) of every forecast date."""
    x = panel()
    held = sorted({s + i for s in draws for i in range(BLOCK)})
    train = np.array([t not in held for t in range(ROWS)])
    rule = volmodels.MODELS[model]
    theta = rule.fit(x, train)
    sigma = np.ones_like(x) if rule.constant else np.sqrt(volmodels.variances(rule, x, theta))
    e = x / sigma
    starts = [t for t in range(ROWS - WINDOW + 1) if train[t : t + WINDOW].all()]
    out = []
    for b, s in enumerate(sorted(draws)):
        for i in range(BLOCK // h):
            t, law = s + i * h, []
            for w in starts:
                s2, total = sigma[t] ** 2, 0.0
                for k in range(h):
                    r = np.sqrt(s2) * e[w + k]
                    total += r.mean()
                    s2 = rule.step(s2, r, theta)
                law.append(round(total, 12))
            out.append((b * (BLOCK // h) + i, t, round(sum(round(float(v), 12) for v in x[t : t + h].mean(axis=1)), 12), np.sort(law)))
    return out


def plain_tests(laws):
    n, out = len(laws), {}
    for a in ALPHAS:
        m = math.floor(n * a)
        cells = len(laws[0][3])
        weights = plain_weights(n, m, cells) if m else None
        var = [-xs[place(a, cells) - 1] for *_, xs in laws]
        q = math.floor(a * cells)
        es = [-(xs[:q].sum() / cells + (a - q / cells) * xs[q]) / a for *_, xs in laws]
        den = [-(weights @ xs) for *_, xs in laws] if m else None

        def statistics(ys, us):
            hits = [y / s for y, v, s in zip(ys, var, es) if y + v < 0]
            z1, z2 = (sum(hits) / len(hits) + 1 if hits else None), sum(hits) / (n * a) + 1
            if not m:
                return z1, z2, None
            low = sorted(us)[:m]
            return z1, z2, 1 - np.mean([-np.mean([xs[place(u, cells) - 1] for u in low]) / d for (*_, xs), d in zip(laws, den)])

        u = [min(max((xs <= x).sum() / cells, 0.5 / cells), 1 - 0.5 / cells) for _, _, x, xs in laws]
        seen = statistics([x for _, _, x, _ in laws], u)
        sims = []
        for sim in range(SIMS):
            us = [uniform(SEED, sim, k) for k, *_ in laws]
            sims.append(statistics([xs[place(v, cells) - 1] for v, (*_, xs) in zip(us, laws)], us))
        exc = sum(x + v < 0 for (_, _, x, _), v in zip(laws, var))
        p = []
        for k in range(3):
            values = [s[k] for s in sims if s[k] is not None]
            p.append(np.mean([v < seen[k] for v in values]) if seen[k] is not None and values else None)
        rate = exc / n
        log = lambda c, y: c * math.log(max(y, 1e-300)) if c else 0.0
        lr = -2 * (log(n - exc, 1 - a) + log(exc, a) - log(n - exc, 1 - rate) - log(exc, rate))
        out[a] = (exc, [lr, *seen], [float(chi2_sf(np.array([lr]))[0]), *p])
    return out


@pytest.mark.parametrize(("chunk", "part"), [(4096, 256), (20, 7)])
def test_conditional_tests_are_the_plain_ones(spark, chunk, part):
    rets, pnl = tables(spark)
    models, horizons = ["HS", "EWMA 0.94", "GJR"], [1, 3]
    draws = split.drawn_blocks(spark, ROWS, BLOCK, 0.25, F.sequence(F.lit(0), F.lit(1)))
    marked = conditional.flags(draws, ROWS, BLOCK)
    found = conditional.laws(rets, pnl, marked, conditional.forecast_dates(draws, BLOCK, horizons), models, ALPHAS, WINDOW, chunk, part).cache()
    got = {(r["split"], r["model"], r["h"], round(r["alpha"], 6), r["test"]): r for r in conditional.tests(found, ALPHAS, SIMS, SEED).collect()}
    blocks = {}
    for r in draws.collect():
        blocks.setdefault(r["split"], []).append(r["s"])
    assert len(got) == 2 * 3 * 2 * 2 * 4
    for s, starts in blocks.items():
        for model in models:
            for h in horizons:
                for a, (exc, z, p) in plain_tests(plain_laws(starts, model, h)).items():
                    for k, name in enumerate(("PF", "Z1", "Z2", "Z3")):
                        r = got[s, model, h, a, name]
                        assert r["n_exc"] == exc
                        assert r["statistic"] == (None if z[k] is None else pytest.approx(z[k], abs=2e-4 if name == "Z3" else 1e-9)), (s, model, h, a, name)
                        assert r["p"] == (None if p[k] is None else pytest.approx(p[k], abs=0.5 / SIMS if name == "Z3" else 1e-6)), (s, model, h, a, name)


def test_order_weights_are_the_integral():
    for n, m, cells in ((40, 3, 25), (500, 12, 60), (30, 30, 10)):
        w = conditional.order_weights(n, m, cells)
        assert w.sum() == pytest.approx(1) and np.abs(w - plain_weights(n, m, cells)).max() < 1e-5


def test_the_asymmetric_fit_beats_a_grid():
    """Of 240 points, all series at once; and the fit of a series does not depend on those fitted with it."""
    x = panel()
    train = np.arange(ROWS) % 7 != 0
    theta = volmodels.fit_asymmetric(x, train)
    score = volmodels.gaussian_score(x[:, None, :], train, theta[:, None, :])[0]
    grid = np.array([(a, g, b) for a in (0.0, 0.02, 0.04, 0.06, 0.09, 0.12) for g in (0.0, 0.04, 0.08, 0.12, 0.18) for b in (0.8, 0.85, 0.88, 0.9, 0.92, 0.94, 0.96, 0.975) if a + g / 2 + b <= 0.995 and a + g > 0])
    base = volmodels.start(x, train)
    full = np.concatenate([np.broadcast_to(base[:, None, :], (2, len(grid), WIDTH)), np.broadcast_to(grid.T[:, :, None], (3, len(grid), WIDTH))])
    assert (score >= volmodels.gaussian_score(x[:, None, :], train, full).max(axis=0) - 1e-9).all()
    a, g, b = theta[2:]
    assert (a >= 0).all() and (g >= 0).all() and (b >= 0).all() and (a + g / 2 + b <= 0.995 + 1e-9).all()
    assert np.allclose(volmodels.fit_asymmetric(x[:, 1:2], train)[:, 0], theta[:, 1])


def test_unknown_models_and_short_windows_are_errors(spark):
    rets, pnl = tables(spark)
    held = spark.createDataFrame([(0, [1, 2])], "split long, held array<long>")
    with pytest.raises(ValueError, match="no model"):
        volmodels.filtered(rets, held, ["ARCH"])
    draws = split.drawn_blocks(spark, ROWS, BLOCK, 0.25, F.array(F.lit(0)))
    with pytest.raises(ValueError, match="follow one another"):
        conditional.laws(rets, pnl, conditional.flags(draws, ROWS, BLOCK), conditional.forecast_dates(draws, BLOCK, [3]), ["HS"], ALPHAS, 2)
    with pytest.raises(ValueError, match="horizon"):
        conditional.forecast_dates(draws, BLOCK, [11])


# ------------------------------------------------------------------------------------------------------------ tails


def plain_gpd(y):
    """The best of many ratios xi / beta, each with its own shape."""
    theta = np.concatenate([-1 + np.logspace(-7, -0.0001, 20_000), np.logspace(-7, 4, 40_000)]) / y.max()
    xi = np.log1p(np.outer(theta, y)).mean(axis=1)
    value = np.where(xi > -1, -np.log(xi / theta) - xi - 1, -np.inf)
    k = value.argmax()
    return xi[k], xi[k] / theta[k]


def gpd_like(y, w, xi, beta):
    z = 1 + xi * y / beta
    return -np.inf if (z <= 0).any() else -(w * (np.log(beta) + (1 + 1 / xi) * np.log(z))).sum()


@pytest.mark.parametrize("shape", [-0.3, 0.05, 0.4])
def test_weighted_fit_is_at_the_top_of_the_likelihood(shape):
    rng = np.random.default_rng(2)
    y = ((1 - rng.random(150)) ** -shape - 1) / shape * 0.7
    w = rng.integers(0, 4, 150)
    xi, beta = tails.weighted_gpd(y[w > 0], w[w > 0])
    best = gpd_like(y, w, xi, beta)
    assert all(gpd_like(y, w, xi + dx, beta + db) <= best + 1e-7 for dx in np.linspace(-0.5, 0.5, 41) for db in np.linspace(-0.3, 0.3, 41) if beta + db > 0 and abs(xi + dx) > 1e-9)
    assert np.allclose(tails.gpd_mle(np.repeat(y, w)), (xi, beta), atol=1e-3) and np.allclose(plain_gpd(np.repeat(y, w)), (xi, beta), atol=2e-3)


@pytest.mark.parametrize("xi", [-0.2, 0.0, 1e-10, 0.3, 0.9])
def test_scale_at_a_fixed_shape(xi):
    y = np.random.default_rng(4).exponential(size=80)
    beta = tails.scale_given_shape(y, xi)
    cost = lambda b: len(y) * np.log(b) + (y / b).sum() if abs(xi) < 1e-8 else len(y) * np.log(b) + (1 + 1 / xi) * np.log1p(xi * y / b).sum()
    assert all(cost(beta) <= cost(beta * f) + 1e-9 for f in (0.9, 0.99, 1.01, 1.1) if xi >= 0 or beta * f > -xi * y.max())


def test_gpd_risk_is_the_plain_one_whatever_the_partitions(spark):
    rng = np.random.default_rng(8)
    loss = rng.standard_t(3, 300)
    rows = [("a", float(v)) for v in loss] + [("b", float(v)) for v in loss[:40]]
    make = lambda parts: {(r["series"], r["b"], r["level"]): (r["var"], r["es"], r["source"]) for r in tails.gpd_risk(spark.createDataFrame(rows, "series string, loss double").repartition(parts), [0.95, 0.99], ["series"], 20, seed=3).collect()}
    got = make(1)
    assert got == make(5) and len(got) == 2 * 2 * 21
    for series, x in (("a", np.sort(loss)), ("b", np.sort(loss[:40]))):
        for b in range(-1, 20):
            draw = x if b < 0 else np.sort(x[np.random.Generator(np.random.Philox(key=[3, b])).integers(0, len(x), len(x))])
            u = np.quantile(draw, 0.9)
            y = draw[draw > u] - u
            for p in (0.95, 0.99):
                var, es, source = got[series, b, p]
                assert source == ("gpd" if len(y) >= 10 else "empirical")
                if source == "empirical":
                    v = np.quantile(draw, p)
                    want = v, draw[draw >= v].mean()
                else:
                    xi, beta = plain_gpd(y)
                    v = u + beta / min(xi, 0.95) * (((1 - p) * len(x) / len(y)) ** -min(xi, 0.95) - 1)
                    want = v, (v + beta - min(xi, 0.95) * u) / (1 - min(xi, 0.95))
                assert (var, es) == pytest.approx(want, rel=2e-3, abs=1e-6)


def test_marginals_keep_features_with_few_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(t, j, float(v)) for j, n in ((1, 80), (2, 80), (3, 40), (4, 1)) for t, v in enumerate(rng.normal(size=n))]
    rets = spark.createDataFrame(rows, "t long, j int, x double")
    got = tails.marginal_cdf(rets, tails.zhang_stephens(tails.exceedances(rets), ["j", "side"])).collect()
    assert len(got) == len(rows) and all(r["u"] is not None and 0 <= r["u"] <= 1 for r in got)
    for j in (1, 2, 3):
        order = [r["u"] for r in sorted((r for r in got if r["j"] == j), key=lambda r: next(v for t, k, v in rows if (t, k) == (r["t"], j)))]
        assert order == sorted(order)


# ------------------------------------------------------------------------------------------- permutations, spectra


def test_permutations_are_whole_and_by_hash(spark):
    df = spark.createDataFrame([(g, k) for g, n in (("a", 500), ("b", 7)) for k in range(n)], "g string, t long").repartition(5)
    got = {(r["g"], r["t"]): r["place"] for r in split.permuted(df, "t", 3, ["g"], buckets=16).collect()}
    for g, n in (("a", 500), ("b", 7)):
        assert [k for _, k in sorted((got[g, k], k) for k in range(n))] == sorted(range(n), key=lambda k: (uniform(3, k), k))


@pytest.mark.parametrize("rows", [4096, 9])
def test_spectrum_is_the_plain_one(spark, rows, monkeypatch):
    x = panel() * np.array([1, 5, 0.02]) + np.array([3, 0, 9])
    rets = spark.createDataFrame([(t, j, float(x[t, j])) for t in range(ROWS) for j in range(WIDTH)] + [(ROWS, 0, 1.0)], "t long, j int, x double")
    monkeypatch.setattr(dependence.moments, "__defaults__", (rows,))
    found = dependence.spectrum(rets)
    for kind, m in (("covariance", np.cov(x.T, bias=True)), ("correlation", np.corrcoef(x.T))):
        want = np.linalg.eigvalsh(m)[::-1]
        got = [r["eigenvalue"] for r in found.where(f"kind = '{kind}'").orderBy("k").collect()]
        assert got == pytest.approx(want.tolist(), rel=1e-9)
        rank = {(r["measure"], r["cut"]): r["k"] for r in dependence.effective_rank(found).where(f"kind = '{kind}'").collect()}
        assert all(rank["above", c] == (want > c * want[0]).sum() for c in dependence.RANK_CUTS)
        assert all(rank["share", c] == np.searchsorted(np.cumsum(want) / want.sum(), c) + 1 for c in dependence.SHARES)
        assert rank["participation", 1.0] == pytest.approx(want.sum() ** 2 / (want**2).sum())


def test_tail_dependence_by_group(spark):
    x = panel()
    rows = [(g, t, j, float(x[t, j])) for g, n in (("a", 150), ("b", 60)) for t in range(n) for j in range(WIDTH)]
    got = {(r["g"], r["i"], r["j"]): r["lam"] for r in dependence.tail_dependence(dependence.pseudo_obs(spark.createDataFrame(rows, "g string, t long, j int, x double"), ["g"]), 0.1, by=["g"]).collect()}
    for g, n in (("a", 150), ("b", 60)):
        u = (x[:n].argsort(axis=0).argsort(axis=0) + 1) / (n + 1) < 0.1
        for i in range(WIDTH):
            for j in range(i + 1, WIDTH):
                assert got[g, i, j] == pytest.approx((u[:, i] & u[:, j]).sum() / n / 0.1)


def test_ten_step_laws_are_plain_recursions(spark):
    from riskspark.operators import vol

    x, lam, floor, h = panel(), 0.94, 0.05, 4
    v = x[:100].var(axis=0)
    sigma = np.stack([np.sqrt(vol.ewma_path(x[:, j], lam, v[j], floor**2 * v[j])) for j in range(WIDTH)], axis=1)
    e = x / sigma
    cells = lambda rows, names: spark.createDataFrame(rows, names)
    paths = cells([(w, k, j, float(e[w + k, j])) for w in range(100 - h + 1) for k in range(h) for j in range(WIDTH)], "w long, k int, j int, e double")
    states = cells([(t, j, float(sigma[t, j])) for t in range(100, 110) for j in range(WIDTH)], "t long, j int, sigma double")
    start = cells([(j, float(v[j])) for j in range(WIDTH)], "j int, v double")
    got = {(r["t"], r["w"]): r["x"] for r in vol.fhs_path_laws(paths, states, start, h, lam, floor).collect()}
    assert len(got) == 10 * (100 - h + 1)
    for t in (100, 104, 109):
        for w in (0, 37, 96):
            s2, total = sigma[t] ** 2, 0.0
            for k in range(h):
                r = np.sqrt(s2) * e[w + k]
                total += r.mean()
                s2 = np.maximum(lam * s2 + (1 - lam) * r**2, floor**2 * v)
            assert got[t, w] == pytest.approx(total)


def test_student_scores_go_there_and_back():
    from riskspark.functions.special import t_cdf, t_ppf

    p = np.concatenate([10.0 ** -np.arange(2, 12), np.linspace(0.01, 0.99, 99), 1 - 10.0 ** -np.arange(2, 9)])
    for nu in (2.0, 4.0, 5.0, 30.0):
        assert np.allclose(t_cdf(t_ppf(p, nu), nu), p, rtol=1e-9)
    assert np.allclose(t_ppf(p, 2.0), (2 * p - 1) / np.sqrt(2 * p * (1 - p)), rtol=1e-6, atol=1e-7)
    z = np.linspace(-20, 20, 81)  # five degrees of freedom have a closed form
    a = np.arctan(z / np.sqrt(5))
    assert np.allclose(t_cdf(z, 5.0), 0.5 + (a + np.sin(a) * np.cos(a) * (1 + 2 / 3 * np.cos(a) ** 2)) / np.pi, atol=1e-12)
