"""Generators, labelled laws, nearest neighbours and recalibration against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions.special import t_cdf, t_ppf
from riskspark.operators import conditional, dependence, generators, tails


def test_the_source_is_student_t_and_keyed_by_window():
    x = np.stack([generators.source(3, w, 8, 2, 5.0) for w in range(4000)])
    assert np.array_equal(x[7], generators.source(3, 7, 8, 2, 5.0)) and not np.array_equal(x[7], generators.source(4, 7, 8, 2, 5.0))
    u = np.sort(t_cdf(x[:, 0, 0], 5.0))
    assert np.abs(u - (np.arange(4000) + 0.5) / 4000).max() < 1.63 / np.sqrt(4000)
    spread = lambda mix: np.stack([(generators.source(1, w, 40, 6, 4.0, mix) ** 2).mean() for w in range(800)]).std()
    assert spread("window") > 2 * spread("step")  # a shared mixing variable makes whole windows large or small
    with pytest.raises(ValueError, match="mix"):
        generators.source(0, 0, 2, 2, 5.0, "day")


def test_the_integrator_has_known_answers():
    x = np.array([[1.0, -2.0]])
    grown = generators.integrate(lambda v, t: 0.7 * v, x, 200)
    assert np.allclose(grown, x * np.exp(0.7), rtol=2e-3)
    assert np.allclose(generators.integrate(lambda v, t: np.full_like(v, 2 * t), x, 100), x + 1, atol=2e-2)
    coarse, fine = (np.abs(generators.integrate(lambda v, t: np.cos(3 * t) * v, x, n) - x * np.exp(np.sin(3) / 3)).max() for n in (50, 400))
    assert fine < coarse / 6
    a, b = np.array([[1.5, 0.2], [0.2, 0.7]]), np.array([3.0, -1.0])
    z = np.random.default_rng(0).normal(size=(5, 4, 2))
    assert np.allclose(generators.integrate(generators.affine_flow(a, b), z, 40), z @ a.T + b, atol=1e-9)


def test_flow_windows_have_the_moments_whatever_the_partitions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3)) @ np.array([[1.0, 0.4, 0], [0, 0.5, 0.1], [0, 0, 2.0]]) + np.array([0.1, -0.2, 0.0])
    rets = spark.createDataFrame([(t, j + 1, float(x[t, j])) for t in range(900) for j in range(3)], "t long, j int, x double")
    names, a, b = generators.fitted_flow(dependence.together(dependence.moments(rets, 100)))
    assert names == [1, 2, 3] and np.allclose(a @ a.T * 5 / 3, np.cov(x.T, bias=True)) and np.allclose(b, x.mean(axis=0))
    got = generators.flow_windows(spark, "flow", 3000, 4, names, a, b, nu=8.0, seed=5, steps=10).toPandas()
    assert sorted(got.columns) == sorted(["label", "w", "k", "j", "x"]) and len(got) == 3000 * 12
    m = got.pivot(index=["w", "k"], columns="j", values="x").to_numpy()
    assert np.allclose(m.mean(axis=0), b, atol=0.08) and np.allclose(np.cov(m.T), a @ a.T * 8 / 6, atol=0.25)
    again = generators.flow_windows(spark, "flow", 30, 4, names, a, b, nu=8.0, seed=5, steps=10).toPandas()
    one = got[got.w < 30].sort_values(["w", "k", "j"])["x"].to_numpy()
    assert np.allclose(again.sort_values(["w", "k", "j"])["x"].to_numpy(), one, rtol=1e-12)


def test_label_laws_are_plain_samples(spark):
    rng = np.random.default_rng(4)
    cells = [(label, w, k, j, float(rng.normal())) for label, n in (("a", 200), ("b", 130)) for w in range(n) for k in range(4) for j in (1, 2)]
    windows = spark.createDataFrame(cells, "label string, w long, k int, j int, x double")
    known = spark.createDataFrame([(0, h, k, 10 * k, float(rng.normal())) for h in (1, 3) for k in range(50)], "split long, h int, k long, t long, x double")
    found = conditional.label_laws(windows, known, [0.1, 0.05])
    seen = {(r["model"], r["h"], r["k"]): r for r in found.where("k IS NOT NULL").collect()}
    assert len(seen) == 2 * 2 * 50 and found.where("k IS NULL").count() == 4
    for label, n in (("a", 200), ("b", 130)):
        for h in (1, 3):
            law = np.sort([sum(x for c, v, k, _, x in cells if c == label and v == w and k < h) / 2 for w in range(n)])
            for r in known.where(f"h = {h}").collect():
                s = seen[label, h, r["k"]]
                assert s["n"] == 50 and s["cells"] == n and s["u"] == pytest.approx(np.clip((law <= r["x"]).mean(), 0.5 / n, 1 - 0.5 / n))
                assert s["var"][0] == pytest.approx(-law[int(np.ceil(0.1 * n)) - 1]) and s["es"][0] == pytest.approx(-law[: n // 10].mean())


@pytest.mark.parametrize("rows", [7, 40, 5000])
def test_nearest_is_exact(spark, rows):
    rng = np.random.default_rng(6)
    base = np.concatenate([rng.normal(size=(150, 5)) * s for s in (0.1, 1, 6)] + [np.ones((4, 5))])
    ask = np.concatenate([rng.normal(size=(40, 5)) * 3, base[:3], np.zeros((1, 5)), np.full((1, 5), 90.0)])
    table = lambda m, c, at: spark.createDataFrame([(at + k, [float(v) for v in x]) for k, x in enumerate(m)], f"{c} long, v array<double>")
    d = np.sqrt(((ask[:, None] - base[None]) ** 2).sum(-1)).min(axis=1)
    got = {r["q"]: r["d"] for r in dependence.nearest(table(ask, "q", 1 << 60), table(base, "b", 0), rows).collect()}
    assert [got[(1 << 60) + k] for k in range(len(ask))] == pytest.approx(d.tolist(), abs=1e-6)
    own = np.sqrt(((base[:, None] - base[None]) ** 2).sum(-1))
    np.fill_diagonal(own, np.inf)
    got = {r["q"]: r["d"] for r in dependence.nearest(table(base, "q", 0), table(base, "b", 0), rows).collect()}
    assert [got[k] for k in range(len(base))] == pytest.approx(own.min(axis=1).tolist(), abs=1e-6)
    lone = dependence.nearest(table(base[:1], "q", 0), table(base[:1], "b", 0), rows).collect()
    assert [(r["q"], r["d"]) for r in lone] == [(0, None)]


def test_nearest_shuffles_no_vector_for_each_block(spark):
    """Blocks meet by replication; what is shuffled afterwards are minima. A base without rows leaves every query, without a distance."""
    rng = np.random.default_rng(8)
    table = lambda c, n: spark.createDataFrame([(k, [float(v) for v in rng.normal(size=4)]) for k in range(n)], f"{c} long, v array<double>")
    found = dependence.nearest(table("q", 60), table("b", 70), 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapGroupsInPandas" not in plan
    none = dependence.nearest(table("q", 5), table("b", 1).where("b < 0"), 10).collect()
    assert sorted((r["q"], r["d"]) for r in none) == [(k, None) for k in range(5)]


def test_recalibration_is_the_plain_map(spark):
    rng = np.random.default_rng(7)
    mix = {1: rng.normal(size=400), 2: rng.exponential(size=90), 3: np.array([0.3])}
    sample = {j: np.concatenate([rng.normal(size=60) * 4, [float(mix[j].min()), float(mix[j].max())]]) for j in mix}
    rows = lambda m: [(t, j, float(v)) for j, x in m.items() for t, v in enumerate(x)]
    got = tails.recalibrated(spark.createDataFrame(rows(sample), "t long, j int, x double"), spark.createDataFrame(rows(mix), "t long, j int, x double").select("j", "x"), tails.student4).collect()
    found = {(r["j"], r["t"]): r["y"] for r in got}
    assert len(found) == len(got) == sum(map(len, sample.values()))
    for j, x in sample.items():
        z = np.sort(mix[j])
        if len(z) < 2:
            assert all(found[j, t] is None for t in range(len(x)))
            continue
        q, m = t_ppf(np.arange(1, len(z) + 1) / (len(z) + 1.0), 4.0), max(len(z) // 100, 1)
        y = np.interp(x, z, q)
        y = np.where(x < z[0], q[0] + (x - z[0]) * (q[m] - q[0]) / (z[m] - z[0]), np.where(x > z[-1], q[-1] + (x - z[-1]) * (q[-1] - q[-1 - m]) / (z[-1] - z[-1 - m]), y))
        assert [found[j, t] for t in range(len(x))] == pytest.approx(y.tolist(), abs=1e-6)


def test_the_closed_quantile(spark):
    p = [0.001, 0.2, 0.5, 0.77, 0.9999]
    got = [r["y"] for r in spark.createDataFrame([(v,) for v in p], "p double").select(tails.student4(F.col("p")).alias("y")).collect()]
    assert got == pytest.approx(t_ppf(np.array(p), 4.0).tolist(), abs=1e-6)


def test_sources_have_to_share_one_split(spark, tmp_path):
    from riskspark.operators import split
    from riskspark.sources import sinks

    w = spark.createDataFrame([(0, 0, 1, 0.5)], "w long, k int, j int, x double")
    one, other = split.Split(100, 10, (20,)), split.Split(100, 10, (30,))
    for name, s in (("a", one), ("b", one), ("c", other)):
        sinks.write_generated(w, s, f"{tmp_path}/{name}")
    w.write.parquet(f"{tmp_path}/bare/windows")
    spec = lambda *names: [f"{n}={tmp_path}/{n}" for n in names]
    table, found = sinks.read_generated(spark, spec("a", "b"), 100)
    assert found == one and sorted(r["label"] for r in table.collect()) == ["a", "b"]
    with pytest.raises(ValueError, match="2 splits"):
        sinks.read_generated(spark, spec("a", "c"), 100)
    with pytest.raises(ValueError, match="no source has"):
        sinks.read_generated(spark, spec("bare"), 100)
    with pytest.raises(ValueError, match="bare has no"):
        sinks.read_generated(spark, spec("a", "bare"), 100)
    with pytest.raises(ValueError, match="rows"):
        sinks.read_generated(spark, spec("a"), 99)
    assert sinks.read_generated(spark, spec("bare"), 100, allow_missing=True)[1] is None
    assert sinks.read_generated(spark, spec("a", "bare"), 100, allow_missing=True)[1] == one


def test_bands_follow_from_labels(spark):
    labels = spark.createDataFrame([("flow_u0.90",), ("x_u.02",), ("plain",), ("a_u0.5_b",), ("u1.00",)], "label string")
    got = {r["label"]: (r["level"], round(r["lo"], 6), round(r["hi"], 6)) for r in generators.bands(labels).collect()}
    assert got == {"flow_u0.90": (0.9, 0.85, 0.95), "x_u.02": (0.02, 0.0, 0.07), "a_u0.5_b": (0.5, 0.45, 0.55)}


def test_another_source_takes_the_place_of_the_default(spark):
    ones = lambda seed, w, n, width, nu, mix: np.full((n, width), float(w))
    got = generators.flow_windows(spark, "x", 3, 2, ["a", "b"], 2 * np.eye(2), np.array([1.0, 0.0]), draw=ones, steps=5, scale=10.0).collect()
    assert {(r["w"], r["k"], r["j"]): round(r["x"], 6) for r in got} == {(w, k, j): 10 * (2 * w + (j == "a")) for w in range(3) for k in range(2) for j in "ab"}
