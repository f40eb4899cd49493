"""Text files, splits and small helpers that the queries' SQL does not reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.functions.special import chi2_sf
from riskspark.operators import dependence, split
from riskspark.sources import text


def test_a_matrix_keeps_columns_of_numbers_and_the_order_of_lines(spark, tmp_path):
    lines = ["Date,a,b,c", "2020-01-01,1,,x", "2020-01-02,2,5,7"] + [f"2020-02-01,{k},{k}.5,9" for k in range(3, 500)]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    cells, names = text.numeric_matrix(spark, str(tmp_path / "m.csv"))
    got = {(r.t, r.j): r.x for r in cells.collect()}
    assert names == ["feat0", "feat1"] and len(got) == 2 * 499  # the header has a name too many
    assert got[0, 1] is None and [got[t, 0] for t in range(499)] == [float(k) for k in range(1, 500)]
    with pytest.raises(ValueError, match="1 cells .* 498 of 499"):
        text.require_finite(cells)


def test_a_matrix_without_header(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n3,4\n5,1e1\n")
    cells, names = text.numeric_matrix(spark, str(tmp_path / "m.csv"))
    assert names == ["feat0", "feat1"] and sorted((r.t, r.j, r.x) for r in cells.collect())[-1] == (2, 1, 10.0)
    rets = sorted((r.t, r.j, r.x) for r in text.matrix_returns(cells).collect())
    assert rets[0] == (0, 0, pytest.approx(np.log(3))) and len(rets) == 4


def test_an_extract_needs_its_columns(spark, tmp_path):
    (tmp_path / "q.csv").write_text("valor;price\n1;2\n")
    with pytest.raises(ValueError, match="CURRENCY, FI_ID"):
        text.scan_quotes(spark, str(tmp_path / "q.csv"))


def test_arrays_as_windows(spark, tmp_path):
    a = np.arange(24.0).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", a)
    got = {(r.w, r.k, r.j): r.x for r in text.array_windows(spark, str(tmp_path / "a.npy")).collect()}
    assert got == {(w, k, j): a[w, k, j] for w in range(2) for k in range(3) for j in range(4)}
    with pytest.raises(ValueError, match="longer"):
        text.array_windows(spark, str(tmp_path / "a.npy"), most_bytes=10)


@pytest.mark.parametrize("spec, label", [("a=x/y.parquet", "a"), ("runs/final/generated_windows.parquet", "final"), ("out/gen_hs.parquet", "hs"), ("out/other", "other")])
def test_labels_of_specs(spec, label):
    assert text.label_and_path(spec)[0] == label


def test_a_fingerprint_depends_on_rows_alone(spark):
    a = spark.range(100).select("id", F.when(F.col("id") > 3, F.col("id")).alias("x"))
    assert text.fingerprint(a) == text.fingerprint(a.repartition(7)) != text.fingerprint(a.where("id > 0"))


def test_split_ids_and_guards(spark):
    a = split.drawn_split(spark, 400, 10, 7)
    assert split.Split.restored(a.stored()) == a
    assert a.id != split.drawn_split(spark, 400, 10, 8).id
    assert split.Split(400, 10, (0, 10)).id == split.Split(400, 20, (0,)).id
    for wrong in ({"rows": 401}, {"rows": 400, "split_id": "other"}):
        with pytest.raises(ValueError):
            a.guard(**wrong)
    with pytest.raises(ValueError, match="id"):
        split.Split.restored(a.stored() | {"rows": 500})


@pytest.mark.parametrize("spread", [True, False])
def test_drawn_blocks_hold_out_what_they_should(spark, spread):
    got = split.drawn_blocks(spark, 409, 20, 0.2, F.sequence(F.lit(0), F.lit(9)), spread).collect()
    by = {}
    for r in got:
        by.setdefault(r["split"], []).append((r["b"], r["s"]))
    assert sorted(by) == list(range(10)) and len({tuple(v) for v in by.values()}) > 5
    for blocks in by.values():
        assert sorted(b for b, _ in blocks) == [0, 1, 2, 3] and all(s % 20 == 0 and 0 <= s < 400 for _, s in blocks)
        assert [s for _, s in sorted(blocks)] == sorted({s for _, s in blocks})
        if spread:
            assert sorted(s // 100 for _, s in blocks) == [0, 1, 2, 3]
    for rows, block, part in ((10, 20, 0.2), (400, 20, 0.01), (400, 0, 0.2)):
        with pytest.raises(ValueError, match="no block"):
            split.drawn_blocks(spark, rows, block, part, F.array(F.lit(0)))
    with pytest.raises(ValueError, match="horizon"):
        split.drawn_split(spark, 400, 10, 7, block=5)


def test_dependent_group_equals_a_plain_search(spark):
    m = np.random.default_rng(3).random((7, 7))
    m = (m + m.T) / 2
    pairs = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(7) for j in range(i + 1, 7)], "i int, j int, lam double")
    best = max(((i, j) for i in range(7) for j in range(i + 1, 7)), key=lambda p: m[p])
    chosen = list(best)
    while len(chosen) < 4:
        chosen.append(max((j for j in range(7) if j not in chosen), key=lambda j: m[chosen, j].mean()))
    assert [r.j for r in dependence.dependent_group(pairs, 4).orderBy("place").collect()] == chosen


def test_chi2_survival():
    assert chi2_sf(np.array([0.0, 3.841458820694124, 6.634896601021213])) == pytest.approx([1.0, 0.05, 0.01], abs=1e-9)
