"""License scans, filter audits and whitening against plain versions."""

import itertools
import math
import re
import warnings
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    import sre_parse

from riskspark.llm import filter_audit, license_rules, licenses, whitening

from .test_operators import SCHEMA, rows

NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "under the MIT license under the mit license, under the MIT licenses", "SPDX-License-Identifier: GPL-3.0-or-later", "He lost his driver license near the House of Commons.",
    "the MIT License (MIT) and, elsewhere, All rights reserved", "apache license version 2 and CC BY NC SA 4.0 cc by nc", "License plate 22; licensed to kill",
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
]


@pytest.fixture(scope="module")
def docs(spark):
    base = rows()
    more = [(500 + k, t, *base[0][2:]) for k, t in enumerate(NOTICES)]
    return spark.createDataFrame(base + more, SCHEMA).repartition(3)


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_scan(text):
    """Every rule tried everywhere; of detections each is held against each."""
    words = plain_words(text)
    line = " ".join(words).encode()
    word_at = lambda at: line[:at].count(b" ")
    found = []
    for rule in licenses.parsed():
        if rule.length:
            phrase = licenses.PHRASES[rule.number][0].split()
            found += [(k, k + len(phrase) - 1, rule) for k in range(len(words)) if words[k : k + len(phrase)] == phrase]
        else:
            found += [(word_at(m.start()), word_at(m.end() - 1), rule) for m in rule.pattern.finditer(line)]
    rank = lambda r: (-r.priority, r.number)

    def suppressed(x):
        a, b, r = x
        if r.priority == licenses.PHRASE:
            return False
        inside = [(c, d, s) for c, d, s in found if c <= a and b <= d and s.priority >= r.priority and (c, d, s) != x]
        return any(s.priority > r.priority or (c, d) != (a, b) or rank(s) < rank(r) for c, d, s in inside)

    return len(words), sorted((a, b, r.label, r.number) for a, b, r in found if not suppressed((a, b, r)) and r.label != "-")


def test_license_scan_is_the_plain_one(docs):
    want = Counter((r["doc_id"], *map(str, plain_scan(r["text"]))) for r in docs.select("doc_id", "text").collect())
    got = licenses.scan(docs)
    assert set(docs.columns) < set(got.columns)
    found = Counter((r["doc_id"], str(r["n_words"]), str(sorted((d["first"], d["last"], d["label"], d["rule"]) for d in r["detections"]))) for r in got.collect())
    assert found == want
    again = licenses.scan(got)
    assert again.columns == got.columns and again.count() == got.count()
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_scan_labels():
    of = lambda t: {r.label for _, _, r in licenses.resolved(licenses.matches(licenses.words_of(t.encode()), licenses.by_key(license_rules.RULES, licenses.PHRASES)))}
    assert of(NOTICES[0]) == {"mit"} and of(NOTICES[1]) == {"apache-2"} and of(NOTICES[2]) == {"cc-by-nc"} and of(NOTICES[3]) == {"gpl-3"}
    assert of(NOTICES[5]) == {"gpl-3-or-later"} and of(NOTICES[6]) == set() and of(NOTICES[9]) == set()
    assert of(NOTICES[8]) == {"apache-2", "cc-by-nc", "cc-by-nc-sa"} and of("the quick brown fox") == set()


def examples(node):
    """One text for each way through a pattern's alternatives, with what may be left out left out and, once, put in."""
    out = [""]
    for op, arg in node:
        name = str(op)
        if name == "LITERAL":
            part = [chr(arg)]
        elif name == "IN":
            part = [chr(a if str(o) == "LITERAL" else a[0]) for o, a in arg]
        elif name in ("ANY", "NOT_LITERAL"):
            part = ["z"]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, _, sub = arg
            part = list(dict.fromkeys([x * n for x in examples(sub) for n in {low, max(1, low)}]))
        elif name == "SUBPATTERN":
            part = examples(arg[-1])
        elif name == "BRANCH":
            part = [x for sub in arg[1] for x in examples(sub)]
        else:
            part = [""]
        out = [a + b for a in out for b in part][:400]
    return out


def test_every_rule_matches_its_examples_and_needs_its_keywords():
    rules = [r for r in licenses.parsed() if not r.length]
    assert len(rules) > 300 and len({r.label for r in rules}) > 100
    for rule, line in zip(rules, license_rules.RULES.strip().splitlines()):
        pattern = line.split(" | ", 3)[3].strip()
        for text in examples(sre_parse.parse(pattern)):
            found = rule.pattern.search(text.strip().encode())
            if found:
                assert rule.keys <= set(found.group().split()), (line, text)
        assert any(rule.pattern.search(t.strip().encode()) for t in examples(sre_parse.parse(pattern))), line


def test_license_contract(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.op11_license_scans(spark, f"file://{tmp_path}").collect()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        words = plain_words(r["text"])
        base = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        want.add((r["doc_id"], len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base}))))
    assert got == want and {r["score"] <= 1 for r in licenses.op11_license_scans(spark, f"file://{tmp_path}").collect()} == {True}


def test_phrases_that_overlap_themselves_are_all_found():
    gate = licenses.by_key("a | 1 | zebra | zebra", (("x y x", "l"),))
    assert [(a, b) for a, b, _ in licenses.resolved(licenses.matches(licenses.words_of(b"x y x y X"), gate))] == [(0, 2), (2, 4)]


# --------------------------------------------------------------------------------------------------------- filters


def plain_audit(docs, labels):
    texts, out, totals = defaultdict(list), defaultdict(lambda: [0] * 6), defaultdict(int)
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""].append(i)
    for i, t, source in docs:
        body, part = t or "", source or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", body)
        fails = {c for c, bad in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", body)) > 2 * len(body), bool(re.search(r"[#$%&*|]", body)),
            i is not None and any(k < i for k in texts[body]),
        )) if bad}
        good, toxic = any(k == i and q == 1 for k, q, _ in labels if k is not None), any(k == i and x == 1 for k, _, x in labels if k is not None)
        for order in itertools.permutations("ABCDE"):
            gone = False
            for step, c in enumerate(order, 1):
                row, removed = out[part, "".join(order), step], not gone and c in fails
                row[1] += removed
                row[2] += gone and c in fails
                row[3] += fails == {c}
                row[4] += removed and good
                row[5] += removed and toxic
                gone = gone or removed
                row[0] += not gone
                totals[part, c] += removed
    return {(*k, *v, totals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = [(7, 1, 0), (7, 0, 1), (None, 1, 1), (14, None, 1), (21, 1, None), (999, 1, 1)] + [(k, k % 2, k % 3 == 0) for k in range(30, 60)]


def labels_table(spark):
    return spark.createDataFrame([(a, b, None if c is None else int(c), "x") for a, b, c in LABELS], "doc_id long, quality int, toxic int, part string")


def test_filter_audit_is_the_plain_one(spark, docs, monkeypatch):
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], LABELS)
    flags = filter_audit.flagged(docs, labels_table(spark))
    assert flags.count() == docs.count()
    got = filter_audit.replayed(flags)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 1)  # no digest is looked up by broadcast
    assert {tuple(r) for r in filter_audit.replayed(filter_audit.flagged(docs, labels_table(spark))).collect()} == want
    assert filter_audit.replayed(filter_audit.flagged(docs.limit(0), labels_table(spark))).count() == 0
    assert filter_audit.flagged(docs, labels_table(spark).limit(0)).where("good OR toxic").count() == 0


def test_filter_audit_is_its_sql(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels_table(spark).write.parquet(f"file://{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = filter_audit.op12_filter_audit(spark, f"file://{tmp_path}"), con.execute(filter_audit.OP12_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# ------------------------------------------------------------------------------------------------------- whitening


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) * np.array([5, 3, 2, 1, 0.5, 0.1]) + np.array([100, -3, 0, 7, 0, 0])
    out = [(k, [float(v) for v in x], k % 3) for k, x in enumerate(base)]
    out += [(1000 + k, out[5][1], 1) for k in range(150)] + [out[5], (None, out[6][1], 1)]
    return out + [(2000, None, 1), (2001, [], 1), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2003, [math.nan] + [0.0] * 5, 1), (2004, [math.inf] + [0.0] * 5, 1), (2005, [1.0, 2.0], 1), (2006, [-0.0] * 6, 1)]


def plain_whitening(rows):
    x = np.array([np.floor(256 * np.array(v, float)).astype(np.int64) + 0 for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, v = np.linalg.eigh(np.cov(fit.T, bias=True))
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x], (x - s / n) @ v[:, ::-1][:, :4] / np.sqrt(e[::-1][:4]), e[::-1][:4] / e.sum()


def sound(rows):
    return [r[:2] for r in rows if r[1] and len(r[1]) == 6 and all(c is not None and math.isfinite(c) for c in r[1])]


@pytest.mark.parametrize(("block", "fan"), [(4096, 16), (8, 2)])
def test_whitening_is_the_plain_one(spark, monkeypatch, block, fan):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "FAN", fan)
    table = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").repartition(7).withColumn("x", F.lit("clash"))
    rows = sound(vectors())
    n, dev, white, explained = plain_whitening(rows)
    got = whitening.whiten(table).collect()
    assert len(got) == 4 * len(rows)
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter((i, d) for (i, _), d in zip(rows, dev))
    assert {r["n"] for r in got} == {n} and all(abs(r["identity_error"]) < 1e-10 for r in got)
    found = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(4):
        ours, theirs = np.array([found[i, c + 1]["whitened"] for i, _ in rows]), white[:, c]
        assert np.abs(ours - theirs * np.sign(ours @ theirs)).max() < 1e-9
        assert abs(found[rows[0][0], c + 1]["explained"] / explained[c] - 1) < 1e-10


def test_states_merge_without_loss():
    x = np.random.default_rng(1).integers(-500, 500, size=(90, 5))
    whole = whitening.State.of(x)
    parts = whitening.together(whitening.State.of(p) for p in np.split(x, [1, 3, 40]))
    assert parts.n == 90 and parts.sums == whole.sums and np.allclose(parts.s, whole.s, rtol=1e-12)
    assert np.allclose(parts.vt.T * parts.s**2 @ parts.vt, (x - x.mean(0)).T @ (x - x.mean(0)))


def test_whitening_of_few_or_equal_vectors(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == 0 and make([(1, None)]).count() == 0
    one = make([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])]).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, 0.0, None)}
    two = make([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 5.0])]).collect()
    assert {(r["component"], r["whitened"] is None, round(r["explained"], 9)) for r in two} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}
    assert {abs(round(r["whitened"], 9)) for r in two if r["component"] == 1} == {1.0}


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1, 2], [3_000_000_000, 5], [10_000_000_000_000, 5]])
    assert whitening.deviations(x, 1, [0, 0]) == [5, 9_000_000_000_000_000_025, None]
