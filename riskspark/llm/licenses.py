"""License scans by ordered signature rules.

A text becomes the sequence of its words. A rule is tried only where the text has all of its keywords; the rules of license_rules.py and the phrases asked for are
regular expressions over the words. Of detections that overlap, one that lies within another of the same or a higher priority is suppressed; of equal
intervals and priorities the earlier rule stays. Phrases come before all rules and are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small
from .license_rules import RULES

#: (words, label): wherever these words stand one after another.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: How sure a detection of each priority is.
SURE = {7: 1.0, 5: 0.99, 4: 0.95, 3: 0.9, 2: 0.7, 1: 0.3}
NONE, PHRASE = "-", 7
#: A-Z become small letters, and all ASCII signs but letters and digits become blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DETECTIONS = "array<struct<label: string, priority: int, rule: int, first: long, last: long>>"


@dataclass(frozen=True)
class Rule:
    """`number` is the rule's place in the order; keys are words that each match holds; a phrase has `length` words, a rule's match as many as it takes."""

    number: int
    label: str
    priority: int
    keys: frozenset[bytes]
    pattern: re.Pattern[bytes]
    length: int = 0


def whole_words(pattern: str) -> re.Pattern[bytes]:
    return re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())


def parsed(rules: str = RULES, phrases: Iterable[tuple[str, str]] = PHRASES) -> list[Rule]:
    """Phrases first, matched at every place where they stand, then the rules in their order."""
    keyed = lambda words: frozenset(w.encode() for w in words.split())
    out = [Rule(k, label, PHRASE, keyed(words), re.compile(rf"(?<![^ ])(?={re.escape(words)}(?![^ ]))".encode()), len(words.split())) for k, (words, label) in enumerate(phrases)]
    for line in rules.strip().splitlines():
        label, priority, keys, pattern = (part.strip() for part in line.split(" | ", 3))
        out.append(Rule(len(out), label, int(priority), keyed(keys), whole_words(pattern)))
    return out


@lru_cache(maxsize=8)
def by_key(rules: str, phrases: tuple[tuple[str, str], ...]) -> dict[bytes, list[Rule]]:
    """The rules by one of their keywords, the longest."""
    found: dict[bytes, list[Rule]] = {}
    for rule in parsed(rules, phrases):
        found.setdefault(max(rule.keys, key=lambda w: (len(w), w)), []).append(rule)
    return found


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def matches(words: list[bytes], gate: dict[bytes, list[Rule]]) -> list[tuple[int, int, Rule]]:
    """(first word, last word, rule) of every match of the rules whose keywords are all there."""
    held = set(words)
    rules = [r for w in gate.keys() & held for r in gate[w] if r.keys <= held]
    if not rules:
        return []
    line = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    out = []
    for rule in rules:
        for m in rule.pattern.finditer(line):
            first = bisect_right(starts, m.start()) - 1
            out.append((first, first + rule.length - 1 if rule.length else bisect_right(starts, m.end() - 1) - 1, rule))
    return out


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What is not suppressed, in order of place. Lying within is transitive, so it does not matter whether the outer one is suppressed itself."""
    kept, outer = [], []  # outer: intervals of higher priorities
    for priority in sorted({r.priority for _, _, r in found}, reverse=True):
        level = sorted((x for x in found if x[2].priority == priority), key=lambda x: (x[0], -x[1], x[2].number))
        outer.sort()
        firsts, reach, most = [a for a, _ in outer], [], -1
        for _, b in outer:
            reach.append(most := max(most, b))
        end = -1
        for a, b, rule in level:
            k = bisect_right(firsts, a)
            if priority == PHRASE or not (k and reach[k - 1] >= b or end >= b):
                kept.append((a, b, rule))
            end = max(end, b)
        outer += [(a, b) for a, b, _ in level]
    return sorted((x for x in kept if x[2].label != NONE), key=lambda x: (x[0], x[1], x[2].number))


def certainty(found: list[tuple[int, int, Rule]]) -> float:
    """The chance that at least one detection is right, each label counted once, as its surest detection."""
    best: dict[str, float] = {}
    for _, _, r in found:
        best[r.label] = max(best.get(r.label, 0.0), SURE[r.priority])
    wrong = 1.0
    for p in best.values():
        wrong *= 1 - p
    return 1 - wrong


def scan(docs: DataFrame, rules: str = RULES, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """docs with n_words, detections (label, priority, rule, first and last word from 0; phrases have priority 7) and license_score.

    Columns of these names are replaced, all others stay. A null text has no words and no detections, and scores 0, and so does a text in which nothing is found.
    Texts of any length are read whole, in time that grows with their length times the rules whose keywords they hold. Repeated rows have rows
    of their own, an empty table gives none.
    """
    new = ["n_words", "detections", "license_score"]
    names = [c for c in docs.columns if c not in new]
    place = names.index("text")
    kept = docs.select(*[F.col("`" + c.replace("`", "``") + "`") for c in names])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = by_key(rules, phrases)
        for b in small(batches):
            sizes, spans, scores = [], [], []
            for text in b.column(place).cast(pa.binary()).to_pylist():
                words = words_of(text)
                found = resolved(matches(words, gate))
                sizes.append(len(words))
                spans.append([{"label": r.label, "priority": r.priority, "rule": r.number, "first": x, "last": y} for x, y, r in found])
                scores.append(certainty(found))
            kind = pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("rule", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(scores, pa.float64())], [*names, *new])

    schema = kept.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(DETECTIONS).alias("detections"), F.lit(0.0).alias("license_score")).schema
    return kept.mapInArrow(apply, schema)


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    phrases = F.filter("detections", lambda d: d["priority"] == PHRASE)
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda d: d["label"]))), ",")
    firsts = F.transform(phrases, lambda d: d["first"])
    return found.select(
        "doc_id", "n_words", F.size(phrases).cast("long").alias("n_base"), F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        listed(phrases).alias("base_labels"), listed(F.col("detections")).alias("labels"), F.col("license_score").alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
