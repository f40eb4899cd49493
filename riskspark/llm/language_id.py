"""Language identification by rank-order profiles of character n-grams.

A profile ranks the most frequent n-grams of one to three letters, with word ends, by count. A document's own ranking is held against
each language's: the out-of-place distance adds up how far apart each of its n-grams stands in the two, and the length of the profile for those
that the language's profile lacks. The nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.session import ship

from .common import in_one, read_table, saved, small

#: N-grams in a profile.
PROFILE = 300
UNKNOWN = "und"
#: Code points whose n-grams are made at once.
SPAN = 1 << 20
#: N-grams that a task holds for one language before it sends them on.
HELD = 500_000


@lru_cache(1)
def letters() -> np.ndarray:
    """Each code point itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes, in ascending order, of all n-grams of one to three letters in lower case, and how often each occurs.

    A code holds the code points, 21 bits each. A word's end counts as a space, and no n-gram spans two words.
    """
    x = letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")]
    found = []
    for k in range(0, len(x), SPAN):  # each span makes the n-grams that begin in it
        a = x[k : k + SPAN + 2]
        is_letter, n = a != 32, min(SPAN, len(a))
        pair = a[:-1] << 21 | a[1:]
        both, middle = is_letter[:-1] | is_letter[1:], is_letter[1:-1]
        found += [a[:n][is_letter[:n]], pair[:n][both[:n]], (pair[:-1] << 21 | a[2:])[:n][middle[:n]]]
    codes = np.concatenate(found)
    codes.sort()
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[starts], np.diff(np.append(starts, len(codes)))


def learn(docs: DataFrame, lang: str = "lang") -> list[tuple[str, np.ndarray]]:
    """(language, codes of its profile by rank) of rows that have text and language, from all their text, by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(name: str) -> pa.RecordBatch:
            codes, n = held.pop(name)
            return pa.record_batch([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for b in small(batches, 250):
            texts: dict[str, list[str]] = {}
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(name, []).append(text)
            for name, own in texts.items():
                more = [gram_counts(" ".join(own))]
                if name in held:
                    more.append(held[name])
                codes, where = np.unique(np.concatenate([c for c, _ in more]), return_inverse=True)
                held[name] = codes, np.bincount(where, np.concatenate([n for _, n in more]), len(codes)).astype(np.int64)
                if len(codes) > HELD:
                    yield out(name)
        for name in list(held):
            yield out(name)

    ship(docs.sparkSession)
    rows = docs.select(F.col(lang).alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL")
    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    # First the most frequent of each of many slices, so that no task gathers all n-grams of a language.
    slices = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    top = saved(total.withColumn("k", F.row_number().over(slices)).where(F.col("k") <= PROFILE).drop("k"), "profile-slices")
    best = top.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= PROFILE)
    model: dict[str, list] = {}
    for r in best.collect():  # PROFILE rows for each language; the model goes to all tasks
        model.setdefault(r["lang"], []).append((r["k"], r["gram"]))
    return [(x, np.array([g for _, g in sorted(model[x])], np.int64)) for x in sorted(model)]


def nearest(text: str | None, codes: np.ndarray, ranks: np.ndarray) -> tuple[int, float, int] | None:
    """The place of the nearest language, the score and the text's grade, or None if the text has no letter. ranks: of each of codes by language, -1 if it has none."""
    if text is None or not len(codes):
        return None
    grams, counts = gram_counts(text)
    if not len(grams):
        return None
    top = grams[np.argsort(-counts, kind="stable")[:PROFILE]]
    at = np.minimum(np.searchsorted(codes, top), len(codes) - 1)
    theirs = np.where((codes[at] == top)[:, None], ranks[at], -1)
    apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(top))[:, None])).sum(axis=0)
    best = int(apart.argmin())
    return best, 1 - float(apart[best]) / (PROFILE * len(top)), len(top).bit_length()


def places(model: list[tuple[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All codes of the model in order, and of each its rank by language, -1 if the language lacks it."""
    codes = np.unique(np.concatenate([g for _, g in model])) if model else np.zeros(0, np.int64)
    ranks = np.full((len(codes), len(model)), -1, np.int64)
    for k, (_, grams) in enumerate(model):
        ranks[np.searchsorted(codes, grams), k] = np.arange(len(grams))
    return codes, ranks


def with_language(docs: DataFrame, model: list[tuple[str, np.ndarray]], grade: bool = False) -> DataFrame:
    """docs with lang_pred and lang_score, from the text alone, and if asked for lang_grade, the binary logarithm of how many of its n-grams are ranked.

    Texts that are null or have no letter get `und` and score 0; so do all texts if the model is empty. Of languages at the same distance the
    first in alphabetical order wins. The score is 1 less the distance as a part of the largest possible. Columns of these names are replaced.
    Repeated rows have rows of their own, an empty table gives none.
    """
    ship(docs.sparkSession)
    languages = [x for x, _ in model]
    codes, ranks = places(model)
    new = ["lang_pred", "lang_score"] + ["lang_grade"] * grade
    names = [c for c in docs.columns if c not in new]
    place = names.index("text")
    kept = docs.select(*[F.col(f"`{c}`") for c in names])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [nearest(t, codes, ranks) for t in b.column(place).to_pylist()]
            more = pa.array([languages[f[0]] if f else UNKNOWN for f in found], pa.string()), pa.array([f[1] if f else 0.0 for f in found], pa.float64()), pa.array([f[2] if f else 0 for f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, *more[: len(new)]], [*names, *new])

    schema = kept.select("*", *[F.lit(x).alias(c) for c, x in zip(new, ("", 0.0, 0))]).schema
    return kept.mapInArrow(apply, schema)


def bars(docs: DataFrame, model: list[tuple[str, np.ndarray]], lang: str = "lang") -> dict[int, float]:
    """The least score, by grade, that a text in a learned language has.

    It lies as far below the half-percent quantile as that lies below the median of the scores of all labelled texts nearest to their own label, and of their
    beginnings of 1, 2, 4 to 128 words: so that a short text is held against texts as short.
    """
    names = [x for x, _ in model]
    codes, ranks = places(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = text.split(maxsplit=129)
                for piece in [text, *(" ".join(words[: 1 << k]) for k in range(8) if 1 << k < len(words))]:
                    found = nearest(piece, codes, ranks)
                    if found and names[found[0]] == name:
                        out.append((found[2], found[1]))
            yield pa.record_batch([pa.array([g for g, _ in out], pa.int32()), pa.array([x for _, x in out], pa.float64())], ["grade", "score"])

    rows = docs.select(F.col(lang).alias("lang"), "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(score, "grade int, score double")
    cuts = rows.groupBy("grade").agg(F.percentile_approx("score", [0.005, 0.5], 10_000).alias("q")).collect()  # nine grades
    return {r["grade"]: 2 * r["q"][0] - r["q"][1] for r in cuts}


def accept_language(docs: DataFrame, least: float = 0.15) -> DataFrame:
    """docs, all its columns, without the rows whose text has no letter, or is further from every profile learned from docs itself than labelled texts of
    its number of n-grams are, or than `least`. A grade that no labelled text has takes the bar of the nearest that one has.

    Null texts have no letter and go; so does every row if no row has a language. Repeated rows stay or go together, whatever their other columns; an empty
    table gives no rows.
    """
    model = learn(docs)
    known = bars(docs, model)
    bar = [max(least, known[min(known, key=lambda h: (abs(h - g), h))]) if known else least for g in range(PROFILE.bit_length() + 1)]
    found = with_language(in_one(docs).select("row", F.col("row.text").alias("text")), model, grade=True)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= F.element_at(F.array(*map(F.lit, bar)), F.col("lang_grade") + 1))).select("row.*")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = learn(docs.where(~F.coalesce("held_out", F.lit(False))))
    found = with_language(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
