"""Document fingerprints by consistent weighted sampling.

The terms of a document are its words, weighted by how often they occur. For each of the hash functions a term gets, from its own hash,
two gamma variables and a uniform one; they give the term a sampled weight and a race value, and the term with the least value is
the sample. Two documents get the same sample, term and sampled weight, with a probability that is their generalised
Jaccard similarity. A fingerprint holds 16 bits of each sample.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import ship

from .common import mixed, read_table, small

HASHES = 64
#: Words whose draws a worker remembers.
MEMO_ROWS = 60_000
#: Bytes of text in one range of identifiers, about.
RANGE_BYTES = 16 << 20
SALTS = mixed(np.arange(HASHES, dtype=np.uint64))


def draws(terms: np.ndarray) -> np.ndarray:
    """For term hashes and each hash function: r and beta, which place the steps of a weight, and the race value at weight one."""
    first = mixed(terms[:, None] ^ SALTS[None, :])
    second = mixed(first)
    third = second * np.uint64(0x9E3779B97F4A7C15) ^ first  # its high bits give beta
    uniform = lambda h: ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)
    lower = np.uint64(24)
    r = -np.log(uniform(first) * uniform(first << lower))  # gamma with shape 2
    beta = uniform(third)
    return np.stack([r, beta, np.log(-np.log(uniform(second) * uniform(second << lower))) + r * beta - r])


def sample_bits(terms: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """16 bits of each hash function's sample, a term hash and the step of its weight."""
    return (mixed(mixed(terms ^ SALTS) ^ mixed(steps.astype(np.int64).astype(np.uint64))) >> np.uint64(48)).astype(np.uint16)


class Sampler:
    """Samples of texts. Draws are remembered by word; when the memo is full, the half that was met least often goes."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.terms = np.empty(MEMO_ROWS, np.uint64)
        self.drawn = np.empty((3, MEMO_ROWS, HASHES), np.float32)
        self.met = np.zeros(MEMO_ROWS, np.int64)

    def forget(self) -> None:
        words = list(self.place)
        stay = np.sort(np.argsort(-self.met[: len(words)], kind="stable")[: MEMO_ROWS // 2])
        for table in (self.terms, self.met, *self.drawn):
            table[: len(stay)] = table[stay]
        self.met[: len(stay)] //= 2
        self.place = {words[k]: i for i, k in enumerate(stay.tolist())}

    def places(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > MEMO_ROWS:
            self.forget()
            new = [w for w in words if w not in self.place]
        if new:
            first = len(self.place)
            hashes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new], np.uint64)
            self.terms[first : first + len(new)] = hashes
            self.drawn[:, first : first + len(new)] = draws(hashes)
            self.met[first : first + len(new)] = 0
            self.place.update(zip(new, range(first, first + len(new))))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        self.met[at] += 1
        return at

    def fingerprint(self, text: str) -> np.ndarray:
        """The samples; a text without words has all zeros."""
        counts = Counter(text.split())
        if not counts:
            return np.zeros(HASHES, np.uint16)
        words, weights = list(counts), np.fromiter(counts.values(), np.float32, len(counts))
        every = np.arange(HASHES)
        best, terms, steps = np.full(HASHES, np.inf, np.float32), np.zeros(HASHES, np.uint64), np.zeros(HASHES, np.float32)
        for k in range(0, len(words), 4096):
            at, weight = self.places(words[k : k + 4096]), weights[k : k + 4096]
            race = self.drawn[2][at]
            many = np.flatnonzero(weight > 1)  # the step of weight one is zero
            r = self.drawn[0][at[many]]
            step = np.floor(np.log(weight[many])[:, None] / r + self.drawn[1][at[many]])
            race[many] -= r * step
            own = race.argmin(axis=0)
            value = race[own, every]
            place = np.full(len(at), -1)
            place[many] = np.arange(len(many))
            taken = np.where(place[own] >= 0, step[place[own], every] if len(many) else 0, 0)
            wins = value < best
            best, terms, steps = np.where(wins, value, best), np.where(wins, self.terms[at[own]], terms), np.where(wins, taken, steps)
        return sample_bits(terms, steps)


@lru_cache(1)
def sampler() -> Sampler:
    """One for each worker process."""
    return Sampler()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def range_of(value: Column, edges: list[int]) -> Column:
    """How many of the sorted edges are not above value, by halving."""
    table = F.lit(np.array(edges, np.int64))
    powers = [1 << k for k in reversed(range(len(edges).bit_length()))]
    ahead = lambda at, p: (at + p <= len(edges)) & (F.get(table, F.least(at + p, F.lit(len(edges))) - 1) <= value)
    return F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda at, p: F.when(ahead(at, p), at + p).otherwise(at))


def neighbours(docs: DataFrame) -> DataFrame:
    """Deals docs (doc_id, text) into ranges of identifiers, sorted, with the first row of the next range at the end of each.

    A range holds about RANGE_BYTES of text, however many there are; only ranges' first rows are sent twice. Columns: doc_id, text, range, extra.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // RANGE_BYTES
    edges = (docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0] or []) if n > 1 else []
    edges = sorted(set(edges))
    placed = docs.withColumn("range", F.coalesce(range_of(F.col("doc_id"), edges), F.lit(0)) if edges else F.lit(0))
    firsts = sorted(((r["range"], r["doc_id"]) for r in placed.select("range", "doc_id").groupBy("range").agg(F.min(F.struct("doc_id"))["doc_id"].alias("doc_id")).collect()), key=lambda f: f[0])  # one row a range
    if not firsts:
        return placed.withColumn("extra", F.lit(False))
    before = {f: firsts[k - 1][0] for k, (_, f) in enumerate(firsts)}
    ahead = docs.sparkSession.createDataFrame(list(before.items()), "first long, range int")
    heads = docs.join(F.broadcast(ahead), F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "range", F.lit(True).alias("extra"))  # one row a range
    both = placed.select("doc_id", "text", "range", F.lit(False).alias("extra")).unionByName(heads)
    return both.repartitionById(1 + firsts[-1][0], F.col("range")).sortWithinPartitions("range", "extra", "doc_id", "text")


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the start of `after`, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty. The document after the last is the first; a table of one row follows itself. Rows that repeat an identifier
    follow one another by text; null identifiers come first. An empty table gives no rows, other columns are not read.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_sampler, last = sampler(), None
        for b in small(batches):
            rows = []
            for i, text, at, extra in zip(*(c.to_pylist() for c in b.columns)):
                own = own_sampler.fingerprint(text)
                if last is not None and last[2] == at and not last[4]:
                    j, t, _, f, _ = last
                    e = edited(t, text)
                    g = own_sampler.fingerprint(e)
                    rows.append((j, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f.tobytes().hex(), g.tobytes().hex(), likeness(f, g), likeness(f, own)))
                last = (i, text, at, own, extra)
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    ship(docs.sparkSession)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return neighbours(thin).mapInArrow(compute, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fingerprints(read_table(spark, sf_dir, "documents"))
