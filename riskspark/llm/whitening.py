"""Embedding whitening by hierarchical merging of singular value decompositions.

Each task decomposes its own vectors, a block at a time, and keeps a state: their number, exact sums, mean, and all singular values and right singular vectors
of the vectors less their mean. Two states merge without loss: the scaled vectors of both are stacked, with one more row that puts right the difference of the
means, and decomposed again. Tasks' states merge FAN at a time, level by level, so no task sees more than a few states, each as large as the square
of the dimension. The last state gives mean, eigenvalues and eigenvectors; vectors are then projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, saved

#: Vectors that are decomposed at once, and states that are merged at once.
BLOCK, FAN = 4096, 16
COMPONENTS = 4
#: A singular value under this part of the largest counts as zero.
ZERO = 1e-12
STATE = "node long, n long, sums array<string>, mean array<double>, s array<double>, vt array<double>"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class State:
    """n vectors: exact sums by dimension, mean, singular values s and right singular vectors vt (a row each) of the vectors less their mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    s: np.ndarray
    vt: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> State:
        """x: whole numbers, a vector each row."""
        wide = len(x) * int(np.abs(x).max(initial=0)) < 2**62
        sums = [int(v) for v in (x.sum(axis=0) if wide else x.astype(object).sum(axis=0))]
        mean = np.array([v / len(x) for v in sums])
        _, s, vt = np.linalg.svd(x - mean, full_matrices=False)
        return State(len(x), sums, mean, s, vt)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        shift = np.sqrt(self.n * (other.n / n)) * (self.mean - other.mean)
        _, s, vt = np.linalg.svd(np.vstack([self.s[:, None] * self.vt, other.s[:, None] * other.vt, shift]), full_matrices=False)
        sums = [a + b for a, b in zip(self.sums, other.sums)]
        return State(n, sums, np.array([v / n for v in sums]), s, vt)

    def row(self, node: int) -> dict:
        return {"node": node, "n": self.n, "sums": [str(v) for v in self.sums], "mean": self.mean.tolist(), "s": self.s.tolist(), "vt": self.vt.ravel().tolist()}

    @staticmethod
    def read(r) -> State:
        mean = np.array(r["mean"], float)
        return State(int(r["n"]), [int(v) for v in r["sums"]], mean, np.array(r["s"], float), np.array(r["vt"], float).reshape(-1, len(mean)))


def together(states: Iterator[State]) -> State | None:
    """Merged two by two, neighbours first."""
    level = list(states)
    while len(level) > 1:
        level = [level[k].merged(level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls, all of one length, as rows."""
    return np.array(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(len(column), -1)


def usable(rows: DataFrame, name: str = "embedding") -> DataFrame:
    """vec_id, x: each entry c as floor(256 c), a whole number. Vectors that are null or empty, or hold an entry that is null or not finite, are left out, and so
    are those of another length than most have (of equally common lengths the larger counts): they lie in no common space."""
    entries = F.transform(name, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = rows.select("vec_id", entries.alias("_e")).where(F.col("_e").isNotNull() & (F.size("_e") > 0) & ~bad)
    common = sound.groupBy(F.size("_e").alias("k")).count().orderBy(F.desc("count"), F.desc("k")).first()
    return sound.where(F.size("_e") == (common["k"] if common else 0)).select("vec_id", F.transform("_e", lambda c: F.floor(c * 256.0)).alias("x"))


def task_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    state: State | None = None

    def add(x: np.ndarray) -> State:
        new = State.of(x)
        return new if state is None else state.merged(new)

    for batch in batches:
        if batch.num_rows:
            held.append(matrix(batch.column("x")))
        while sum(map(len, held)) >= BLOCK:
            x = np.concatenate(held)
            state, held = add(x[:BLOCK]), [x[BLOCK:]]
    x = np.concatenate(held) if held else np.empty((0, 0))
    if len(x):
        state = add(x)
    if state is not None:
        yield pa.RecordBatch.from_pylist([state.row(TaskContext.get().partitionId())], pa.schema([
            ("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("s", pa.list_(pa.float64())), ("vt", pa.list_(pa.float64())),
        ]))


def merge_group(key: tuple, states: pd.DataFrame) -> pd.DataFrame:
    ordered = states.sort_values("node")
    return pd.DataFrame([together(State.read(r) for r in ordered.to_dict("records")).row(int(key[0]))])


def fitted(vectors: DataFrame) -> State | None:
    """The state of all rows of vectors (x), which are distinct; None if there are none. What reaches the driver is one state, the square of the dimension."""
    states = saved(vectors.select("x").mapInArrow(task_states, STATE), "whitening-states")
    nodes = states.agg(F.max("node")).first()[0]
    if nodes is None:
        return None
    while nodes > 0:
        states = states.groupBy(F.floor(F.col("node") / FAN).alias("up")).applyInPandas(merge_group, STATE)
        nodes //= FAN
    return State.read(states.first())


def directions(state: State, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of the covariance (a row each, the largest entry positive), their eigenvalues, falling, and each one's part of the trace. An eigenvalue of nothing
    but rounding counts as zero. There are as many as dimensions, or `most`."""
    d = len(state.mean)
    s, vt = state.s, state.vt
    if len(s) < d:  # fewer vectors than dimensions: the rest of the space, with no variance
        s, vt = np.concatenate([s, np.zeros(d - len(s))]), np.linalg.svd(vt, full_matrices=True)[2] if len(s) == 0 else np.vstack([vt, np.linalg.svd(vt, full_matrices=True)[2][len(s):]])
    s = np.where(s > ZERO * s.max(initial=0.0), s, 0.0)
    e = s**2 / state.n
    vt = vt[:most] * np.sign(vt[:most][np.arange(min(most, d)), np.abs(vt[:most]).argmax(axis=1)])[:, None]
    return vt, e[:most], e[:most] / e.sum() if e.sum() > 0 else np.zeros(min(most, d))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - sum)^2, exact; None where it does not fit a long."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if reach * reach * max(1, x.shape[1]) < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    rough = ((float(n) * x - np.array(sums, float)) ** 2).sum(axis=1)
    out: list[int | None] = [None] * len(x)
    for k in np.flatnonzero(rough < 1e19):
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(x[k], sums))
        out[k] = exact if exact < 2**63 else None
    return out


def projector(state: State, most: int):
    """A function from vectors to their whitened coordinates, a column for each component; null where the eigenvalue is zero."""
    vt, e, _ = directions(state, most)
    scale = np.where(e > 0, 1 / np.sqrt(np.where(e > 0, e, 1)), np.nan)
    mean = state.mean
    return lambda x: ((x - mean) @ vt.T) * scale


def identity_error(vectors: DataFrame, state: State, most: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance, centred, less the identity, over components that have variance; None if none has."""
    live = int((directions(state, most)[1] > 0).sum())
    if not live:
        return None
    project = projector(state, most)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = project(matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([pa.array(z[:, k]) for k in range(live)], names=[f"w{k}" for k in range(live)])

    table = vectors.select("x").mapInArrow(whitened, ", ".join(f"w{k} double" for k in range(live)))
    found = table.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(live) for j in range(i + 1)]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in range(live) for j in range(i + 1))


def whiten(rows: DataFrame, name: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component, from 1 by falling eigenvalue.

    rows: vec_id and the vectors, array of numbers; other columns are not read. See usable() for what is left out. Each distinct vector counts once in the fit,
    however many rows have it; repeated rows, and those with a null vec_id, are each projected. A component without variance has explained 0 and whitened null; deviation is
    null where it does not fit a long. Equal eigenvalues: any orthogonal pair spans their plane. An empty table gives no rows.
    """
    vectors = saved(usable(rows, name), "whitening-vectors")
    distinct = saved(vectors.select("x").distinct(), "whitening-distinct")
    state = fitted(distinct)
    if state is None:
        return rows.sparkSession.createDataFrame([], RESULT)
    _, _, explained = directions(state, most)
    error, project = identity_error(distinct, state, most), projector(state, most)
    n, sums, width = state.n, state.sums, len(explained)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            z, m = project(x), len(x)
            place = np.repeat(np.arange(m), width)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(place)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), m)), pa.array(np.full(m * width, n, np.int64)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(place)), pa.array(z.ravel(), from_pandas=True), pa.array(np.tile(explained, m)),
                pa.array([error] * (m * width), pa.float64()),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(projected, RESULT)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
