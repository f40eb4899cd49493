"""Scenario generators behind one protocol: each makes windows (label, w, k, j, x), so that whatever reads windows takes any number of generators in one plan.

Random numbers are counter-based: a window's come from a generator whose key is the seed and the window's number, so they depend neither on partitions nor on what
else a task draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Windows that are integrated together in a task.
BATCH = 512


def source(seed: int, w: int, n: int, width: int, nu: float, mix: str = "window") -> np.ndarray:
    """n steps of Student-t numbers: normal ones over the root of a chi-squared one over nu, which a window shares, or a step."""
    if mix not in ("window", "step"):
        raise ValueError(f"mix is {mix}")
    draw = np.random.Generator(np.random.Philox(key=[seed, w]))
    z = draw.standard_normal((n, width))
    return z * np.sqrt(nu / np.maximum(draw.chisquare(nu, (1 if mix == "window" else n, 1)), 1e-8))


def integrate(velocity: Callable[[np.ndarray, float], np.ndarray], x: np.ndarray, steps: int) -> np.ndarray:
    """dx/dt = velocity(x, t) from 0 to 1 by Heun's rule; the last step is Euler's, so that the velocity is not asked for at 1."""
    dt = 1.0 / steps
    for k in range(steps):
        first = velocity(x, k * dt)
        if k == steps - 1:
            x = x + dt * first
        else:
            x = x + dt / 2 * (first + velocity(x + dt * first, (k + 1) * dt))
    return x


def affine_flow(a: np.ndarray, b: np.ndarray) -> Callable[[np.ndarray, float], np.ndarray]:
    """The velocity that carries z to a z + b along straight lines: at time t a point is ((1 - t) + t a) z + t b, and moves by (a - 1) z + b."""
    one = np.eye(len(b))

    def velocity(x: np.ndarray, t: float) -> np.ndarray:
        z = np.linalg.solve((1 - t) * one + t * a, (x - t * b).reshape(-1, len(b)).T).T
        return (z @ (a - one).T + b).reshape(x.shape)

    return velocity


def flow_windows(spark: SparkSession, label: str, count: int, n: int, names: list, a: np.ndarray, b: np.ndarray, nu: float = 5.0, seed: int = 0, steps: int = 50, mix: str = "window", scale: float = 1.0, draw: Callable[..., np.ndarray] = source) -> DataFrame:
    """label, w, k, j, x: count windows of the source carried by affine_flow(), times scale. a, b, names: of the features, so of their number squared. draw: another source, called as
    source() is; what it gives may depend on its arguments alone."""
    kind = "int" if names and isinstance(names[0], int) else "string"
    velocity = affine_flow(a, b)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BATCH):
                ids = frame["id"].to_numpy()[at : at + BATCH]
                x = integrate(velocity, np.stack([draw(seed, int(w), n, len(names), nu, mix) for w in ids]), steps) * scale
                yield pd.DataFrame({"w": ids, "x": [v.ravel() for v in x]})

    windows = spark.range(count).mapInPandas(make, "w long, x array<double>")
    cells = windows.select("w", F.posexplode("x").alias("i", "x"))
    of = F.array(*map(F.lit, names)).cast(f"array<{kind}>")
    return cells.select(F.lit(label).alias("label"), "w", F.expr(f"i div {len(names)}").cast("int").alias("k"), F.element_at(of, F.col("i") % len(names) + 1).alias("j"), "x")


def fitted_flow(moments: DataFrame, nu: float = 5.0) -> tuple[list, np.ndarray, np.ndarray]:
    """names, a, b for flow_windows() so that it has the rows' means and covariance. moments: one row as dependence.together() leaves it, the square of the number of features."""
    r = moments.first()
    size = len(r["names"])
    cov = np.asarray(r["m"], float).reshape(size, size) / r["n"]
    values, vectors = np.linalg.eigh(cov * (nu - 2) / nu)
    root = vectors * np.sqrt(np.maximum(values, 0)) @ vectors.T  # the symmetric root: no turn on the way, and positive if the covariance is
    return list(r["names"]), root, np.asarray(r["mean"], float)


def historical(windows: DataFrame, label: str) -> DataFrame:
    """Training windows as scenarios."""
    return windows.select(F.lit(label).alias("label"), "w", "k", "j", "x")


def level_of(label):
    """The level that a label names after _u, like flow_u0.90; null if it names none."""
    return F.regexp_extract(label, r"_u(\d*\.\d+)", 1).try_cast("double")


def bands(labels: DataFrame, width: float = 0.05) -> DataFrame:
    """label, level, lo, hi: the band of levels that each label names, within 0 and 1; labels that name none are left out."""
    named = labels.select("label", level_of(F.col("label")).alias("level")).where("level IS NOT NULL")
    return named.select("label", "level", F.greatest(F.col("level") - width, F.lit(0.0)).alias("lo"), F.least(F.col("level") + width, F.lit(1.0)).alias("hi"))
