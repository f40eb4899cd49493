"""Volatility models behind one protocol, fitted and run for many splits, models and instruments in one job.

A model fits parameters to the training rows of some series at once and steps their variances by one row. Its name is a column, so a plan holds any
number of models; what reads that column looks the model up in MODELS.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A variance stays above the square of this part of the training rows' standard deviation.
FLOOR = 0.05
#: Series that are fitted together.
TOGETHER = 16


@dataclass(frozen=True)
class VolModel:
    """fit(x, train): rows by series, and which rows to learn from -> parameters by series, of which the first two are the starting and the least variance.
    step(s2, r, theta): the next variances. A constant model has unit variance, so that every date has the same law."""

    fit: Callable[[np.ndarray, np.ndarray], np.ndarray]
    step: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    constant: bool = False


def start(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    v = np.maximum(x[train].var(axis=0), 1e-12)
    return np.stack([v, FLOOR**2 * v])


def ewma_model(lam: float) -> VolModel:
    return VolModel(start, lambda s2, r, theta: np.maximum(lam * s2 + (1 - lam) * r * r, theta[1]))


def asymmetric_step(s2: np.ndarray, r: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """theta: v, low, a, g, b; the constant makes v the mean of the recursion."""
    v, low, a, g, b = theta
    return np.maximum(v * (1 - a - g / 2 - b) + np.where(r < 0, a + g, a) * r * r + b * s2, low)


def gaussian_score(x: np.ndarray, train: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Quasi log-likelihood of the training rows but the first. x: rows by 1 by series; theta: parameters by candidates by series."""
    s2 = np.broadcast_to(theta[0], theta.shape[1:])
    total = np.zeros(theta.shape[1:])
    for t in range(1, len(x)):
        s2 = asymmetric_step(s2, x[t - 1], theta)
        if train[t]:
            total -= 0.5 * (np.log(s2) + x[t] ** 2 / s2)
    return total


def fit_asymmetric(x: np.ndarray, train: np.ndarray, rounds: int = 14) -> np.ndarray:
    """Parameters of greatest quasi-likelihood with a, g, b >= 0 and a + g / 2 + b <= 0.995.

    All series move together: a net over the whole region first, then rounds in which the neighbours of each series' best point, a step off in each direction, are
    tried at once and the steps of series that stay are halved.
    """
    base, series = start(x, train), np.arange(x.shape[1])
    rows = x[:, None, :]

    def score(points: np.ndarray) -> np.ndarray:
        """points: 3 by candidates by series; those outside the region score minus infinity."""
        a, g, b = points
        inside = (a >= 0) & (g >= 0) & (b >= 0) & (a + g / 2 + b <= 0.995 + 1e-12) & (a + g > 0)
        safe = np.where(inside, points, np.array([0.05, 0.0, 0.9])[:, None, None])
        theta = np.concatenate([np.broadcast_to(base[:, None, :], (2, *points.shape[1:])), safe])
        return np.where(inside, gaussian_score(rows, train, theta), -np.inf)

    net = np.stack(np.meshgrid(np.linspace(0, 0.15, 6), np.linspace(0, 0.25, 6), [0.0, 0.3, 0.5, 0.65, 0.75, 0.8, 0.85, 0.9, 0.94, 0.97, 0.985], indexing="ij")).reshape(3, -1)
    found = score(np.broadcast_to(net[:, :, None], (*net.shape, x.shape[1])))
    best, top = net[:, found.argmax(axis=0)], found.max(axis=0)
    step = np.repeat([[0.02], [0.03], [0.03]], x.shape[1], axis=1)
    moves = np.stack(np.meshgrid(*[[-1, 0, 1]] * 3, indexing="ij")).reshape(3, -1)
    for _ in range(rounds):
        near = best[:, None, :] + moves[:, :, None] * step[:, None, :]
        found = score(near)
        k = found.argmax(axis=0)
        better = found[k, series] > top
        best = np.where(better, near[:, k, series], best)
        top = np.where(better, found[k, series], top)
        step = np.where(better, step, step / 2)
    return np.concatenate([base, best])


MODELS: dict[str, VolModel] = {
    "HS": VolModel(lambda x, train: np.ones((2, x.shape[1])), lambda s2, r, theta: s2, constant=True),
    "EWMA 0.90": ewma_model(0.90), "EWMA 0.94": ewma_model(0.94), "EWMA 0.97": ewma_model(0.97), "GJR": VolModel(fit_asymmetric, asymmetric_step),
}


def variances(model: VolModel, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Rows by series; each from rows before it alone."""
    out = np.empty_like(x)
    if len(x):
        out[0] = theta[0]
    for t in range(1, len(x)):
        out[t] = model.step(out[t - 1], x[t - 1], theta)
    return out


def filtered(rets: DataFrame, held: DataFrame, models: list[str]) -> DataFrame:
    """split, model, j, theta, sigma, e: parameters of each series, and by row (arrays) its volatility and its standardised return.

    rets: t, j, x, rows 0 to T - 1 without gaps; held: split, held, the rows that each split holds out. A series is one row here and series are fitted TOGETHER at a time;
    a recursion over time can't be cut further.
    """
    unknown = sorted(set(models) - set(MODELS))
    if unknown:
        raise ValueError(f"no model {', '.join(unknown)}")
    series = rets.groupBy("j").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda r: r["x"]).alias("xs"))
    each = series.crossJoin(F.broadcast(held)).withColumn("model", F.explode(F.array(*map(F.lit, models))))  # a row a split
    parts = max(1, -(-rets.select("j").distinct().count() // TOGETHER))
    kind = rets.schema["j"].dataType.simpleString()

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        model, x = MODELS[df["model"].iloc[0]], np.stack(df["xs"].to_numpy()).T.astype(float)
        train = np.ones(len(x), bool)
        train[np.asarray(df["held"].iloc[0], int)] = False
        theta = model.fit(x, train)
        sigma = np.sqrt(np.ones_like(x) if model.constant else variances(model, x, theta))
        return pd.DataFrame({"split": df["split"], "model": df["model"], "j": df["j"], "theta": list(theta.T), "sigma": list(sigma.T), "e": list((x / sigma).T)})

    return each.groupBy("split", "model", F.pmod(F.xxhash64("j"), F.lit(parts)).alias("part")).applyInPandas(
        lambda df: fit(df.drop(columns="part", errors="ignore")), f"split long, model string, j {kind}, theta array<double>, sigma array<double>, e array<double>"
    )


def by_row(paths: DataFrame) -> DataFrame:
    """split, model, t, sigma, e: arrays over instruments, in their order, for each row."""
    cells = paths.select("split", "model", "j", F.posexplode(F.arrays_zip("sigma", "e")).alias("t", "v"))
    rows = cells.groupBy("split", "model", "t").agg(F.sort_array(F.collect_list(F.struct("j", "v.sigma", "v.e"))).alias("c"))  # one entry an instrument
    return rows.select("split", "model", F.col("t").cast("long").alias("t"), F.transform("c", lambda c: c["sigma"]).alias("sigma"), F.transform("c", lambda c: c["e"]).alias("e"))


def parameters(paths: DataFrame) -> DataFrame:
    """split, model, theta: the parameters of all instruments, in their order, as one row."""
    return paths.groupBy("split", "model").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "theta"))), lambda c: c["theta"]).alias("theta"))


def trailing_volatility(pnl: DataFrame, length: int = 63) -> DataFrame:
    """t, vol of the rows strictly before, null where there are too few."""
    w = Window.orderBy("t").rowsBetween(-length, -1)  # one number a date
    return pnl.select("t", F.when(F.count("r").over(w) == length, F.stddev_pop("r").over(w)).alias("vol"))
