"""Dependence, goodness of fit, densities and novelty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.sources.shared import written


def pseudo_obs(rets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., t, j, u: rank over n + 1 within each feature of each group; equal values in order of t."""
    own = [*(by or []), "j"]
    w = Window.partitionBy(*own).orderBy("x", "t")
    return rets.select(*(by or []), "t", "j", (F.row_number().over(w) / (F.count("*").over(Window.partitionBy(*own)) + 1.0)).alias("u"))


def pairs_on_rows(left: DataFrame, value: str) -> DataFrame:
    """t, i, j, a, b for i < j: pairs of features that share a row; rows meet on t, so that only features are paired."""
    a = left.select("t", F.col("j").alias("i"), F.col(value).alias("a"))
    return a.join(left.select("t", "j", F.col(value).alias("b")), "t").where("i < j")


def pairs_of(names: DataFrame, by: list[str]) -> DataFrame:
    """by..., i, j: all pairs i < j of the features j of each group."""
    listed = names.groupBy(*by).agg(F.sort_array(F.collect_set("j")).alias("_f"))  # the features of a group
    return listed.select(*by, "_f", F.explode("_f").alias("i")).select(*by, "i", F.explode(F.filter("_f", lambda j: j > F.col("i"))).alias("j"))


def tail_dependence(u: DataFrame, q: float, upper: bool = False, by: list[str] | None = None) -> DataFrame:
    """by..., i, j, lam: how often both are beyond q, over q. Only rows beyond q are paired; pairs without any are put back at zero."""
    by = by or []
    n = u.groupBy(*by).agg(F.countDistinct("t").alias("_n"))
    beyond = u.where(F.col("u") > 1 - q) if upper else u.where(F.col("u") < q)
    left = beyond.select(*by, "t", F.col("j").alias("i"))
    hits = left.join(beyond.select(*by, "t", "j"), [*by, "t"]).where("i < j").groupBy(*by, "i", "j").agg(F.count("*").alias("hits"))
    every = pairs_of(u.select(*by, "j").distinct(), by).join(hits, [*by, "i", "j"], "left")
    whole = every.join(F.broadcast(n), by) if by else every.crossJoin(F.broadcast(n))  # one row a group
    return whole.select(*by, "i", "j", (F.coalesce("hits", F.lit(0)) / F.col("_n") / q).alias("lam"))


def anderson_darling(u: DataFrame, by: str = "j") -> DataFrame:
    """by, ad: of values in [0, 1] against the uniform, each sorted value paired with itself only."""
    w = Window.partitionBy(by).orderBy("u")
    v = u.select(by, F.least(F.greatest("u", F.lit(1e-12)), F.lit(1 - 1e-12)).alias("u")).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    term = (2 * F.col("i") - 1) * F.ln("u") + (2 * F.col("n") + 1 - 2 * F.col("i")) * F.ln(1 - F.col("u"))
    return v.groupBy(by, "n").agg((-F.col("n") - F.sum(term) / F.col("n")).alias("ad")).drop("n")


def ks_uniform(u: DataFrame, by: str = "j") -> DataFrame:
    w = Window.partitionBy(by).orderBy("u")
    v = u.select(by, "u").withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    return v.groupBy(by).agg(F.max(F.greatest(F.col("i") / F.col("n") - F.col("u"), F.col("u") - (F.col("i") - 1) / F.col("n"))).alias("ks"), F.first("n").alias("n"))


def two_samples(both: DataFrame, by: str) -> DataFrame:
    """by, ks, w1 of samples s = 0 and 1 of x: the largest gap between their distribution functions, and the area between them, from running counts over the union. Both are null if a sample is empty."""
    up = Window.partitionBy(by).orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    below = lambda s: F.sum(F.when(F.col("s") == s, 1).otherwise(0))
    gap = F.abs(F.try_divide(below(0).over(up), below(0).over(whole)) - F.try_divide(below(1).over(up), below(1).over(whole)))
    each = both.withColumn("gap", gap).withColumn("step", F.lead("x").over(Window.partitionBy(by).orderBy("x")) - F.col("x"))
    return each.groupBy(by).agg(F.max("gap").alias("ks"), F.sum(F.col("gap") * F.coalesce("step", F.lit(0.0))).alias("w1"))


def window_acf(windows: DataFrame, lags: int) -> DataFrame:
    """j, lag, acf: mean over windows of the autocorrelation of squares about each window's mean."""
    own = Window.partitionBy("w", "j")
    order = own.orderBy("k")
    sq = windows.withColumn("y", F.col("x") * F.col("x"))
    c = sq.withColumn("c", F.col("y") - F.avg("y").over(own))
    ahead = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("c", k).over(order).alias("d")) for k in range(1, lags + 1)])
    each = c.withColumn("a", ahead).select("w", "j", "c", F.inline("a"))
    per = each.groupBy("w", "j", "lag").agg((F.sum(F.col("c") * F.coalesce("d", F.lit(0.0))) / (F.sum(F.col("c") * F.col("c")) + 1e-12)).alias("r"))
    return per.groupBy("j", "lag").agg(F.avg("r").alias("acf"))


def kde(sample: DataFrame, grid: DataFrame, rule: str = "scott") -> DataFrame:
    """g, density at grid points (g) of a sample (x). The bandwidth follows Scott's rule, or a robust one, from the smaller of standard deviation and quartile distance."""
    if rule not in ("scott", "robust"):
        raise ValueError(f"rule is {rule}")
    stats = sample.agg(F.stddev_samp("x").alias("sd"), F.count("*").alias("n"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    spread = F.col("sd") if rule == "scott" else 0.9 * F.least(F.col("sd"), (F.col("q")[1] - F.col("q")[0]) / 1.349)
    h = stats.withColumn("h", spread * F.pow("n", F.lit(-0.2))).select("h", "n")
    each = sample.join(F.broadcast(grid)).join(F.broadcast(h))  # the grid has a set size, h one row
    z = (F.col("g") - F.col("x")) / F.col("h")
    return each.groupBy("g", "h", "n").agg((F.sum(F.exp(-0.5 * z * z)) / (F.col("n") * F.col("h") * F.lit((2 * np.pi) ** 0.5))).alias("density")).select("g", "density")


def packed_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """vectors (id, v) in the order of their norms, `rows` of them a row: block, ids and v as bytes, lo and hi, the least and largest norm, and mid, the middle one's."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, ids, vs, rs = TaskContext.get().partitionId(), 0, [], [], []

        def full(k: int) -> pa.RecordBatch:
            cells = [(part << 32) + n], [np.array(ids[:k], np.int64).tobytes()], [np.array(vs[:k], float).tobytes()], [rs[0]], [rs[k - 1]], [rs[(k - 1) // 2]]
            del ids[:k], vs[:k], rs[:k]
            return pa.record_batch([pa.array(c) for c in cells], ["block", "ids", "v", "lo", "hi", "mid"])

        for b in batches:
            for i in range(0, b.num_rows, rows):
                some = b.slice(i, rows)
                ids += some.column(0).to_pylist()
                vs += some.column(1).to_pylist()
                rs += some.column(2).to_pylist()
                while len(ids) >= rows:
                    yield full(rows)
                    n += 1
        if ids:
            yield full(len(ids))

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = max(1, -(-vectors.count() // (16 * rows)))
    ranged = vectors.select("id", "v", norm.alias("r")).repartitionByRange(parts, "r", F.xxhash64("id")).sortWithinPartitions("r")
    return written(ranged.mapInArrow(pack, "block long, ids binary, v binary, lo double, hi double, mid double"), "nearest-blocks")


def nearest(queries: DataFrame, base: DataFrame, rows: int = 2048) -> DataFrame:
    """q, d: distance of each query (q, v) to its nearest row of base (b, v) other than itself (b = q); null if there is no other.

    Both are put in blocks by their norm. A block of queries meets the block of base that its middle norm falls into first; the distances found there rule out the blocks whose
    norms all differ by more from its own, since distances are at least the difference of norms. Only those left are met. Blocks meet by replication, not by a shuffle: a vector
    is shuffled once, when blocks are made, and then only minima are.
    """
    asked = packed_blocks(queries.select(F.col("q").alias("id"), "v"), rows).select(F.col("block").alias("slice"), F.col("ids").alias("qs"), F.col("v").alias("a"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "mid")
    held = packed_blocks(base.select(F.col("b").alias("id"), "v"), rows).select("block", "ids", "v", "lo", "hi")
    homes = asked.select("slice", "mid").join(held.select("block", "lo", "hi").hint("shuffle_replicate_nl"))
    away = F.greatest(F.lit(0.0), F.col("lo") - F.col("mid"), F.col("mid") - F.col("hi"))
    home = written(homes.groupBy("slice").agg(F.min_by("block", F.struct(away, "block")).alias("home")), "nearest-homes")  # one row a block

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (b.slice(k, 1).to_pylist()[0] for b in batches for k in range(b.num_rows)):
            own, ids = np.frombuffer(one["qs"], np.int64), np.frombuffer(one["ids"], np.int64)
            a, b = np.frombuffer(one["a"]).reshape(len(own), -1), np.frombuffer(one["v"]).reshape(len(ids), -1)
            d2 = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)
            if np.isin(own, ids).any():
                d2[own[:, None] == ids[None, :]] = np.inf
            yield pa.record_batch([pa.array(np.full(len(own), one["slice"])), pa.array(own), pa.array(d2.min(axis=1))], ["slice", "q", "d2"])

    def met(left: DataFrame, on: Column) -> DataFrame:
        pairs = left.join(held.hint("shuffle_replicate_nl"), on).select("slice", "qs", "a", "ids", "v")
        return pairs.mapInArrow(least, "slice long, q long, d2 double").groupBy("slice", "q").agg(F.min("d2").alias("d2"))

    at_home = asked.join(F.broadcast(home), "slice")  # one row a block
    first = written(met(at_home, F.col("home") == F.col("block")), "nearest-first")
    reach = first.groupBy("slice").agg((F.sqrt(F.max("d2")) * (1 + 1e-9) + 1e-9).alias("reach"))
    close = (F.col("home") != F.col("block")) & (F.col("lo") <= F.col("a_hi") + F.col("reach")) & (F.col("hi") >= F.col("a_lo") - F.col("reach"))
    more = met(at_home.join(F.broadcast(reach), "slice"), close)  # one row a block
    every = queries.select("q", F.lit(float("inf")).alias("d2"))  # also where base has no rows
    best = every.unionByName(first.unionByName(more).select("q", "d2")).groupBy("q").agg(F.min("d2").alias("d2"))
    return best.select("q", F.when(F.col("d2") < float("inf"), F.sqrt("d2")).alias("d"))


def novelty(samples: DataFrame, real: DataFrame) -> DataFrame:
    """sample, n, median, ratio, least, q05, close: distances of vectors (sample, q, v) to their nearest real one (b, v), against those of the real ones to one another, the sample
    "real": ratio of medians, and share of vectors closer than half the real median."""
    own = nearest(real.select(F.col("b").alias("q"), "v"), real).withColumn("sample", F.lit("real"))
    # a sample's vectors are no rows of the real table, so none is left out as itself
    keyed = samples.withColumn("q", -1 - F.xxhash64("sample", "q").bitwiseAND(F.lit((1 << 62) - 1)))
    other = nearest(keyed.select("q", "v"), real).join(keyed.select("q", "sample"), "q").select("q", "d", "sample")
    every = own.unionByName(other)
    mid = own.agg(F.median("d").alias("_m"))
    return every.join(F.broadcast(mid)).groupBy("sample", "_m").agg(  # one row
        F.count("*").alias("n"), F.median("d").alias("median"), (F.median("d") / F.first("_m")).alias("ratio"), F.min("d").alias("least"), F.percentile("d", F.lit(0.05)).alias("q05"),
        F.avg((F.col("d") < 0.5 * F.col("_m")).cast("int")).alias("close"),
    ).drop("_m")


def gram(rets: DataFrame) -> DataFrame:
    """i, j, g: sums of products of features over all rows, i <= j."""
    a = rets.select("t", F.col("j").alias("i"), F.col("x").alias("a"))
    return a.join(rets.select("t", "j", F.col("x").alias("b")), "t").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


#: Thresholds over which eigenvalues count, as parts of the largest, and shares of variance.
RANK_CUTS, SHARES = (1e-1, 1e-2, 1e-3, 1e-4, 1e-6), (0.9, 0.99, 0.999)


def moments(rets: DataFrame, rows: int = 4096) -> DataFrame:
    """block, n, names, mean, m: of each block of rows t, the sums of products of the features less their means, so that nothing but these passes between tasks.

    A row with a feature missing is left out. Features are all of a block's, so blocks without some are an error when they are added up.
    """
    kind = rets.schema["j"].dataType.simpleString()
    vectors = rets.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("r"))
    most = vectors.agg(F.max(F.size("r"))).first()[0] or 0
    vectors = vectors.where(F.size("r") == most).select(F.floor(F.col("t") / rows).alias("block"), F.transform("r", lambda c: c["j"]).alias("names"), F.transform("r", lambda c: c["x"]).alias("x"))

    def add(df: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(df["x"].to_numpy()).astype(float)
        c = x - x.mean(axis=0)
        return pd.DataFrame({"block": [df["block"].iloc[0]], "n": [len(x)], "names": [df["names"].iloc[0]], "mean": [x.mean(axis=0)], "m": [(c.T @ c).ravel()]})

    return vectors.groupBy("block").applyInPandas(add, f"block long, n long, names array<{kind}>, mean array<double>, m array<double>")


def together(states: DataFrame, fan: int = 16) -> DataFrame:
    """moments() merged `fan` blocks at a time until one row is left."""
    top = states.agg(F.max("block")).first()[0]
    schema = states.schema

    def merge(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        n, mean, m = 0, 0.0, 0.0
        for r in df.sort_values("block").to_dict("records"):
            other, k = np.asarray(r["mean"], float), int(r["n"])
            apart = other - mean
            m = m + np.asarray(r["m"], float) + (np.outer(apart, apart).ravel() * (n * k / (n + k)) if n else 0.0)
            mean, n = mean + apart * (k / (n + k)), n + k
        return pd.DataFrame({"block": [key[0]], "n": [n], "names": [df["names"].iloc[0]], "mean": [mean], "m": [m]})

    while top:
        states = states.groupBy(F.floor(F.col("block") / fan).alias("up")).applyInPandas(merge, schema)
        top //= fan
    return states


def spectrum(rets: DataFrame) -> DataFrame:
    """kind, k, eigenvalue, share of the covariance and the correlation matrix of the features of rets, largest first. The matrix is decomposed where it is merged."""

    def decompose(frames):
        for df in frames:
            for r in df.to_dict("records"):
                size = len(r["names"])
                cov = np.asarray(r["m"], float).reshape(size, size) / r["n"]
                sd = np.sqrt(np.diag(cov))
                live = sd > 0
                cor = cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
                for kind, matrix in (("covariance", cov), ("correlation", cor)):
                    ev = np.maximum(np.linalg.eigvalsh(matrix)[::-1], 0.0)
                    yield pd.DataFrame({"kind": kind, "k": np.arange(len(ev)), "eigenvalue": ev, "share": np.cumsum(ev) / ev.sum()})

    return together(moments(rets)).mapInPandas(decompose, "kind string, k int, eigenvalue double, share double")


def effective_rank(eigenvalues: DataFrame) -> DataFrame:
    """kind, measure, cut, k: how many eigenvalues are above each part of the largest, how many make up each share of the sum, and the participation ratio (sum squared over sum of squares)."""
    top = F.max("eigenvalue").over(Window.partitionBy("kind"))
    each = eigenvalues.withColumn("_top", top).withColumn("_before", F.col("share") - F.col("eigenvalue") / F.sum("eigenvalue").over(Window.partitionBy("kind")))
    record = lambda measure, cut, k: F.struct(F.lit(measure).alias("measure"), F.lit(cut).alias("cut"), k.cast("double").alias("k"))
    rows = [record("above", c, F.count_if(F.col("eigenvalue") > c * F.col("_top"))) for c in RANK_CUTS]
    rows += [record("share", c, F.count_if(F.col("_before") < c - 1e-12)) for c in SHARES]
    rows.append(record("participation", 1.0, F.pow(F.sum("eigenvalue"), F.lit(2.0)) / F.sum(F.col("eigenvalue") * F.col("eigenvalue"))))
    return each.groupBy("kind").agg(F.array(*rows).alias("r")).select("kind", F.inline("r"))


def dependent_group(pairs: DataFrame, size: int, value: str = "lam") -> DataFrame:
    """place, j: features chosen greedily. Each step is one small query over the pairs, of which the driver sees the winner alone."""
    both = pairs.select("i", "j", value).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), value)).persist()
    top = both.where("i < j").orderBy(F.desc(value), "i", "j").first()
    chosen = [top["i"], top["j"]][:size] if top else []
    while chosen and len(chosen) < size:
        best = both.where(F.col("i").isin(chosen) & ~F.col("j").isin(chosen)).groupBy("j").agg(F.avg(value).alias("m")).orderBy(F.desc(F.round("m", 10)), "j").first()
        if best is None:
            break
        chosen.append(best["j"])
    both.unpersist()
    return pairs.sparkSession.createDataFrame(list(enumerate(chosen)), f"place int, j {pairs.schema['j'].dataType.simpleString()}")
