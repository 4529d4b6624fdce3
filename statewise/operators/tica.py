"""Time-lagged independent components: mergeable sums over frames, a small generalised eigenproblem, a projection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.operators.neighbors import _blocks


@dataclass
class Tica:
    lag: int
    mean: np.ndarray
    correlation: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def moments(frames: DataFrame, lag: int, width: int, features: str = "features", size: int = 4096) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, sum x, sum y, sum xy', sum xx', sum yy') over all pairs x = frame t, y = frame t + lag of one trajectory.

    Pairs are found in blocks of frames with overlap; each Arrow batch is reduced to one row of sums, and the sums are added pairwise by
    Spark, so what reaches the driver does not grow with the frames. Pairs with a missing or null vector are left out. Lag 0 pairs a frame
    with itself.
    """
    if lag:
        size = max(size, lag)
        later = F.first(features).over(Window.partitionBy("traj_id", "_b").orderBy("frame").rangeBetween(lag, lag))
        rows = _blocks(frames.select("traj_id", "frame", features), lag, size).withColumn("_y", later).where("_own")
    else:
        rows = frames.withColumn("_y", F.col(features))
    pairs = rows.where((F.size(features) == width) & (F.size("_y") == width)).select(F.col(features).cast("array<double>").alias("x"), F.col("_y").cast("array<double>").alias("y"))
    total = 1 + 2 * width + 3 * width * width

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(total)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                acc += np.concatenate([[len(x)], x.sum(0), y.sum(0), (x.T @ y).ravel(), (x.T @ x).ravel(), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total)), pa.array(acc)], ["k", "v"])

    got = pairs.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    acc = np.zeros(total)
    acc[got["k"].to_numpy()] = got["v"].to_numpy()
    cut = np.cumsum([1, width, width, width * width, width * width])
    n, sx, sy, xy, xx, yy = np.split(acc, cut)
    shape = (width, width)
    return float(n[0]), sx, sy, xy.reshape(shape), xx.reshape(shape), yy.reshape(shape)


def add(a, b):
    """Moments of two sets of frames together (incremental training)."""
    return tuple(x + y for x, y in zip(a, b, strict=True))


def estimate(m) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(joint mean, symmetrised lagged correlation, covariance)."""
    n, sx, sy, xy, xx, yy = m
    if n <= 0:
        raise ValueError("no pair of frames a lag apart")
    mean = (sx + sy) / (2 * n)
    outer = np.outer(mean, mean)
    return mean, (xy + xy.T) / (2 * n) - outer, (xx + yy) / (2 * n) - outer


def solve(m, lag: int, pca_cutoff: float = 0.0) -> Tica:
    """Eigenpairs of correlation against covariance, largest first; lag 0 is principal components. Directions whose variance is not above
    ``pca_cutoff`` (and rounding) are left out first."""
    mean, corr, cov = estimate(m)
    value, vector = np.linalg.eigh(cov)
    if lag == 0:
        order = np.argsort(-value)
        return Tica(lag, mean, corr, cov, value[order], vector[:, order])
    keep = value > max(pca_cutoff, 1e-12 * max(value.max(), 0))
    white = vector[:, keep] / np.sqrt(value[keep])
    lam, u = np.linalg.eigh(white.T @ corr @ white)
    order = np.argsort(-lam, kind="stable")
    vecs = white @ u[:, order]
    vecs *= np.where(vecs[np.abs(vecs).argmax(axis=0), np.arange(vecs.shape[1])] < 0, -1.0, 1.0)
    return Tica(lag, mean, corr, cov, lam[order], vecs)


def choose(values: np.ndarray, which: list[int] | None = None, num: int | None = None, least: float | None = None, explained: float | None = None) -> list[int]:
    """Components to keep: named ones, else the first ``num``, else those above ``least``, else those within a share of the summed values."""
    if which is not None:
        return list(which)
    if num is not None:
        return list(range(num))
    if least is not None:
        return np.flatnonzero(values > least).tolist()
    if explained is not None:
        return np.flatnonzero(np.cumsum(values) / values.sum() < explained).tolist()
    raise ValueError("say which components to keep")


def project(features: Column, t: Tica, which: list[int]) -> Column:
    """Array of the chosen components of a feature column, in the JVM."""
    out = []
    for k in which:
        weights = F.array(*[F.lit(float(x)) for x in t.vectors[:, k]])
        out.append(F.aggregate(F.zip_with(features, weights, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda s, x: s + x))
    return F.array(*out)


def save(spark, t: Tica, path: str) -> None:
    """One row per array of a fitted projection."""
    rows = [(n, list(map(int, np.shape(a))), [float(x) for x in np.ravel(a)]) for n, a in (("lag", np.array(t.lag)), ("mean", t.mean), ("correlation", t.correlation), ("covariance", t.covariance), ("values", t.values), ("vectors", t.vectors))]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("errorifexists").parquet(path)


def load(spark, path: str) -> Tica:
    got = {r.name: np.array(r.data).reshape(r.shape) for r in spark.read.parquet(path).collect()}
    return Tica(int(got.pop("lag")), **got)
