"""Flat and hierarchical clustering of feature vectors.

Farthest-first centres and medoid refinement run over DataFrames; linkage and randomised medoid search run on bounded samples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statewise.functions.pairwise import Pairwise, named, over_columns
from statewise.functions.vectors import NUMERIC
from statewise.operators.neighbors import assign
from statewise.session import materialize

#: Vectors a linkage may hold (its distances are quadratic), and steps between two lineage cuts of the centre loop.
MOST_LINKED, CUT_EVERY = 5000, 8


def _nearer(table: DataFrame, key: str, features: str, centre: list[float], n: int, f: Pairwise) -> DataFrame:
    """``table`` after one more centre, compared in Arrow batches."""
    c = np.array([centre], float)

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = f(batch.column(features).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1), c)[:, 0]
            before, state = batch.column("dist").to_numpy(zero_copy_only=False), batch.column("state").to_numpy(zero_copy_only=False)
            near = d < before
            columns = [batch.column(key), batch.column(features), pa.array(np.where(near, n, state).astype(np.int32)), pa.array(np.where(near, d, before))]
            yield pa.RecordBatch.from_arrays(columns, [key, features, "state", "dist"])

    kind = dict(table.dtypes)
    return table.select(key, features, "state", "dist").mapInArrow(step, f"{key} {kind[key]}, {features} {kind[features]}, state int, dist double")


def k_centers(frames: DataFrame, k: int | None = None, cutoff: float | None = None, key: str = "id", features: str = "features", seed_key=None, metric=None) -> tuple[DataFrame, list]:
    """Farthest-first traversal: (``key, state, dist``, the generators' keys in order).

    Starts at ``seed_key`` (default: the smallest key) and takes the farthest frame (ties: the smallest key) until there are ``k`` centres or
    no distance reaches ``cutoff``. A frame moves to a new centre only if that is strictly nearer. ``metric`` is a function of two columns
    (Euclidean by default), or a name or function of ``functions.pairwise`` (``rmsd``: features are flattened coordinates). The features are
    written once; then one narrow pass and one aggregate per centre, written every CUT_EVERY centres. Rows with null features, and of
    differently long ones those unlike the first centre's, are left out; an empty table has no centres.
    """
    if k is None and cutoff is None:
        raise ValueError("give k or cutoff")
    by_column = metric is None or over_columns(metric)
    f = None if by_column else named(metric)
    metric = metric or NUMERIC["euclidean"]
    rows = frames.where(F.col(features).isNotNull() & F.col(key).isNotNull()).select(key, features)
    first = rows.where(F.col(key) == seed_key) if seed_key is not None else rows.orderBy(key)
    start = first.limit(1).collect()
    if not start:
        return rows.select(key, F.lit(0).alias("state"), F.lit(0.0).alias("dist")).limit(0), []
    centres = [start[0][0]]
    rows = materialize(rows.where(F.size(features) == len(start[0][1])))

    def to(row) -> F.Column:
        return metric(F.col(features), F.array(*[F.lit(float(x)) for x in row]))

    if by_column:
        table = rows.withColumn("state", F.lit(0)).withColumn("dist", to(start[0][1]))
    else:
        table = _nearer(rows.withColumn("state", F.lit(0)).withColumn("dist", F.lit(float("inf"))), key, features, start[0][1], 0, f)
    while k is None or len(centres) < k:
        far = table.agg(F.min(F.struct((-F.col("dist")).alias("d"), key, features)).alias("m")).first()["m"]
        if far is None or (cutoff is not None and -far["d"] < cutoff) or far["d"] == 0:
            break
        n = len(centres)
        centres.append(far[key])
        if by_column:
            table = table.withColumn("_d", to(far[features])).withColumn("state", F.when(F.col("_d") < F.col("dist"), n).otherwise(F.col("state"))).withColumn("dist", F.least("dist", "_d")).drop("_d")
        else:
            table = _nearer(table, key, features, far[features], n, f)
        if n % CUT_EVERY == 0:
            table = materialize(table)
    return table.select(key, "state", "dist"), centres


def hybrid_k_medoids(frames: DataFrame, k: int, rounds: int = 5, p: float = 2.0, key: str = "id", features: str = "features", seed: int = 0, ignore_max: bool = False, metric: str | Pairwise | None = None) -> tuple[DataFrame, list]:
    """k centres, then ``rounds`` of medoid proposals: in each, every cluster proposes a member (by hash); the proposals are taken together
    if the p-norm of the distances falls and (unless ``ignore_max``) the largest distance does not rise. ``metric`` as in ``assign``."""
    labels, centres = k_centers(frames, k, key=key, features=features, metric=metric)
    if not centres:
        return labels, centres
    data = frames.where(F.col(features).isNotNull()).select(key, features)

    def generators(keys: list) -> DataFrame:
        order = frames.sparkSession.createDataFrame([(c, n) for n, c in enumerate(keys)], f"{key} {dict(frames.dtypes)[key]}, gid long")
        return data.join(F.broadcast(order), key).select("gid", features)

    def cost(a: DataFrame):
        r = a.agg(F.pow(F.avg(F.pow("dist", F.lit(p))), F.lit(1 / p)).alias("n"), F.max("dist").alias("m")).first()
        return r["n"], r["m"]

    now = materialize(assign(data, generators(centres), [key], features, metric))
    norm, top = cost(now)
    for r in range(rounds):
        picked = now.groupBy("state").agg(F.min_by(key, F.xxhash64(key, F.lit(seed + r))).alias("c")).where("state is not null").orderBy("state").collect()
        proposal = list(centres)
        for row in picked:
            proposal[row["state"]] = row["c"]
        new = materialize(assign(data, generators(proposal), [key], features, metric))
        n, m = cost(new)
        if n < norm and (ignore_max or m <= top):
            now, norm, top, centres = new, n, m, proposal
    return now, centres


def distances(v: np.ndarray, metric: str | Pairwise | None = None) -> np.ndarray:
    """Distances between all rows; Euclidean ones by products, which is fast and rounds."""
    if metric not in (None, "euclidean"):
        return named(metric)(v, v)
    n = (v * v).sum(axis=1)
    return np.sqrt(np.maximum(n[:, None] + n[None, :] - 2 * v @ v.T, 0))


def clarans(d: np.ndarray, k: int, minima: int = 5, tries: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Randomised medoid swaps on a distance matrix: (medoids, labels, cost) of the best of ``minima`` local minima, each left after
    ``tries`` swaps in a row that lower nothing."""
    rng = np.random.default_rng(seed)
    best: tuple[np.ndarray, float] | None = None
    for _ in range(minima):
        medoids = rng.choice(len(d), k, replace=False)
        cost, misses = float(d[:, medoids].min(axis=1).sum()), 0
        while misses < tries:
            other = medoids.copy()
            other[rng.integers(k)] = rng.integers(len(d))
            c = float(d[:, other].min(axis=1).sum())
            if c < cost and len(set(other.tolist())) == k:
                medoids, cost, misses = other, c, 0
            else:
                misses += 1
        if best is None or cost < best[1]:
            best = medoids, cost
    medoids = np.sort(best[0])
    return medoids, d[:, medoids].argmin(axis=1), best[1]


def subsampled_clarans(frames: DataFrame, k: int, samples: int = 4, size: int = 500, key: str = "id", features: str = "features", seed: int = 0, metric: str | Pairwise | None = None) -> list:
    """Keys of the best medoids: ``samples`` hashed samples of about ``size`` vectors (all, below twice that) are searched side by side, the
    least mean cost wins. ``metric`` as in ``assign``."""
    n = max(1, frames.count())
    rows = frames.where(F.col(features).isNotNull()).select(key, features, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    rows = rows.where(F.pmod(F.xxhash64(key, "sample", F.lit(seed)), F.lit(max(1, n // size))) == 0)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        v = np.stack(pdf[features].to_numpy()).astype(float)
        m, _, cost = clarans(distances(v, metric), min(k, len(v)), seed=seed)
        return pd.DataFrame({"sample": pdf["sample"].iloc[:1], "cost": [cost / len(v)], "medoids": [pdf[key].to_numpy()[m].tolist()]})

    kind = dict(frames.dtypes)[key]
    best = rows.groupBy("sample").applyInPandas(search, f"sample int, cost double, medoids array<{kind}>").orderBy("cost", "sample").limit(1).collect()
    return list(best[0]["medoids"]) if best else []


#: Weights of the recurrence d(k, i+j) = a_i d_ki + a_j d_kj + b d_ij + g |d_ki - d_kj| by method (fixed formulas); on squares for the last three.
METHODS = ("single", "complete", "average", "weighted", "centroid", "median", "ward")


def linkage(d: np.ndarray, method: str = "single") -> np.ndarray:
    """(n - 1) x 4 rows (a, b, distance, size) of agglomerative clustering of a distance matrix; new clusters are numbered from n."""
    if method not in METHODS:
        raise ValueError(f"unknown linkage {method!r}")
    n = len(d)
    if n > MOST_LINKED:
        raise ValueError(f"{n} vectors; a linkage holds at most {MOST_LINKED}")
    squares = method in ("centroid", "median", "ward")
    w = (d**2 if squares else d).astype(float).copy()
    np.fill_diagonal(w, np.inf)
    size, name, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    out = np.zeros((max(0, n - 1), 4))
    for step in range(n - 1):
        i, j = divmod(int(w.argmin()), n)
        i, j = min(i, j), max(i, j)
        h, si, sj = w[i, j], size[i], size[j]
        a, b = sorted((int(name[i]), int(name[j])))
        out[step] = a, b, np.sqrt(max(h, 0)) if squares else h, si + sj
        di, dj = w[i], w[j]
        if method == "single":
            new = np.minimum(di, dj)
        elif method == "complete":
            new = np.maximum(di, dj)
        elif method == "average":
            new = (si * di + sj * dj) / (si + sj)
        elif method == "weighted":
            new = (di + dj) / 2
        elif method == "centroid":
            new = (si * di + sj * dj) / (si + sj) - si * sj * h / (si + sj) ** 2
        elif method == "median":
            new = (di + dj) / 2 - h / 4
        else:
            new = ((si + size) * di + (sj + size) * dj - size * h) / (si + sj + size)
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        w[i], w[:, i], w[j], w[:, j] = new, new, np.inf, np.inf
        size[i], name[i] = si + sj, n + step
    return out


def cut(z: np.ndarray, k: int | None = None, distance: float | None = None) -> np.ndarray:
    """Labels 0.. (in order of first member) after cutting a linkage into ``k`` clusters or at ``distance``; exactly one of both."""
    if (k is None) == (distance is None):
        raise ValueError("give exactly one of k and distance")
    n = len(z) + 1
    merges = z[: n - k] if k is not None else z[z[:, 2] <= distance]
    parent = list(range(2 * n))

    def root(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for step, (a, b, *_) in enumerate(z):
        if k is not None and step >= len(merges) or distance is not None and z[step, 2] > distance:
            continue
        parent[root(int(a))] = parent[root(int(b))] = n + step
    roots = [root(a) for a in range(n)]
    order: dict[int, int] = {}
    return np.array([order.setdefault(r, len(order)) for r in roots])


def sample_vectors(frames: DataFrame, most: int, key: str = "id", features: str = "features", seed: int = 0) -> tuple[list, np.ndarray]:
    """Keys and vectors of a hashed sample of about ``most`` rows (all, if there are no more), in key order."""
    n = max(1, frames.count())
    rows = frames.where(F.col(features).isNotNull()).select(key, features).where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(-(-n // most))) == 0).orderBy(key).collect()
    return [r[0] for r in rows], np.array([list(r[1]) for r in rows], float)


def hierarchical(frames: DataFrame, k: int, method: str = "average", most: int = 2000, key: str = "id", features: str = "features", seed: int = 0, metric: str | Pairwise | None = None) -> DataFrame:
    """``key, state`` of every row of ``frames``: the linkage of a sample of about ``most`` vectors, cut into ``k`` clusters, defines the
    clusters; every vector outside the sample gets the cluster of its nearest sampled one (ties: the smaller key). Null features give a null state."""
    ids, x = sample_vectors(frames, most, key, features, seed)
    label = cut(linkage(distances(x, metric), method), k=min(k, len(ids))).tolist() if ids else []
    spark = frames.sparkSession
    kind = dict(frames.dtypes)[key]
    rank = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], f"gid long, {features} array<double>")
    of_rank = F.broadcast(spark.createDataFrame(list(enumerate(label)), "_rank long, _state int"))
    own = F.broadcast(spark.createDataFrame(list(zip(ids, label, strict=True)), f"{key} {kind}, _own int"))
    near = assign(frames, rank, [key], features, metric).withColumnRenamed("state", "_rank")
    return near.join(of_rank, "_rank", "left").join(own, key, "left").select(key, F.coalesce("_own", "_state").alias("state"))


def save_linkage(spark, z: np.ndarray, path: str) -> None:
    spark.createDataFrame([(k, int(a), int(b), float(d), int(n)) for k, (a, b, d, n) in enumerate(z)], "step int, a int, b int, dist double, size int").coalesce(1).write.mode("errorifexists").parquet(path)


def load_linkage(spark, path: str) -> np.ndarray:
    return np.array([list(r)[1:] for r in spark.read.parquet(path).orderBy("step").collect()], float)
