"""Nearest generators, distances to a reference, drifts along a trajectory: joins and windows over frames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statewise.functions import linalg
from statewise.functions.pairwise import Pairwise, named, over_columns
from statewise.session import materialize

#: Generators that one broadcast block holds; more are searched block by block.
GENERATORS = 20_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def assign(frames: DataFrame, generators: DataFrame, keys: list[str], features: str = "features", metric: str | Pairwise | None = None) -> DataFrame:
    """``keys, state, dist``: the nearest generator (``gid``, ``features``) of every frame, ties to the lower id, by ``metric``: a name or a
    function of ``functions.pairwise`` (``rmsd``: features are the flattened coordinates), Euclidean by default.

    Generators are broadcast in blocks of GENERATORS and compared in Arrow batches; nothing is shuffled for one block. Null or differently
    long features, and frames whose distances are not defined, give a null state and distance. Without generators every state is null.
    """
    other = None if metric in (None, "euclidean") else named(metric)
    rows = generators.where(F.col(features).isNotNull()).select("gid", features).orderBy("gid").toLocalIterator()
    blocks: list[list] = [[]]
    for r in rows:
        if len(blocks[-1]) == GENERATORS:
            blocks.append([])
        blocks[-1].append((r[0], list(r[1])))
    sc = frames.sparkSession.sparkContext
    source = frames.select(*keys, features)
    schema = ", ".join(f"{k} {t}" for k, t in source.dtypes if k in keys) + ", state long, dist double"
    parts = []
    for block in blocks:
        ids = np.array([b[0] for b in block], np.int64)
        g = np.array([b[1] for b in block], np.float64) if block else np.empty((0, 0))
        shared = sc.broadcast((ids, g))

        def near(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, g = shared.value
            for batch in batches:
                n = batch.num_rows
                state, dist = np.full(n, -1, np.int64), np.full(n, np.nan)
                col = batch.column(features)
                ok = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(col), g.shape[1]), False).to_numpy(zero_copy_only=False) if len(ids) else np.zeros(n, bool)
                if ok.any():
                    v = _matrix(col.filter(pa.array(ok)), g.shape[1])
                    at = np.flatnonzero(ok)
                    for s in range(0, len(v) if other is not None else 0, 1024):
                        d = other(v[s : s + 1024], g)
                        d[np.isnan(d)] = np.inf
                        k = d.argmin(axis=1)
                        low = d[np.arange(len(d)), k]
                        real = np.isfinite(low)
                        state[at[s : s + 1024][real]], dist[at[s : s + 1024][real]] = ids[k[real]], low[real]
                    for s in range(0, len(v) if other is None else 0, 4096):
                        w = v[s : s + 4096]
                        d = (w * w).sum(axis=1)[:, None] + (g * g).sum(axis=1)[None, :] - 2 * (w @ g.T)
                        low = d.min(axis=1, keepdims=True)
                        near_low = d <= low + 1e-9 * np.maximum(1.0, np.abs(low))
                        exact = np.full(d.shape, np.inf)
                        a, b = np.nonzero(near_low)
                        exact[a, b] = np.sqrt(((w[a] - g[b]) ** 2).sum(axis=1))
                        k = exact.argmin(axis=1)
                        state[at[s : s + 4096]] = ids[k]
                        dist[at[s : s + 4096]] = exact[np.arange(len(w)), k]
                arrays = [batch.column(k) for k in keys]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(state, mask=state < 0), pa.array(dist, from_pandas=True)], [*keys, "state", "dist"])

        parts.append(source.mapInArrow(near, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        out = out.groupBy(*keys).agg(F.min(F.when(F.col("state").isNotNull(), F.struct("dist", "state"))).alias("_m")).select(*keys, F.col("_m.state").alias("state"), F.col("_m.dist").alias("dist"))
    return out


def reference_rmsd(frames: DataFrame, reference: np.ndarray, keys: list[str], xyz: str = "xyz", atoms: list[int] | None = None) -> DataFrame:
    """``keys, dist``: RMSD of every complete frame to a reference after the best superposition; incomplete frames give null."""
    from statewise.functions import framecodec

    n_atoms = len(reference)
    pick = list(range(n_atoms)) if atoms is None else atoms
    source = frames.select(*keys, xyz)
    schema = ", ".join(f"{k} {t}" for k, t in source.dtypes if k in keys) + ", dist double"

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = framecodec.from_lists(batch.column(xyz), n_atoms)
            dist = np.full(batch.num_rows, np.nan)
            if len(x):
                fine = np.isfinite(x).all(axis=(1, 2))
                d = np.full(len(x), np.nan)
                d[fine] = linalg.min_rmsd(x[fine][:, pick], reference[pick])
                dist[keep] = d
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(dist, from_pandas=True)], [*keys, "dist"])

    return source.mapInArrow(measure, schema)


def _blocks(frames: DataFrame, reach: int, size: int) -> DataFrame:
    rows = frames.where("traj_id is not null and frame is not null").withColumn("_b", F.floor(F.col("frame") / size)).withColumn("_own", F.lit(True))
    at = F.col("frame") - F.col("_b") * size
    after = rows.where(at < reach).withColumn("_b", F.col("_b") - 1).withColumn("_own", F.lit(False))
    before = rows.where(at >= size - reach).withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    return rows.unionByName(after).unionByName(before)


def drift(frames: DataFrame, tau: int, metric, features: str = "features", size: int = 4096) -> DataFrame:
    """``traj_id, frame, drift``: distance of each frame to the frame ``tau`` later; null where that frame is missing."""
    if tau < 1:
        raise ValueError("tau must be a positive number of frames")
    size = max(size, tau)
    later = F.first(features).over(Window.partitionBy("traj_id", "_b").orderBy("frame").rangeBetween(tau, tau))
    rows = _blocks(frames, tau, size).withColumn("_l", later).where("_own")
    return rows.select("traj_id", "frame", metric(F.col(features), F.col("_l")).alias("drift"))


def epsilon_neighbourhood(frames: DataFrame, tau: int, metric, features: str = "features", size: int = 4096) -> DataFrame:
    """``traj_id, frame, epsilon``: the larger distance to the frames ``tau`` before and after; at the ends the one there is."""
    size = max(size, tau)
    w = Window.partitionBy("traj_id", "_b").orderBy("frame")
    rows = _blocks(frames, tau, size).withColumn("_l", F.first(features).over(w.rangeBetween(tau, tau))).withColumn("_e", F.first(features).over(w.rangeBetween(-tau, -tau))).where("_own")
    return rows.select("traj_id", "frame", F.greatest(metric(F.col(features), F.col("_l")), metric(F.col(features), F.col("_e"))).alias("epsilon"))


def hitting_time(frames: DataFrame, epsilon: float, metric, features: str = "features", reach: int = 64) -> DataFrame:
    """``traj_id, frame, hit``: frames until the distance first exceeds ``epsilon``; null if it never does.

    Looks ``reach`` frames ahead by a join on blocks of frames; the frames still open look further ahead in longer steps. What is found and
    what is open are written after every step, so the plan does not grow; of a trajectory's open frames only those go on before whose
    last frame the step lies.
    """
    base = materialize(frames.where(F.col(features).isNotNull()).select("traj_id", "frame", features))
    ends = base.groupBy("traj_id").agg(F.max("frame").alias("_end"))
    left, found = base, []
    span, low = reach, 0
    while True:
        a = left.withColumn("_k", F.explode(F.sequence(F.floor((F.col("frame") + low + 1) / span), F.floor((F.col("frame") + low + span) / span))))
        b = base.select("traj_id", F.col("frame").alias("_f"), F.col(features).alias("_x"), F.floor(F.col("frame") / span).alias("_k"))
        ahead = F.col("_f") - F.col("frame")
        met = a.join(b, ["traj_id", "_k"]).where((ahead > low) & (ahead <= low + span) & (metric(F.col(features), F.col("_x")) > epsilon))
        hit = materialize(met.groupBy("traj_id", "frame").agg(F.min(ahead).alias("hit")))
        found.append(hit)
        low += span
        left = materialize(left.join(hit, ["traj_id", "frame"], "left_anti").join(ends, "traj_id").where(F.col("_end") > F.col("frame") + low).drop("_end"))
        if not left.limit(1).count():
            break
        span *= 4
    done = found[0]
    for hit in found[1:]:
        done = done.unionByName(hit)
    return base.select("traj_id", "frame").join(done, ["traj_id", "frame"], "left")


def many_to_many(left: DataFrame, right: DataFrame, key: str, metric, features: str = "features", blocks: int = 8) -> DataFrame:
    """``a, b, dist`` of every vector of ``left`` to every vector of ``right`` (a report on few vectors: its size is a product).

    Both sides are dealt into blocks and block pairs are joined on their numbers, so no cross product is planned. ``metric`` is a
    function of two columns, or a name or function of ``functions.pairwise``, which then compares a pair of blocks at once.
    """
    k = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = left.where(F.col(features).isNotNull()).select(F.col(key).alias("a"), F.col(features).alias("_x"), k.alias("_r")).withColumn("_c", every)
    b = right.where(F.col(features).isNotNull()).select(F.col(key).alias("b"), F.col(features).alias("_y"), k.alias("_c")).withColumn("_r", every)
    if over_columns(metric):
        return a.join(b, ["_r", "_c"]).select("a", "b", metric(F.col("_x"), F.col("_y")).alias("dist"))
    f = named(metric)

    def compare(x, y):
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "dist": []})
        d = f(np.stack(x["_x"].to_numpy()).astype(float), np.stack(y["_y"].to_numpy()).astype(float))
        return pd.DataFrame({"a": np.repeat(x["a"].to_numpy(), len(y)), "b": np.tile(y["b"].to_numpy(), len(x)), "dist": d.ravel()})

    kind = dict(left.dtypes)[key]
    return a.groupBy("_r", "_c").cogroup(b.groupBy("_r", "_c")).applyInPandas(compare, f"a {kind}, b {dict(right.dtypes)[key]}, dist double")


def all_pairs(vectors: DataFrame, key: str, metric, features: str = "features", blocks: int = 8) -> DataFrame:
    """``a, b, dist`` for a < b: the condensed distances of a set of vectors (a report on few vectors: its size is quadratic)."""
    return many_to_many(vectors, vectors, key, metric, features, blocks).where("a < b")


def p_norm(distances: Column, p: float | str) -> Column:
    """(mean of d^p)^(1/p) as an aggregate; ``max`` gives the largest."""
    return F.max(distances) if p == "max" else F.pow(F.avg(F.pow(distances, F.lit(float(p)))), F.lit(1.0 / float(p)))


def assign_with_checkpoint(frames: DataFrame, generators: DataFrame, path: str, features: str = "features", metric: str | Pairwise | None = None) -> DataFrame:
    """``assign`` over ``traj_id, frame``, appended to the table at ``path``; trajectories that are there already are not done again."""
    spark = frames.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    todo = frames
    if there:
        todo = frames.join(spark.read.parquet(path).select("traj_id").distinct(), "traj_id", "left_anti")
    assign(todo, generators, ["traj_id", "frame"], features, metric).write.mode("append").parquet(path)
    return spark.read.parquet(path)
