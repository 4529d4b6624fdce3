"""Command line: ``python -m statewise.cli COMMAND ...`` over parquet tables."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from statewise.operators import clustering, counting, lumping, model, neighbors, paths, structures, tica
from statewise.operators.matrix import from_dense, from_vector, to_dense


def _states(spark: SparkSession, path: str):
    table = spark.read.parquet(path)
    return counting.latest(table) if "loaded_at" in table.columns else table.select("traj_id", "frame", F.when(F.col("state") >= 0, F.col("state")).alias("state"))


def build(spark, a) -> None:
    """Counts at a lag, trimming, estimation; writes tcounts, tprob, populations, mapping and the relabelled assignments."""
    states = _states(spark, a.assignments)
    numbers = counting.renumbering(states)
    dense = counting.apply_mapping(states, numbers)
    m = model.build(to_dense(counting.transition_counts(dense, [a.lag], not a.strided).select("i", "j", "c"), "c"), a.symmetrize, not a.no_trim)
    from_dense(spark, m.counts, "c").write.parquet(f"{a.out}/tcounts.parquet")
    from_dense(spark, m.tprob, "p").write.parquet(f"{a.out}/tprob.parquet")
    from_vector(spark, m.populations).write.parquet(f"{a.out}/populations.parquet")
    mapping = from_vector(spark, m.mapping, "k").select(F.col("i").alias("new"), F.col("k").cast("int").alias("k")).join(numbers, "new").select("old", F.col("k").alias("new"))
    mapping.write.parquet(f"{a.out}/mapping.parquet")
    counting.apply_mapping(states, mapping).write.parquet(f"{a.out}/assignments.parquet")


def timescales(spark, a) -> None:
    states = _states(spark, a.assignments)
    counts = counting.transition_counts(counting.apply_mapping(states, counting.renumbering(states)), a.lags)
    rows = []
    for lag in a.lags:
        t = model.implied_timescales(to_dense(counts.where(F.col("lag") == lag), "c"), lag, a.n, a.symmetrize)
        rows += [(lag, k, float(x)) for k, x in enumerate(t, 1)]
    spark.createDataFrame(rows, "lag int, k int, timescale double").write.parquet(a.out)


def cluster(spark, a) -> None:
    """Labels and generators of k-centers, hybrid k-medoids or randomised medoids under a metric."""
    frames = spark.read.parquet(a.frames)
    if a.method == "clarans":
        centres = clustering.subsampled_clarans(frames, a.k, key=a.key, metric=a.metric)
    elif a.method == "kmedoids":
        centres = clustering.hybrid_k_medoids(frames, a.k, key=a.key, metric=a.metric)[1]
    else:
        centres = clustering.k_centers(frames, a.k, a.cutoff, key=a.key, metric=a.metric)[1]
    order = spark.createDataFrame([(c, n) for n, c in enumerate(centres)], f"{a.key} {dict(frames.dtypes)[a.key]}, gid long")
    frames.join(order, a.key).select("gid", "features").write.parquet(f"{a.out}/generators.parquet")
    neighbors.assign(frames, spark.read.parquet(f"{a.out}/generators.parquet"), [a.key], metric=a.metric).write.parquet(f"{a.out}/assignments.parquet")


def hierarchical(spark, a) -> None:
    """A label for every row: linkage of a sample, cut into k clusters, the rest by the nearest sampled row."""
    clustering.hierarchical(spark.read.parquet(a.frames), a.k, a.method, key=a.key, metric=a.metric).write.parquet(a.out)


def assign(spark, a) -> None:
    """The nearest generator of every frame, appended trajectory by trajectory."""
    neighbors.assign_with_checkpoint(spark.read.parquet(a.frames), spark.read.parquet(a.generators), a.out, metric=a.metric)


def tica_train(spark, a) -> None:
    """A projection fitted to feature sequences (traj_id, frame, features)."""
    frames = spark.read.parquet(a.frames)
    width = frames.agg(F.max(F.size("features"))).first()[0]
    tica.save(spark, tica.solve(tica.moments(frames, a.lag, width), a.lag), a.out)


def passage_times(spark, a) -> None:
    """Mean first passage times to one state, or between all."""
    t = to_dense(spark.read.parquet(a.tprob), "p")
    (from_dense(spark, paths.all_mfpts(t, lag=a.lag), "v", keep_zero=True) if a.state < 0 else from_vector(spark, paths.mfpt(a.state, t, a.lag))).write.parquet(a.out)


def structures_of(spark, a) -> None:
    """Sampled frames of every state, with their coordinates."""
    picked = counting.sample_per_state(_states(spark, a.assignments), a.n, a.seed, a.replacement)
    frames = spark.read.parquet(a.frames).dropDuplicates(["traj_id", "frame"]).select("traj_id", "frame", "xyz")
    structures.save_structures(picked.join(frames, ["traj_id", "frame"]), a.out, a.style)


def trajectory(spark, a) -> None:
    """A walk over a model's states, with a frame drawn anew for every visit."""
    states = model.walk(to_dense(spark.read.parquet(a.tprob), "p"), a.start, a.steps, a.seed)
    walk = spark.createDataFrame([(int(s), k) for k, s in enumerate(states)], "state int, draw int")
    counting.draws(_states(spark, a.assignments), walk, a.seed).withColumnRenamed("draw", "step").write.parquet(a.out)


def theory(spark, a) -> None:
    t = to_dense(spark.read.parquet(a.tprob), "p")
    from_vector(spark, paths.committors(a.sources, a.sinks, t)).write.parquet(f"{a.out}/committors.parquet")
    from_dense(spark, paths.net_fluxes(a.sources, a.sinks, t), "f").write.parquet(f"{a.out}/net_flux.parquet")
    from_vector(spark, paths.mfpt(a.sinks, t, a.lag)).write.parquet(f"{a.out}/mfpt.parquet")
    rows = [(n, p, f, i, j) for n, (p, f, i, j) in enumerate(paths.top_paths(a.sources, a.sinks, t, a.n))]
    spark.createDataFrame(rows, "rank int, nodes array<int>, flux double, b1 int, b2 int").write.parquet(f"{a.out}/paths.parquet")


def lump(spark, a) -> None:
    if a.method == "bace":
        label = lumping.bace(to_dense(spark.read.parquet(a.tprob), "c"), a.n)[0]
    else:
        t = to_dense(spark.read.parquet(a.tprob), "p")
        label = lumping.pcca(t, a.n) if a.method == "pcca" else lumping.pcca_plus(t, a.n)[0]
    from_vector(spark, np.asarray(label), "macro").write.parquet(a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="statewise", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *arguments):
        s = sub.add_parser(name, help=f.__doc__)
        for flag, options in arguments:
            s.add_argument(flag, **options)
        s.add_argument("--out", required=True)
        s.set_defaults(run=f)

    whole = {"type": int, "required": True}
    many = {"type": int, "nargs": "+", "required": True}
    kind = ("--symmetrize", {"default": "mle"})
    add("build", build, ("--assignments", {"required": True}), ("--lag", {"type": int, "default": 1}), kind, ("--no-trim", {"action": "store_true"}), ("--strided", {"action": "store_true"}))
    add("timescales", timescales, ("--assignments", {"required": True}), ("--lags", many), ("--n", {"type": int, "default": 10}), kind)
    frames, key, metric = ("--frames", {"required": True}), ("--key", {"default": "id"}), ("--metric", {"default": None})
    assignments, tprob, lag, seed = ("--assignments", {"required": True}), ("--tprob", {"required": True}), ("--lag", {"type": float, "default": 1.0}), ("--seed", {"type": int, "default": 0})
    add("cluster", cluster, frames, key, ("--k", {"type": int}), ("--cutoff", {"type": float}), metric, ("--method", {"choices": ["kcenters", "kmedoids", "clarans"], "default": "kcenters"}))
    add("hierarchical", hierarchical, frames, key, ("--k", whole), metric, ("--method", {"choices": clustering.METHODS, "default": "average"}))
    add("assign", assign, frames, ("--generators", {"required": True}), metric)
    add("tica", tica_train, frames, ("--lag", {"type": int, "default": 1}))
    add("mfpt", passage_times, tprob, ("--state", {"type": int, "default": -1}), lag)
    add("structures", structures_of, assignments, frames, ("--n", whole), seed, ("--replacement", {"action": "store_true"}), ("--style", {"choices": ["sep", "tps", "one"], "default": "sep"}))
    add("trajectory", trajectory, assignments, tprob, ("--start", {"type": int, "default": None}), ("--steps", whole), seed)
    add("theory", theory, ("--tprob", {"required": True}), ("--sources", many), ("--sinks", many), ("--lag", {"type": float, "default": 1.0}), ("--n", {"type": int, "default": 10}))
    add("lump", lump, ("--tprob", {"required": True}), ("--n", whole), ("--method", {"choices": ["pcca", "pcca_plus", "bace"], "default": "pcca"}))
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
