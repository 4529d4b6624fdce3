import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise import cli
from statewise.functions import vectors as v
from statewise.operators import clustering, neighbors, tica
from statewise.streaming import trajectories as st


def test_build_and_theory(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(t, f, int(s)) for t in range(5) for f, s in enumerate(rng.integers(3, 7, 200))]
    spark.createDataFrame(rows, "traj_id long, frame long, state int").write.parquet(f"{tmp_path}/a")
    cli.main(["build", "--assignments", f"{tmp_path}/a", "--lag", "2", "--out", f"{tmp_path}/m"])
    p = spark.read.parquet(f"{tmp_path}/m/tprob.parquet")
    assert p.groupBy("i").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert {(r.old, r.new) for r in spark.read.parquet(f"{tmp_path}/m/mapping.parquet").collect()} == {(3, 0), (4, 1), (5, 2), (6, 3)}
    cli.main(["theory", "--tprob", f"{tmp_path}/m/tprob.parquet", "--sources", "0", "--sinks", "3", "--out", f"{tmp_path}/t"])
    assert spark.read.parquet(f"{tmp_path}/t/committors.parquet").where("i = 3").first().v == 1
    cli.main(["timescales", "--assignments", f"{tmp_path}/a", "--lags", "1", "2", "--n", "2", "--symmetrize", "transpose", "--out", f"{tmp_path}/its"])
    assert spark.read.parquet(f"{tmp_path}/its").count() == 4
    cli.main(["lump", "--tprob", f"{tmp_path}/m/tprob.parquet", "--n", "2", "--out", f"{tmp_path}/l"])
    assert spark.read.parquet(f"{tmp_path}/l").select("macro").distinct().count() == 2
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_checkpointed_assignment(spark, tmp_path):
    g = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "gid long, features array<double>")
    rows = [(t, f, [float(10 * (f % 2))]) for t in (1, 2) for f in range(4)]
    frames = spark.createDataFrame(rows, "traj_id long, frame long, features array<double>")
    neighbors.assign_with_checkpoint(frames.where("traj_id = 1"), g, f"{tmp_path}/x")
    got = neighbors.assign_with_checkpoint(frames, g, f"{tmp_path}/x").collect()
    assert len(got) == 8 and all(r.state == r.frame % 2 for r in got)


def test_saved_models(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(40, 2)).cumsum(axis=0)
    df = spark.createDataFrame([(1, k, r.tolist()) for k, r in enumerate(x)], "traj_id long, frame long, features array<double>")
    t = tica.solve(tica.moments(df, 1, 2), 1)
    tica.save(spark, t, f"{tmp_path}/t")
    back = tica.load(spark, f"{tmp_path}/t")
    assert np.allclose(back.vectors, t.vectors) and back.lag == 1
    z = clustering.linkage(clustering.distances(x[:6]))
    clustering.save_linkage(spark, z, f"{tmp_path}/z")
    assert np.allclose(clustering.load_linkage(spark, f"{tmp_path}/z"), z)


def test_stream_of_several_batches(spark, tmp_path):
    x = [0, 1, None, 1, 0, 0, 1, 1, 0]
    for k in range(3):
        rows = [(1, f, x[f]) for f in range(3 * k, 3 * k + 3)] + ([(1, 0, 5)] if k == 2 else [])
        spark.createDataFrame(rows, "traj_id long, frame long, state long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/s")
    stream = st.files(spark, f"{tmp_path}/s", per_trigger=1)
    got = sorted((r.frame, r.i, r.j) for r in st.run_to_end(st.lag_pairs(stream, 2)).collect())
    assert got == [(f, x[f - 2], x[f]) for f in range(2, 9) if x[f] is not None and x[f - 2] is not None]


def test_metric_registry():
    v.REGISTRY["own"] = lambda a, b: a
    assert v.metric("own") is v.REGISTRY.pop("own")
