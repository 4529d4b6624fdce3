"""Implausible values and heavy keys on dirty input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise.functions import framecodec
from statewise.operators import anomalies as an
from statewise.operators import skew
from statewise.operators.islands import islands

ATOMS = 4
XYZ = "frame_id long, traj_id long, frame long, xyz array<array<double>>, vec string, blk int"


def trajectory(n, seed=0, drift=0.0, scale=0.02):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(1, ATOMS, 3)) * 0.5 + 3
    return np.round(base + rng.normal(size=(n, ATOMS, 3)) * scale + np.arange(n)[:, None, None] * drift, 3)


def rows(x, traj=1, first=0):
    return [(first + k, traj, k, f.tolist(), "clash", 7) for k, f in enumerate(x)]


def found(spark, data, schema=XYZ):
    scores = an.frame_scores(spark.createDataFrame(data, schema), ATOMS)
    return sorted((r.traj_id, r.frame) for r in an.faulty_frames(scores).collect())


def test_spikes_stuck_and_impossible(spark):
    x = trajectory(300)
    x[40, 2] += 1.0
    x[90:92] += 6.0
    x[120:127, 1] = x[120, 1]
    x[200, 0] = -9999.0
    x[210, 3, 1] = np.nan
    x[220, 3, 1] = np.inf
    x[230, 2] = x[230, 1]
    lively = trajectory(150, 3, drift=0.01, scale=0.2)
    want = [(1, f) for f in (40, 90, 91, *range(120, 127), 200, 210, 220, 230)]
    assert found(spark, rows(x) + rows(lively, 2, 1000)) == sorted(want)


def test_offset_is_normal_and_missing_data_is_no_case(spark):
    x = trajectory(120, 5)
    x[60:] += 2.0
    data = rows(x)
    data[10] = (10, 1, 10, None, None, None)
    data[11] = (11, 1, 11, x[11].tolist()[:2], None, None)
    data[12] = (12, 1, 12, [None, *x[12].tolist()[1:]], None, None)
    data += [data[20], (None, 1, 500, x[0].tolist(), "", 0), (900, None, 0, x[0].tolist(), "", 0), (901, 1, None, x[0].tolist(), "", 0)]
    assert found(spark, data) == []


def test_empty_frames(spark):
    assert found(spark, []) == []


def test_codec_is_exact():
    x = np.array([[[0.001, -3.25, 32.767]], [[1e12, np.nan, 0.1234567]], [[-0.0, 5.0, -32.767]]])
    back = framecodec.unpack(framecodec.pack(x), 1)
    assert np.array_equal(back, x, equal_nan=True)


MESSAGES = [
    ("RMSDExplosionError: rmsd 0.04380 nanometer after 181 frames", 0.0438),
    ("RMSDExplosionError(frame=377, rmsd=0.4279A)", 0.04279),
    ("ValidationError frame 374 RMSD 0,4047 Å", 0.04047),
    ("rmsd: 4.0194e-02 nm (topology check passed, 3 files)", 0.040194),
    ("[262] validator warned, RMSD = -0.3921 angstrom", -0.03921),
    ("MinLengthError: 6 frames < 20", None),
    ("truncated frame file", None),
    ("", None),
    (None, None),
]


def test_readings_are_parsed(spark):
    df = spark.createDataFrame([(k, 0, m) for k, (m, _) in enumerate(MESSAGES)], "traj_id long, run_no int, errors string")
    got = {r.traj_id: r.nm for r in an.readings(df).collect()}
    assert got == pytest.approx({k: v for k, (_, v) in enumerate(MESSAGES) if v is not None})


@pytest.mark.parametrize("block", [4, 1024])
def test_faulty_readings(spark, block):
    rng = np.random.default_rng(0)
    said = [f"rmsd {v:.5f} nm" for v in rng.uniform(0.04, 0.06, 40)]
    said[3], said[9], said[15], said[16] = "rmsd 5.1 nm", "rmsd -0.05 nm", "rmsd nan nm", "rmsd 0.001 A"
    for k in (21, 22, 24, 25):
        said[k] = "rmsd 0.05123 nm" if k % 2 else "rmsd 0.5123 A"
    said[23] = "truncated frame file"
    said[30] = said[31] = said[32] = "rmsd 0.04567 nm"
    df = spark.createDataFrame([(k, 0, m, 1.0) for k, m in enumerate(said)] + [(100, None, "rmsd 0.5 nm", 2.0), (None, 0, "rmsd 9 nm", 0.0)], "traj_id long, run_no int, errors string, nm double")
    assert sorted(r[0] for r in an.faulty_readings(df, block).collect()) == [3, 9, 15, 16, 21, 22, 24, 25]


def test_islands_across_blocks(spark):
    rng = np.random.default_rng(2)
    data = [(int(k), int(t)) for k in (1, 2) for t in np.flatnonzero(rng.random(400) < 0.8)]
    df = spark.createDataFrame(data, "k long, t long")
    got = sorted((r.k, r.first.t, r.last.t, r.n) for r in islands(df, ["k"], "t", lambda p, c: c["t"] - p["t"] <= 1, block=F.floor(F.col("t") / 16)).collect())
    want, run = [], None
    for k, t in data:
        if run and run[0] == k and t - run[2] <= 1:
            run[2], run[3] = t, run[3] + 1
        else:
            if run:
                want.append(tuple(run))
            run = [k, t, t, 1]
    assert got == sorted([*want, tuple(run)])


KEYS = [5] * 600 + [7] * 300 + list(range(100, 1000)) + [-1] * 500 + [None] * 500


def test_heavy_keys(spark):
    df = spark.createDataFrame([(k, "x") for k in KEYS], "key int, n string").repartition(6)
    got = {(r.key, r.n) for r in skew.heavy_keys(df, "key").collect()}
    assert got == {(5, 600), (7, 300)}
    empty = df.limit(0)
    assert skew.heavy_keys(empty, "key").count() == 0
    assert skew.heavy_keys(df.where("key is null"), "key").count() == 0


def test_sketch_loses_no_heavy_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "COUNTERS", 1)
    rng = np.random.default_rng(0)
    keys = np.concatenate([np.repeat(3, 400), np.repeat(4, 301), rng.permutation(9299) + 10])
    df = spark.createDataFrame([(int(k),) for k in rng.permutation(keys)], "k long").repartition(5)
    assert {r.key for r in skew.heavy_keys(df, "k").collect()} == {3, 4}


def test_skew_join_and_aggregate(spark):
    left = spark.createDataFrame([(k, n) for n, k in enumerate(KEYS)], "k int, n long")
    right = spark.createDataFrame([(5, "five"), (101, "a"), (101, "b"), (-1, "neg"), (None, "null")], "k int, name string")
    for how in ("inner", "left"):
        plain = left.join(right, "k", how)
        fast = skew.skew_join(left, right, "k", how=how).select(*plain.columns)
        assert fast.exceptAll(plain).count() == 0 and plain.exceptAll(fast).count() == 0
    got = {r.k: (r.n, r.names) for r in skew.skew_aggregate(left.where("k >= 0"), "k", {"c": F.count(F.lit(1)), "s": F.collect_set(F.col("n") % 3)}, lambda: [F.sum("c").alias("n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("s")))).alias("names")]).collect()}
    assert got[5] == (600, [0, 1, 2]) and got[7][0] == 300 and len(got) == 902
