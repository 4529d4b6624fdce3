import numpy as np
import pytest

from statewise.operators import counting as c
from statewise.operators.matrix import to_dense


def states(spark, trajectories):
    return spark.createDataFrame([(t, f, s) for t, x in enumerate(trajectories) for f, s in enumerate(x)], "traj_id long, frame long, state int")


def brute(trajectories, lag, sliding=True):
    out = {}
    for x in trajectories:
        valid = [k for k, s in enumerate(x) if s is not None]
        if not valid:
            continue
        for t in range(valid[0], len(x) - lag, 1 if sliding else lag):
            if x[t] is not None and x[t + lag] is not None:
                out[x[t], x[t + lag]] = out.get((x[t], x[t + lag]), 0) + 1
    return out


def test_constant_state(spark):
    df = c.transition_counts(states(spark, [[0] * 10] * 10), [1])
    assert [tuple(r) for r in df.collect()] == [(1, 0, 0, 90)]


@pytest.mark.parametrize("lag", [1, 2, 5])
@pytest.mark.parametrize("sliding", [True, False])
def test_counts_equal_brute_force(spark, lag, sliding):
    rng = np.random.default_rng(lag)
    x = [[None if v == 3 else int(v) for v in rng.integers(0, 4, 40)] for _ in range(6)] + [[None] * 5, []]
    got = {(r.i, r.j): r.c for r in c.transition_counts(states(spark, x), [lag], sliding).collect()}
    assert got == brute(x, lag, sliding)


def test_pairs_cross_block_borders(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 8)
    x = [[int(v) for v in np.random.default_rng(1).integers(0, 3, 50)]]
    got = {(r.lag, r.i, r.j): r.c for r in c.transition_counts(states(spark, x), [1, 3, 8]).collect()}
    assert got == {(k, *p): n for k in (1, 3, 8) for p, n in brute(x, k).items()}


def test_bad_lag(spark):
    with pytest.raises(ValueError):
        c.lag_pairs(states(spark, [[0]]), [0])


def test_latest_correction_holds(spark):
    rows = spark.createDataFrame([(1, 0, 5, "2024-01-01"), (1, 0, 7, "2024-01-02"), (1, 1, -1, "2024-01-01"), (1, 2, None, "2024-01-01"), (None, 0, 1, "2024-01-01"), (1, 3, 2, None)], "traj_id long, frame long, state int, loaded_at string")
    got = sorted((r.frame, r.state) for r in c.latest(rows).collect())
    assert got == [(0, 7), (1, None), (2, None), (3, 2)]


def test_rate_matrix_rows(spark):
    s = states(spark, [[0, 0, 1, 0, 1, 1, 0]])
    counts = c.transition_counts(s, [1]).select("i", "j", "c")
    k = to_dense(c.rate_matrix(counts, s, proper=True), "k")
    assert np.allclose(k.sum(axis=1), 0)
    raw = to_dense(c.rate_matrix(counts, s), "k")
    assert raw[0, 0] == pytest.approx(-3 - 1 / 4)


def test_mapping_inversion_renumbering(spark):
    s = states(spark, [[4, 9, None, 4], [9]])
    m = c.renumbering(s)
    assert {(r.old, r.new) for r in m.collect()} == {(4, 0), (9, 1)}
    new = c.apply_mapping(s, m)
    assert sorted((r.traj_id, r.frame, -1 if r.state is None else r.state) for r in new.collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, -1), (0, 3, 0), (1, 0, 1)]
    got = {(r.state, m.traj_id, m.frame) for r in c.invert(s).collect() for m in r.members}
    assert got == {(4, 0, 0), (4, 0, 3), (9, 0, 1), (9, 1, 0)}


def test_chunks_cross_trajectories(spark):
    lengths = spark.createDataFrame([(0, 2), (1, 1), (2, 10)], "traj_id long, length long")
    got = sorted(tuple(r) for r in c.chunks(lengths, 4).collect())
    assert got == [(0, 0, 0, 2), (0, 1, 0, 1), (0, 2, 0, 1), (1, 2, 1, 5), (2, 2, 5, 9), (3, 2, 9, 10)]


def test_sampling(spark):
    s = states(spark, [[0, 0, 0, 1, 1], [0, 2]])
    got = c.sample_per_state(s, 2, seed=3).collect()
    assert {(r.state, r.draw) for r in got} == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)}
    again = c.sample_per_state(s, 3, seed=3, replacement=True).groupBy("state").count().collect()
    assert {(r[0], r[1]) for r in again} == {(0, 3), (1, 3), (2, 3)}
    long = states(spark, [[0] * 1001, [1] * 37, [2] * 3])
    picked = c.stochastic_subsample(long, 4, seed=1)
    assert {(r[0], r[1]) for r in picked.groupBy("traj_id").count().collect()} == {(0, 250), (1, 9)} and picked.distinct().count() == 259


def test_empty(spark):
    empty = states(spark, [])
    assert c.transition_counts(empty, [1]).count() == 0
    assert c.renumbering(empty).count() == 0
    assert c.sample_per_state(empty, 2).count() == 0
