"""Metrics in clustering and assignment, frames drawn per visit, numbering, growth of trajectories, lumping by sign, profile times."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise import cli, session
from statewise.functions import linalg, pairwise
from statewise.functions import vectors as v
from statewise.operators import clustering, counting, lumping, model, neighbors, paths, skew
from statewise.sources import catalog as cat


def metastable(n, groups, seed):
    rng = np.random.default_rng(seed)
    c = rng.random((n, n)) * 0.02
    for g in range(groups):
        at = np.flatnonzero(np.arange(n) % groups == g)
        c[np.ix_(at, at)] += rng.random((len(at), len(at))) * (1 + g)
    return linalg.normalize_rows(c + c.T)


def test_lumping_by_sign():
    differs = 0
    for seed in range(8):
        t = metastable(100, 6, seed)
        _, right = lumping.modes(t, 5)
        want = np.zeros(100, int)
        other = np.zeros(100, int)
        for k in range(1, 5):
            for label, cut in ((want, 1e-5), (other, None)):
                x = right[:, k]
                spread = [np.ptp(x[label == m]) for m in range(k)]
                m = label == int(np.argmax(spread))
                at = (x[m].max() + x[m].min()) / 2 if cut is None else cut
                label[m & (x >= at)] = k
        got = lumping.pcca(t, 5)
        assert (got == want).all() and len(set(got.tolist())) == 5
        differs += (want != other).any()
    assert differs  # the rule matters: splitting at the middle gives other macrostates


def test_feasible_memberships():
    t = metastable(30, 3, 1)
    _, right = lumping.modes(t, 3)
    a = lumping.fill_feasible(np.random.default_rng(0).normal(size=(3, 3)), right)
    chi = lumping.memberships(a, right)
    assert np.allclose(chi.sum(axis=1), 1) and chi.min() > -1e-9


def test_profile_time_is_the_integral():
    rng = np.random.default_rng(2)
    c = rng.random((6, 6))
    c = c + c.T
    x = rng.permutation(6) / 5.0
    order = np.argsort(x)
    low, high = int(order[0]), int(order[-1])
    _, zh, zc = paths.cut_profile(c, x)
    zc[-1] = zc[-2]
    inner, total, grid = 0.0, 0.0, np.sort(x)
    last = 0.0
    for k in range(1, 6):
        h = grid[k] - grid[k - 1]
        inner += h * (zh[k] + zh[k - 1]) / 2
        now = zh[k] / zc[k] ** 2 * inner
        total += h * (now + last) / 2
        last = now
    assert paths.profile_mfpt(c, x, low, high, 3.0) == pytest.approx(3 / np.pi * total)
    assert paths.profile_mfpt(c, x, high, low) == 0 and paths.profile_mfpt(c, x, low, low) == 0


def test_path_times():
    t = linalg.normalize_rows(np.random.default_rng(4).random((5, 5)))
    p = t[[0, 1]].copy()
    p[:, [0, 1]] = 0
    p /= p.sum(axis=1, keepdims=True)
    out = p @ paths.mfpt([4], t, 2.0)
    assert paths.path_times([0, 1], [4], t, 2.0) == pytest.approx((out.mean(), out.std()))


def test_hub_scores_equal_their_definition():
    t = linalg.normalize_rows(np.random.default_rng(5).random((6, 6)) + 0.05)
    for w, got in enumerate(paths.hub_scores(t)):
        others = [s for s in range(6) if s != w]
        assert got == pytest.approx(np.mean([paths.fraction_visits(t, w, a, b) for a, b in itertools.permutations(others, 2)]))


def test_components_of_chains():
    a = np.zeros((2000, 2000))
    a[np.arange(1999), np.arange(1, 2000)] = 1
    assert (linalg.components(a) == np.arange(2000)).all()
    a[1999, 0] = 1
    assert (linalg.components(a) == 0).all()


def test_array_metrics_equal_column_metrics(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(4, 5)), rng.normal(size=(3, 5))
    rows = [(i, j, a.tolist(), b.tolist()) for i, a in enumerate(x) for j, b in enumerate(y)]
    df = spark.createDataFrame(rows, "i int, j int, a array<double>, b array<double>")
    inverse = (np.eye(5) + 0.2).tolist()
    pairs = {k: (f, pairwise.metric(k)) for k, f in v.NUMERIC.items()}
    pairs["seuclidean"] = v.seuclidean([1, 2, 3, 4, 5]), pairwise.metric("seuclidean", variances=[1, 2, 3, 4, 5])
    pairs["mahalanobis"] = v.mahalanobis(inverse), pairwise.metric("mahalanobis", inverse=inverse)
    pairs["sqmahalanobis"] = v.sqmahalanobis(inverse), pairwise.metric("sqmahalanobis", inverse=inverse)
    out = df.select("i", "j", *[f(F.col("a"), F.col("b")).alias(k) for k, (f, _) in pairs.items()]).collect()
    for k, (_, g) in pairs.items():
        d = g(x, y)
        assert all(r[k] == pytest.approx(d[r.i, r.j]) for r in out), k
    flags = spark.createDataFrame([(i, j, (a > 0).tolist(), (b > 0).tolist()) for i, a in enumerate(x) for j, b in enumerate(y)], "i int, j int, a array<boolean>, b array<boolean>")
    out = flags.select("i", "j", *[f(F.col("a"), F.col("b")).alias(k) for k, f in v.BOOLEAN.items() if k in pairwise.NAMED]).collect()
    for k in set(v.BOOLEAN) & set(pairwise.NAMED):
        d = pairwise.metric(k)(x > 0, y > 0)
        assert all((r[k] is None and np.isnan(d[r.i, r.j])) or r[k] == pytest.approx(d[r.i, r.j]) for r in out), k
    with pytest.raises(TypeError):
        pairwise.metric("nothing")
    with pytest.raises(ValueError):
        pairwise.metric("seuclidean")


def test_rmsd_equals_superposition():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(6, 9, 3)), rng.normal(size=(4, 9, 3))
    x[0] = y[0] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + 5
    x[1] = y[1] * [1, 1, -1]
    got = pairwise.rmsd(x.reshape(6, -1), y.reshape(4, -1))
    want = np.stack([linalg.min_rmsd(x, target) for target in y], axis=1)
    assert np.allclose(got, want, atol=2e-6)


@pytest.mark.parametrize("metric", ["rmsd", "cityblock", None])
def test_clustering_under_a_metric(spark, metric):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 12))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(99, None), (98, [1.0])], "id long, features array<double>")
    d = pairwise.named(metric)(x, x)
    centres, dist = [0], d[:, 0].copy()
    while len(centres) < 4:
        centres.append(int(dist.argmax()))
        dist = np.minimum(dist, d[:, centres[-1]])
    labels, got = clustering.k_centers(df, 4, metric=metric)
    assert got == centres and {r.id: round(r.dist, 6) for r in labels.collect()} == {k: round(z, 6) for k, z in enumerate(dist)}
    gens = spark.createDataFrame([(n, x[c].tolist()) for n, c in enumerate(centres)], "gid long, features array<double>")
    near = {r.id: r.state for r in neighbors.assign(df, gens, ["id"], metric=metric).collect()}
    assert near == {**{k: int(d[k, centres].argmin()) for k in range(30)}, 99: None, 98: None}
    fine = df.where("id < 90")
    labels, _ = clustering.hybrid_k_medoids(fine, 3, rounds=2, metric=metric)
    assert labels.count() == 30 and len(clustering.subsampled_clarans(fine, 3, metric=metric)) == 3
    assert clustering.hierarchical(fine, 3, metric=metric).select("state").distinct().count() == 3
    pairs = {(r.a, r.b): r.dist for r in neighbors.all_pairs(fine, "id", metric or "euclidean", blocks=3).collect()}
    assert len(pairs) == 435 and all(z == pytest.approx(d[a, b], abs=1e-6) for (a, b), z in pairs.items())


def test_hybrid_of_parts():
    x = np.random.default_rng(9).normal(size=(5, 6))
    f = pairwise.hybrid([(pairwise.metric("euclidean"), slice(0, 3), 2.0), (pairwise.metric("cityblock"), slice(3, 6), 0.5)])
    want = 2 * np.linalg.norm(x[0, :3] - x[1, :3]) + 0.5 * np.abs(x[0, 3:] - x[1, 3:]).sum()
    assert f(x, x)[0, 1] == pytest.approx(want)


def test_numbering_and_long_lags(spark):
    rows = [(u, (7 * k) % 50, k) for u in (1, 2) for k in range(50)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "u long, t long, k long").repartition(5)
    got = {(r.u, r.t): r.frame for r in counting.numbered(df, "u", ["t", "k"]).collect()}
    assert got == {(u, t): t for u in (1, 2) for t in range(50)}
    states = spark.createDataFrame([(1, f, f % 3) for f in (0, 5000, 9000, 10_000)], "traj_id long, frame long, state int")
    assert {tuple(r) for r in counting.lag_pairs(states, [5000, 9000]).collect()} == {(5000, 0, 2), (5000, 2, 1), (9000, 0, 0)}
    still = spark.createDataFrame([(1, f, [float(f)]) for f in (0, 5000)], "traj_id long, frame long, features array<double>")
    assert neighbors.drift(still, 5000, v.metric("euclidean")).where("drift = 5000").count() == 1


def test_draws_are_anew_for_every_visit(spark):
    states = spark.createDataFrame([(1, f, 0 if f < 60 else 1) for f in range(80)] + [(2, 0, None)], "traj_id long, frame long, state int")
    wanted = spark.createDataFrame([(k % 2, k) for k in range(400)] + [(7, 1000)], "state int, draw int")
    got = counting.draws(states, wanted, seed=1).collect()
    assert len(got) == 400 and {r.draw for r in got} == set(range(400))
    assert all((r.frame < 60) == (r.state == 0) for r in got)
    first = [r.frame for r in got if r.state == 0]
    assert len(set(first)) > 45  # of 60 frames 200 draws leave about two out
    assert counting.sample_per_state(states, 5, replacement=True).groupBy("state").count().where("count = 5").count() == 2


def test_original_states_after_trimming(spark):
    chain = [5, 9, 5, 9, 9, 5, 3]  # 3 is never left
    states = spark.createDataFrame([(1, f, s) for f, s in enumerate(chain)], "traj_id long, frame long, state int")
    numbers = counting.renumbering(states)
    from statewise.operators.matrix import from_vector, to_dense

    counts = counting.transition_counts(counting.apply_mapping(states, numbers), [1]).select("i", "j", "c")
    m = model.build(to_dense(counts, "c", 3))
    used = np.array([r.old for r in numbers.orderBy("new").collect()])
    assert m.mapping.tolist() == [-1, 0, 1]
    assert [r.i for r in from_vector(spark, m.populations, names=used[m.mapping >= 0]).orderBy("i").collect()] == [5, 9]


def test_trajectories_grow(spark):
    schema = "location string, piece long, path string, frame long, xyz array<array<double>>"
    first = spark.createDataFrame([("a", 0, "a/f0", k, [[float(k)]]) for k in range(3)], schema)
    known = spark.createDataFrame([], cat.SCHEMA)
    catalog, frames = map(session.materialize, cat.build(known, first))  # as an ingest does, which writes what it has
    assert [(r.traj_id, r.length) for r in catalog.collect()] == [(0, 3)]
    more = first.union(spark.createDataFrame([("a", 1, "a/f1", k, [[2.0 + k]]) for k in range(3)] + [("b", 0, "b/f0", 0, [[0.0]])], schema))
    grown, new = map(session.materialize, cat.build(catalog, more, stored=frames))
    assert {r.traj_id: (r.length, r.converted_from) for r in grown.collect()} == {0: (5, ["a/f0", "a/f1"]), 1: (1, ["b/f0"])}
    assert sorted((r.traj_id, r.frame, r.xyz[0][0]) for r in new.collect()) == [(0, 3, 3.0), (0, 4, 4.0), (1, 0, 0.0)]
    whole, new = map(session.materialize, cat.build(catalog, more))
    assert {r.traj_id: r.length for r in whole.collect()} == {0: 6, 1: 1} and new.count() == 4
    same, none = map(session.materialize, cat.build(grown, more))
    assert none.count() == 0 and {r.traj_id: r.length for r in same.collect()} == {0: 5, 1: 1}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_beyond_a_broadcast(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 2)
    left = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(60)] + [(None, 99)], "key long, a long")
    right = spark.createDataFrame([(1, b) for b in range(5)] + [(3, 7), (6, 8), (None, 9)], "key long, b long")
    want = sorted(map(str, left.join(right, "key", how).collect()))
    assert sorted(map(str, skew.skew_join(left, right, "key", 0.2, how).collect())) == want
    assert session.BROADCAST_ROWS > 2


def test_more_commands(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(t, f, rng.normal(size=3).tolist(), [[float(f), 0.0, 0.0]], int(rng.integers(0, 3)), 100 * t + f) for t in range(2) for f in range(40)]
    spark.createDataFrame(rows, "traj_id long, frame long, features array<double>, xyz array<array<double>>, state int, id long").write.parquet(f"{tmp_path}/f")
    f = f"{tmp_path}/f"
    for method in ("kcenters", "kmedoids", "clarans"):
        cli.main(["cluster", "--frames", f, "--k", "3", "--metric", "cityblock", "--method", method, "--out", f"{tmp_path}/{method}"])
        assert spark.read.parquet(f"{tmp_path}/{method}/assignments.parquet").count() == 80
    cli.main(["hierarchical", "--frames", f, "--k", "4", "--out", f"{tmp_path}/h"])
    assert spark.read.parquet(f"{tmp_path}/h").select("state").distinct().count() == 4
    cli.main(["assign", "--frames", f, "--generators", f"{tmp_path}/kcenters/generators.parquet", "--metric", "cosine", "--out", f"{tmp_path}/a"])
    cli.main(["tica", "--frames", f, "--lag", "2", "--out", f"{tmp_path}/t"])
    cli.main(["build", "--assignments", f, "--out", f"{tmp_path}/m"])
    p = f"{tmp_path}/m/tprob.parquet"
    cli.main(["mfpt", "--tprob", p, "--out", f"{tmp_path}/all"])
    cli.main(["mfpt", "--tprob", p, "--state", "1", "--out", f"{tmp_path}/one"])
    assert spark.read.parquet(f"{tmp_path}/all").count() == 9 and spark.read.parquet(f"{tmp_path}/one").where("v = 0").count() == 1
    cli.main(["structures", "--assignments", f, "--frames", f, "--n", "4", "--style", "tps", "--out", f"{tmp_path}/s"])
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("state").count().where("count = 4").count() == 3
    cli.main(["trajectory", "--assignments", f, "--tprob", p, "--steps", "30", "--out", f"{tmp_path}/w"])
    assert spark.read.parquet(f"{tmp_path}/w").count() == 30
