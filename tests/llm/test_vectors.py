"""Clustering and neighbour search of conformations against brute force, and on odd input."""

import itertools

import numpy as np
import pytest

from statewise.functions import framecodec
from statewise.llm import clusters, neighbours
from statewise.llm import space as sp
from statewise.llm.conformations import plausible

ATOMS, RADIUS = 22, 0.025


def conformations(n, groups, seed=0):
    """Background frames around one structure, and groups of 2..6 frames within a small distance of each other."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(ATOMS, 3)) * 0.3
    x = [base + rng.normal(size=(ATOMS, 3)) * 0.07 for _ in range(n)]
    for g in range(groups):
        centre = base + rng.normal(size=(ATOMS, 3)) * 0.07
        x += [centre + rng.normal(size=(ATOMS, 3)) * 0.006 + rng.normal(size=3) for _ in range(2 + g % 5)]
    order = rng.permutation(len(x))
    return np.round(np.array(x)[order], 3)


def packed(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    vec = framecodec.pack(x).to_pylist() if len(x) else []
    return spark.createDataFrame([(int(i), bytearray(b)) for i, b in zip(ids, vec, strict=True)], "frame_id long, vec binary").repartition(3)


def brute(x):
    v = sp.vectors(x)
    d = np.linalg.norm(v[:, None] - v[None], axis=2)
    near = [(i, j) for i, j in itertools.combinations(range(len(x)), 2) if d[i, j] <= RADIUS]
    label = list(range(len(x)))

    def root(a):
        while label[a] != a:
            a = label[a]
        return a

    for i, j in near:
        a, b = sorted((root(i), root(j)))
        label[b] = a
    return d, [root(a) for a in range(len(x))]


@pytest.mark.parametrize(("part", "overlap"), [(200, sp.OVERLAP), (200, None), (100_000, sp.OVERLAP)])
def test_clusters_equal_brute_force(spark, monkeypatch, part, overlap):
    monkeypatch.setattr(sp, "CELL", 40)
    monkeypatch.setattr(clusters, "TILE", 32)
    x = conformations(500, 60)
    _, root = brute(x)
    got = {(r.frame_id, r.cluster) for r in clusters.cluster_frames(packed(spark, x), part=part, overlap=overlap).collect()}
    sizes = np.bincount(root)
    assert got == {(i, r) for i, r in enumerate(root) if sizes[r] > 1}


@pytest.mark.parametrize(("part", "overlap", "lost"), [(200, sp.OVERLAP, 10), (200, None, 0), (100_000, sp.OVERLAP, 10)])
def test_links_near_the_radius(spark, monkeypatch, part, overlap, lost):
    monkeypatch.setattr(sp, "CELL", 40)
    rng = np.random.default_rng(8)
    x = conformations(500, 0, 7)
    way = rng.normal(size=x.shape)
    way -= way.mean(axis=1, keepdims=True)
    way *= 0.024 / np.sqrt((way**2).sum(axis=(1, 2)) / ATOMS)[:, None, None]
    x = np.concatenate([x, x + way])
    _, root = brute(x)
    sizes = np.bincount(root)
    got = {(r.frame_id, r.cluster) for r in clusters.cluster_frames(packed(spark, x), part=part, overlap=overlap).collect()}
    want = {(i, r) for i, r in enumerate(root) if sizes[r] > 1}
    assert len(want) >= 1000 and got <= want and len(want - got) <= lost


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(sp, "CELL", 40)
    x = conformations(500, 60, 1)
    d, _ = brute(x)
    np.fill_diagonal(d, 9)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), np.round(d[i], 10)))[:3] if d[i, j] <= RADIUS}
    got = {(r.frame_id, r.other): r.d for r in neighbours.neighbours(packed(spark, x), part=200).collect()}
    assert len(set(got) & want) >= 0.97 * len(want) and set(got) <= {(i, j) for i, j in zip(*np.nonzero(d <= RADIUS + 1e-9), strict=True)}
    assert all(abs(d[p] - q) < 1e-8 for p, q in got.items())
    pairs = neighbours.neighbour_pairs(neighbours.neighbours(packed(spark, x))).collect()
    assert all(r.frame_id_a < r.frame_id_b for r in pairs) and len(pairs) == len({tuple(r) for r in pairs})


@pytest.mark.parametrize(("every", "queries"), [(1, 100), (7, 10_000)])
def test_every_query_has_its_nearest(spark, every, queries):
    x = conformations(400, 40, 9)
    x = np.concatenate([x, np.repeat(x[:1], 12, axis=0)])
    d, _ = brute(x)
    np.fill_diagonal(d, 9)
    want = {(i, int(j)) for i in range(0, len(x), every) for j in np.lexsort((np.arange(len(x)), np.round(d[i], 10)))[:3]}
    rows = [(k, 1, k, f.tolist(), 1) for k, f in enumerate(x)]
    rows += rows[:30]
    frames = spark.createDataFrame(rows, "frame_id long, traj_id long, frame long, xyz array<array<double>>, loaded_at int")
    spread_out = neighbours.plausible
    neighbours.plausible = lambda f, n: packed(spark, x, list(range(len(x)))).union(packed(spark, x[:30]))
    try:
        got = {(r.frame_id, r.other): r.d for r in neighbours.nearest_frames(frames, every=every, queries=queries).collect()}
        assert set(got) == want and all(abs(d[p] - q) < 1e-8 for p, q in got.items())
    finally:
        neighbours.plausible = spread_out
    assert neighbours.nearest_frames(frames.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10_000_000, 234_000_000, 2_000_000_000])
def test_parts_grow_with_the_frames(n):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(30_000, 66)) * 0.03
    axes = sp.random_axes(66, sp.DIMS)
    space = sp.fit(v @ axes, np.zeros(66), n, RADIUS, overlap=1.0)
    row, part = space.route(v)
    assert set(row.tolist()) == set(range(len(v))) and part.min() >= 0 and part.max() < space.parts
    size = np.bincount(part, minlength=space.parts) * (n / len(v))
    assert size.mean() <= 1.1 * sp.PART  # of a part the mean; the sample is too small to tell single parts apart beyond some hundred
    few = sp.fit(v @ axes, np.zeros(66), 10_000_000, RADIUS, overlap=1.0)
    assert np.bincount(few.route(v)[1]).max() * (10_000_000 / len(v)) <= 2 * sp.PART


def test_routed_pairs_meet():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20_000, 66)) * 0.03
    way = rng.normal(size=v.shape)
    w = v + way / np.linalg.norm(way, axis=1)[:, None] * 0.02
    space = sp.Forest([sp.fit(v @ sp.random_axes(66, sp.DIMS, seed), np.zeros(66), 3_000_000, RADIUS, seed=seed) for seed in (23, 24)])
    both = [set((row * space.parts + part).tolist()) for row, part in (space.route(v), space.route(w))]
    met = {c // space.parts for c in both[0] & both[1]}
    assert len(met) >= len(v) - 2


def test_dense_cluster_in_one_cell():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9000, 66)) * 0.0008
    space = sp.fit(v @ sp.random_axes(66, sp.DIMS), np.zeros(66), len(v), RADIUS)
    assert len(set(clusters.near_components(v, space).tolist())) == 1


def test_blocks_are_exact():
    rng = np.random.default_rng(5)
    for scale in (40, 4000, 40_000_000):
        ticks = np.rint(rng.normal(size=(50, 66)) * scale).astype(np.int64) + 7
        base = np.rint(rng.normal(size=66) * 300).astype(np.int64)
        ids, back = sp.expand(sp.squeeze(np.arange(50), ticks, base), base)
        assert (ids == np.arange(50)).all() and (back == ticks).all()


def test_collisions_are_counted():
    rng = np.random.default_rng(6)
    ticks = rng.integers(-40, 40, (300, 15)).astype(np.int32)
    index = neighbours.Lines(ticks)
    asked = ticks[:70] + rng.integers(-3, 3, (70, 15)).astype(np.int32)
    for width, need in ((10, 4), (16, 7), (30, 12), (90, 15)):
        i, j = index.colliding(asked, width, need)
        want = (np.abs(asked[:, None] - ticks[None]) <= width).sum(axis=2) >= need
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True))


def test_pairs_of_a_large_cluster(spark):
    members = spark.createDataFrame([(k, k // 40) for k in range(100)], "frame_id long, cluster long")
    want = {(a, b) for a in range(100) for b in range(a + 1, 100) if a // 40 == b // 40}
    assert sorted(map(tuple, clusters.cluster_pairs(members, 7).collect())) == sorted(want)


def test_exact_copies_of_a_third(spark):
    x = conformations(300, 5, 2)
    hot = np.repeat(x[:1], 200, axis=0)
    everything = np.concatenate([x, hot, x[5:6]])
    ids = [*range(len(x)), *range(1000, 1200), 5]
    table = packed(spark, everything, ids)
    got = {r.frame_id: r.cluster for r in clusters.cluster_frames(table).collect()}
    assert {got[k] for k in [0, *range(1000, 1200)]} == {0} and 5 not in got
    near = {}
    for r in neighbours.neighbours(table).collect():
        near.setdefault(r.frame_id, []).append(r.other)
    assert sorted(near[1150]) == [0, 1000, 1001] and sorted(near[0]) == [1000, 1001, 1002] and sorted(near[1001]) == [0, 1000, 1002]


def test_more_copies_than_a_batch_keeps(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        x = np.concatenate([np.repeat(conformations(1, 0), 150, axis=0), conformations(20, 3, 4)])
        table = packed(spark, x)
        near = {}
        for r in neighbours.neighbours(table).collect():
            near.setdefault(r.frame_id, []).append(r.other)
        assert all(sorted(near[k]) == [j for j in range(4) if j != k][:3] for k in range(150))
        got = {r.frame_id: r.cluster for r in clusters.cluster_frames(table).collect()}
        assert {got[k] for k in range(150)} == {0}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_chains_across_parts_merge(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(ATOMS, 3)) * 0.3
    way = rng.normal(size=(ATOMS, 3))
    way -= way.mean(axis=0)
    way *= 0.02 / np.sqrt((way**2).sum() / ATOMS)
    chain = np.array([base + k * way for k in range(200)])
    x = np.concatenate([chain, conformations(400, 0, 3)])
    got = {r.frame_id: r.cluster for r in clusters.cluster_frames(packed(spark, x), part=100).collect()}
    whole = [got.get(k) for k in range(200)]
    assert whole.count(0) >= 198


def test_components_in_rounds(spark):
    edges = [(k, k + 1) for k in range(60) if k != 30] + [(100, 5), (7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    for one_task in (1000, 3):
        got = {r.node: r.root for r in clusters.components(df, one_task).collect()}
        assert all(got[k] == 0 for k in [*range(31), 100]) and all(got[k] == 31 for k in range(31, 61)) and got[201] == 200


@pytest.mark.parametrize("large", [3, 10_000])
def test_medoids(spark, large):
    x = conformations(30, 6, 5)
    table = packed(spark, x)
    v = sp.vectors(x)
    members = clusters.cluster_frames(table)
    by = {}
    for r in members.collect():
        by.setdefault(r.cluster, []).append(r.frame_id)
    for r in clusters.describe_clusters(members, table, large=large).collect():
        m = sorted(by[r.cluster])
        cost = [np.round(((v[m] - v[i]) ** 2).sum(), 9) for i in m]
        assert r["size"] == len(m) and r.medoid == m[int(np.argmin(cost))] and len(r.typical) == min(3, len(m))


def test_odd_input(spark):
    x = conformations(40, 4, 6)
    rows = [(k, 1 + k // 30, k, f.tolist(), 3, "p") for k, f in enumerate(x)]
    rows += [(500, 1, 500, None, 0, "q"), (501, 1, 501, x[0].tolist()[:3], 0, None), (None, 1, 9, x[0].tolist(), 0, ""), rows[0], (502, None, None, x[0].tolist(), 1, "")]
    rows.append((503, 9, 0, [[float("nan")] * 3] * ATOMS, 1, ""))
    schema = "frame_id long, traj_id long, frame long, xyz array<array<double>>, part int, label string"
    df = spark.createDataFrame(rows, schema)
    for f in (clusters.found, neighbours.found):
        got = f(df).collect()
        assert all(r.frame_id_a < r.frame_id_b < 500 for r in got)
        assert f(df.limit(0)).count() == 0
    assert plausible(df).where("frame_id >= 500").count() == 0
    assert clusters.groups_of(df.limit(0)).count() == 0
