import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from statewise.functions import linalg
from statewise.functions import vectors as v
from statewise.operators import clustering, neighbors, structures, tica
from statewise.sources import catalog as cat


def frame(spark, x, name="features"):
    return spark.createDataFrame([(k, [float(a) for a in row]) for k, row in enumerate(x)], f"id long, {name} array<double>")


def test_numeric_metrics(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 5))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    want = {
        "euclidean": np.linalg.norm(a - b), "sqeuclidean": ((a - b) ** 2).sum(), "cityblock": np.abs(a - b).sum(), "chebyshev": np.abs(a - b).max(),
        "minkowski": (np.abs(a - b) ** 3).sum() ** (1 / 3), "cosine": 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), "correlation": 1 - np.corrcoef(a, b)[0, 1],
        "braycurtis": np.abs(a - b).sum() / np.abs(a + b).sum(), "canberra": (np.abs(a - b) / (np.abs(a) + np.abs(b))).sum(),
    }
    got = df.select(*[v.metric(n)(F.col("a"), F.col("b")).alias(n) for n in want]).first().asDict()
    assert got == pytest.approx(want)
    with pytest.raises(TypeError):
        v.metric("none of these")


def test_boolean_metrics(spark):
    for bits in itertools.product([0, 1], repeat=4):
        a, b = [bool(x) for x in bits], [True, True, False, False]
        df = spark.createDataFrame([(a, b)], "a array<boolean>, b array<boolean>")
        got = df.select(*[v.metric(n)(F.col("a"), F.col("b")).alias(n) for n in v.BOOLEAN]).first().asDict()
        tt, tf, ft, ff = (sum(x == p and y == q for x, y in zip(a, b, strict=True)) for p, q in ((1, 1), (1, 0), (0, 1), (0, 0)))
        assert got["matching"] == pytest.approx((tf + ft) / 4) and got["russellrao"] == pytest.approx((4 - tt) / 4)
        assert got["yule"] == pytest.approx(2 * tf * ft / (tt * ff + tf * ft) if tf * ft else 0)
        break


def test_torsion_and_contacts(spark):
    xyz = [[1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 1.0]]
    df = spark.createDataFrame([(xyz,)], "xyz array<array<double>>")
    r = df.select(v.dihedral(F.col("xyz"), 0, 1, 2, 3).alias("d"), v.contacts(F.col("xyz"), [[0, 1], [2, 3]], [(0, 1)]).alias("c"), v.boolean_contacts(v.atom_pairs(F.col("xyz"), [(0, 1), (0, 3)]), [1.5, 1.5]).alias("b"), v.centre(F.col("xyz")).alias("z")).first()
    assert abs(r.d) == pytest.approx(np.pi / 2) and r.c == [1.0] and r.b == [True, False]
    assert np.allclose(np.mean(r.z, axis=0), 0)


@pytest.mark.parametrize("block", [3, 20_000])
def test_assign(spark, monkeypatch, block):
    monkeypatch.setattr(neighbors, "GENERATORS", block)
    rng = np.random.default_rng(1)
    x, g = rng.integers(0, 4, (40, 3)), rng.integers(0, 4, (7, 3))
    df = frame(spark, x).unionByName(spark.createDataFrame([(100, None), (101, [1.0])], "id long, features array<double>"))
    got = {r.id: (r.state, r.dist) for r in neighbors.assign(df, frame(spark, g).withColumnRenamed("id", "gid"), ["id"]).collect()}
    d = np.linalg.norm(x[:, None].astype(float) - g[None], axis=2)
    assert all(got[k][0] == d[k].argmin() and got[k][1] == pytest.approx(d[k].min()) for k in range(40))
    assert got[100] == got[101] == (None, None)


def sequence(spark, n=30, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 2)).cumsum(axis=0)
    return x, spark.createDataFrame([(1, k, r.tolist()) for k, r in enumerate(x)], "traj_id long, frame long, features array<double>")


def test_drift_windows(spark):
    x, df = sequence(spark)
    e = v.metric("euclidean")
    d = np.linalg.norm(x[3:] - x[:-3], axis=1)
    got = {r.frame: r.drift for r in neighbors.drift(df, 3, e, size=8).collect()}
    assert [got[k] for k in range(27)] == pytest.approx(d.tolist()) and got[29] is None
    eps = {r.frame: r.epsilon for r in neighbors.epsilon_neighbourhood(df, 3, e, size=8).collect()}
    assert eps[0] == pytest.approx(d[0]) and eps[10] == pytest.approx(max(d[7], d[10]))
    hit = {r.frame: r.hit for r in neighbors.hitting_time(df, 2.0, e, reach=2).collect()}
    want = {t: next((k - t for k in range(t + 1, 30) if np.linalg.norm(x[k] - x[t]) > 2.0), None) for t in range(30)}
    assert hit == want


def test_pairs_and_centres(spark):
    x = np.array([[0, 0], [1, 0], [0, 0], [5, 5], [9, 0], [1, 0]], float)
    df = frame(spark, x)
    got = {(r.a, r.b): r.dist for r in neighbors.all_pairs(df, "id", v.metric("euclidean"), blocks=3).collect()}
    assert len(got) == 15 and got[0, 3] == pytest.approx(50**0.5)
    table, centres = clustering.k_centers(df, k=3)
    assert centres == [0, 4, 3]
    assert {r.id: r.state for r in table.collect()} == {0: 0, 1: 0, 2: 0, 5: 0, 4: 1, 3: 2}
    assert clustering.k_centers(df, cutoff=6.0)[1] == [0, 4, 3]
    assert clustering.k_centers(df.limit(0), k=2)[1] == []
    labels, medoids = clustering.hybrid_k_medoids(df, 3, rounds=2)
    assert labels.count() == 6 and len(medoids) == 3


def test_linkage_and_medoids():
    x = np.array([[0.0], [0.1], [5], [5.2], [9]])
    d = clustering.distances(x)
    for method in clustering.METHODS:
        assert clustering.cut(clustering.linkage(d, method), k=3).tolist() == [0, 0, 1, 1, 2]
    assert clustering.cut(clustering.linkage(d), distance=1.0).tolist() == [0, 0, 1, 1, 2]
    m, label, cost = clustering.clarans(d, 3, seed=1)
    assert cost == pytest.approx(0.3) and len(set(label)) == 3


def test_hierarchical_labels_every_vector(spark, tmp_path):
    from statewise.plans.registry import QUERIES

    rng = np.random.default_rng(0)
    blob = np.arange(2050) % 10
    x = rng.normal(size=(10, 64))[blob] * 5 + rng.normal(size=(2050, 64)) * 0.1
    rows = [(k, v.tolist(), int(b)) for k, (v, b) in enumerate(zip(x, blob, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.id: r.state for r in QUERIES["hierarchical"](spark, str(tmp_path)).collect()}
    assert len(got) == 2050 and len(set(got.values())) == 10 and len({(blob[k], s) for k, s in got.items()}) == 10
    few = frame(spark, [[0.0], [0.1], [7.0]]).unionByName(spark.createDataFrame([(9, None)], "id long, features array<double>"))
    assert {r.id: r.state for r in clustering.hierarchical(few, 2).collect()} == {0: 0, 1: 0, 2: 1, 9: None}
    assert clustering.hierarchical(few.limit(0), 2).count() == 0


def test_far_and_broken_frames_count(spark, tmp_path):
    from statewise.plans.registry import QUERIES

    rng = np.random.default_rng(0)
    base = rng.normal(size=(22, 3))
    far, nan, inf = base.copy(), base.copy(), base.copy()
    far[3, 0], nan[5, 1], inf[7, 2] = 400.0, np.nan, np.inf
    rows = [(k, 10 + k, 0, None if x is None else x.tolist()) for k, x in enumerate([base, far, nan, inf, None, base[:3]])]
    spark.createDataFrame(rows, "frame_id long, traj_id long, frame long, xyz array<array<double>>").write.parquet(str(tmp_path / "xyz_frames.parquet"))
    atoms = [(k, "C", *map(float, p)) for k, p in enumerate(base)]
    spark.createDataFrame(atoms, "atom int, name string, x double, y double, z double").write.parquet(str(tmp_path / "atoms.parquet"))
    got = {r.traj_id: r.errors for r in QUERIES["rmsd_explosions"](spark, str(tmp_path)).collect()}
    assert set(got) == {11, 12, 13} and got[12] == got[13] == "Explosion: Infinity"
    assert float(got[11].split()[1]) == pytest.approx(linalg.min_rmsd(far[None], base)[0], abs=1e-4)
    for name in ("reference_rmsd", "aligned_positions", "permuted_rmsd", "surface_areas", "sincos_torsions", "atom_pair_distances", "contact_bool", "residue_contacts", "centred_frames"):
        assert {r.frame_id for r in QUERIES[name](spark, str(tmp_path)).collect()} == {0, 1}, name
    pair = QUERIES["atom_pair_distances"](spark, str(tmp_path)).where("frame_id = 1").first()
    assert pair.d1 == pytest.approx(np.linalg.norm(far[3] - far[9]), abs=1e-6)


def test_every_pair_of_vectors(spark, tmp_path):
    from statewise.plans.registry import QUERIES

    x = np.random.default_rng(0).normal(size=(40, 64)).astype(np.float32)
    spark.createDataFrame([(3 * k, r.tolist(), k % 5) for k, r in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = QUERIES["pairwise_condensed"](spark, str(tmp_path)).collect()
    want = {(3 * i, 3 * j): np.linalg.norm(x[i].astype(float) - x[j]) for i, j in itertools.combinations(range(40), 2)}
    assert len(rows) == len(want) == 780 and {(r.a, r.b): r.dist for r in rows} == pytest.approx(want, abs=1e-6)


def test_tica(spark):
    x, df = sequence(spark, 60, 3)
    m = tica.moments(df, 2, 2, size=8)
    a, b = x[:-2], x[2:]
    assert m[0] == 58 and np.allclose(m[3], a.T @ b) and np.allclose(m[1], a.sum(0))
    t = tica.solve(m, 2)
    assert np.allclose(t.vectors.T @ t.covariance @ t.vectors, np.eye(2)) and np.allclose(t.correlation @ t.vectors, t.covariance @ t.vectors * t.values)
    p = df.select("frame", tica.project(F.col("features"), t, [0]).alias("p")).orderBy("frame").collect()
    assert p[4].p[0] == pytest.approx(float(x[4] @ t.vectors[:, 0]))
    assert tica.choose(np.array([3.0, 2, 1]), explained=0.9) == [0, 1]


def test_structures(spark):
    rng = np.random.default_rng(0)
    target = rng.normal(size=(6, 3))
    turn = structures.euler(0.3, 0.8, 1.1)
    swapped = target[[0, 1, 2, 3, 5, 4]] @ turn + 2
    df = spark.createDataFrame([(0, (target @ turn - 1).tolist()), (1, swapped.tolist()), (2, None)], "id long, xyz array<array<double>>")
    a = {r.id: r.features for r in structures.aligned(df, target, ["id"]).collect()}
    assert set(a) == {0, 1} and np.allclose(np.array(a[0]).reshape(6, 3), target - target.mean(axis=0))
    got = {r.id: r.features[0] for r in structures.permuted_rmsd(df, target, ["id"], [0, 1, 2, 3], [[4, 5]]).collect()}
    assert got[0] == pytest.approx(0, abs=1e-6) and got[1] == pytest.approx(0, abs=1e-6)
    one = structures.surface_areas(spark.createDataFrame([(0, [[0.0, 0.0, 0.0], [9.0, 0.0, 0.0]])], "id long, xyz array<array<double>>"), ["C", "H1"], ["id"]).first()
    assert one.area == pytest.approx([4 * np.pi * 0.31**2, 4 * np.pi * 0.26**2])
    assert linalg.min_rmsd(target[None] @ turn, target)[0] == pytest.approx(0, abs=1e-6)
    x = structures.moments_frame(target, np.ones(6))
    inertia = np.einsum("ai,aj->ij", x, x)
    assert np.allclose(inertia - np.diag(np.diag(inertia)), 0, atol=1e-9)


def test_catalog(spark, tmp_path):
    rows = [(5, "a/trj10.h5", 3, None, ["RUN0/CLONE1/frame0.xtc"]), (7, "a/trj2.h5", 2, "bad", None), (9, "a/trj3.h5", 4, None, [])]
    c = cat.Catalog(spark.createDataFrame(rows, cat.SCHEMA), cat.random_frames(spark, [0, 0, 0, 0, 0, 3, 2, 2, 0, 2], 2))
    assert [(r["index"], r.traj_id) for r in c.lengths().orderBy("index").collect()] == [(0, 5), (1, 9)]
    assert {(r.traj_id, r.problem) for r in c.problems().collect()} == {(9, "length")}
    assert c.load_traj(0, stride=2, atoms=[1]).count() == 2
    assert [(r.ord, r.xyz is None) for r in c.load_frames([(0, 1), (1, 9), (0, 1)]).collect()] == [(0, False), (1, True), (2, False)]
    c.save(str(tmp_path / "c.json"))
    assert cat.Catalog.load(spark, str(tmp_path / "c.json")).same_as(c)
    with pytest.raises(ValueError):
        cat.Catalog.load(spark, "x.h5")
    text = "conf_filename: native.pdb\ntrajs:\n- converted_from:\n  - x/frame0.xtc\n  errors: null\n  id: 0\n  length: 5\n  path: t/trj0.h5\n- converted_from:\n  errors: broken\n  id: 1\n  length: 6\n  path: t/trj1.h5\n"
    (tmp_path / "p.yaml").write_text(text)
    y = cat.Catalog.load(spark, str(tmp_path / "p.yaml")).catalog.orderBy("traj_id").collect()
    assert [(r.traj_id, r.length, r.errors) for r in y] == [(0, 5, None), (1, 6, "broken")] and y[0].converted_from == ["x/frame0.xtc"]


def test_text_formats(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real symmetric\n% c\n2 2 2\n1 1 3.5\n2 1 1\n")
    assert {tuple(r) for r in cat.read_mtx(spark, str(tmp_path / "m.mtx")).collect()} == {(0, 0, 3.5), (1, 0, 1.0), (0, 1, 1.0)}
    cat.write_mtx(spark.createDataFrame([(0, 1, 2.0), (1, 1, 0.0)], "i int, j int, c double"), "c", 2, str(tmp_path / "out"))
    assert {tuple(r) for r in cat.read_mtx(spark, str(tmp_path / "out")).collect()} == {(0, 1, 2.0)}
    (tmp_path / "p.dat").write_text("0.5\n\n0.25\n")
    assert {tuple(r) for r in cat.read_dat(spark, str(tmp_path / "p.dat"), "v").collect()} == {(0, 0.5), (1, 0.25)}
    (tmp_path / "n.pdb").write_text("ATOM      1 1HH3 ACE     1       4.300  13.100   8.600  1.00  0.00\nTER\n")
    a = cat.read_pdb(spark, str(tmp_path / "n.pdb")).first()
    assert (a.atom, a.name, a.residue, a.resid, a.x) == (0, "1HH3", "ACE", 1, pytest.approx(0.43))
    assert cat.atom_selection(cat.read_pdb(spark, str(tmp_path / "n.pdb")), "heavy").count() == 0


def test_builder(spark):
    files = spark.createDataFrame([(f"XTC/RUN{r}/CLONE{c}/frame{g}.xtc",) for r in (0, 10) for c in (2,) for g in (0, 1, 10, 2)], "path string")
    rows = cat.listing(files)
    assert [r.gen for r in rows.where("run = 10").orderBy("ord").collect()] == [0, 1, 2, 10]
    assert [r.gen for r in cat.until_gap(rows).where("run = 0").orderBy("gen").collect()] == [0, 1, 2]
    data = [("loc10", 0, "loc10/f0", 0, [[0.0]]), ("loc10", 0, "loc10/f0", 1, [[1.0]]), ("loc10", 1, "loc10/f1", 0, [[1.0]]), ("loc10", 1, "loc10/f1", 1, [[2.0]]), ("loc9", 0, "loc9/f0", 0, [[7.0]])]
    pieces = spark.createDataFrame(data, "location string, piece long, path string, frame long, xyz array<array<double>>")
    known = spark.createDataFrame([(3, "old", 1, None, ["old/f0"])], cat.SCHEMA)
    catalog, frames = cat.build(known, pieces, [cat.too_short(2)])
    got = {r.traj_id: (r.length, r.errors) for r in catalog.collect()}
    assert got == {3: (1, None), 4: (1, "TooLittleData: 1 frames < 2"), 5: (3, None)}
    assert [r.xyz[0][0] for r in frames.where("traj_id = 5").orderBy("frame").collect()] == [0.0, 1.0, 2.0]
    assert cat.build(catalog, pieces)[0].count() == 3
    with pytest.raises(TypeError):
        cat.validate(known, frames, [3])


def test_natural_key(spark):
    names = ["a10b", "a2b", "b1", "a2", "10", "9"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(v.natural_key(F.col("n"))).collect()]
    assert got == ["9", "10", "a2", "a2b", "a10b", "b1"]
    r = spark.range(1).select(v.integer_component(F.lit("frame12.xtc")).alias("a"), v.integer_component(F.lit("x")).alias("b")).first()
    assert (r.a, r.b) == (12, 0)
