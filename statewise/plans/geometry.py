"""Queries of metrics, featurizers, neighbour search, drifts, clustering, projections and catalogs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from statewise.functions import pairwise
from statewise.functions import vectors as v
from statewise.operators import clustering, counting, neighbors, tica
from statewise.plans.registry import query, table
from statewise.sources import catalog as cat

#: SQL of the embeddings as (vec_id, k, x), and of the pairs (vector, the next one).
ROWS = "WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)"
PAIRS = ROWS + ", p AS (SELECT a.vec_id AS a, a.k AS k, a.x AS x, b.x AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.k = b.k)"


def embedded(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))


def next_pairs(spark, folder):
    e = embedded(spark, folder).select("id", "features")
    return e.join(e.select((F.col("id") - 1).alias("id"), F.col("features").alias("other")), "id")


NUMERIC_SQL = {
    "euclidean": "sqrt(sum((x - y) * (x - y)))",
    "sqeuclidean": "sum((x - y) * (x - y))",
    "cityblock": "sum(abs(x - y))",
    "chebyshev": "max(abs(x - y))",
    "minkowski": "pow(sum(pow(abs(x - y), 3)), 1.0 / 3)",
    "cosine": "1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y))",
    "correlation": "1 - corr(x, y)",
    "braycurtis": "sum(abs(x - y)) / sum(abs(x + y))",
    "canberra": "sum(coalesce(abs(x - y) / nullif(abs(x) + abs(y), 0), 0))",
}
_tt, _tf, _ft, _ff = (f"sum(CASE WHEN {a} AND {b} THEN 1.0 ELSE 0.0 END)::DOUBLE" for a, b in (("x > 0", "y > 0"), ("x > 0", "y <= 0"), ("x <= 0", "y > 0"), ("x <= 0", "y <= 0")))
BOOLEAN_SQL = {
    "matching": f"({_tf} + {_ft}) / count(*)",
    "dice": f"({_tf} + {_ft}) / nullif(2 * {_tt} + {_tf} + {_ft}, 0)",
    "kulsinki": f"({_tf} + {_ft} - {_tt} + count(*)) / ({_tf} + {_ft} + count(*))",
    "rogerstanimoto": f"2 * ({_tf} + {_ft}) / ({_tt} + {_ff} + 2 * ({_tf} + {_ft}))",
    "russellrao": f"(count(*) - {_tt}) / count(*)",
    "sokalmichener": f"2 * ({_tf} + {_ft}) / ({_tt} + {_ff} + 2 * ({_tf} + {_ft}))",
    "sokalsneath": f"2 * ({_tf} + {_ft}) / nullif({_tt} + 2 * ({_tf} + {_ft}), 0)",
    "yule": f"coalesce(2 * {_tf} * {_ft} / nullif({_tt} * {_ff} + {_tf} * {_ft}, 0), 0)",
}
for _name, _sql in NUMERIC_SQL.items():
    query(f"metric_{_name}", f"{PAIRS} SELECT a AS id, round({_sql}, 6) AS dist FROM p GROUP BY a")(lambda s, d, n=_name: next_pairs(s, d).select("id", F.round(v.metric(n)(F.col("features"), F.col("other")), 6).alias("dist")))
for _name, _sql in BOOLEAN_SQL.items():
    query(f"metric_{_name}", f"{PAIRS} SELECT a AS id, round({_sql}, 6) AS dist FROM p GROUP BY a")(
        lambda s, d, n=_name: next_pairs(s, d).select("id", F.round(v.metric(n)(F.transform("features", lambda x: x > 0), F.transform("other", lambda x: x > 0)), 6).alias("dist"))
    )

SCALE = [1.0 + k % 5 for k in range(64)]
query("metric_seuclidean", PAIRS + " SELECT a AS id, round(sqrt(sum((x - y) * (x - y) / (1 + (k - 1) % 5))), 6) AS dist FROM p GROUP BY a")(
    lambda s, d: next_pairs(s, d).select("id", F.round(v.seuclidean(SCALE)(F.col("features"), F.col("other")), 6).alias("dist"))
)
INVERSE = [[1.0 if i == j else 0.5 if abs(i - j) == 1 else 0.0 for j in range(64)] for i in range(64)]
query("metric_sqmahalanobis", PAIRS + " SELECT l.a AS id, round(sum((l.x - l.y) * (r.x - r.y) * CASE WHEN l.k = r.k THEN 1 ELSE 0.5 END), 6) AS dist FROM p l JOIN p r ON l.a = r.a AND abs(l.k - r.k) <= 1 GROUP BY l.a")(
    lambda s, d: next_pairs(s, d).select("id", F.round(v.sqmahalanobis(INVERSE)(F.col("features"), F.col("other")), 6).alias("dist"))
)
query("metric_mahalanobis", PAIRS + " SELECT l.a AS id, round(sqrt(sum((l.x - l.y) * (r.x - r.y) * CASE WHEN l.k = r.k THEN 1 ELSE 0.5 END)), 6) AS dist FROM p l JOIN p r ON l.a = r.a AND abs(l.k - r.k) <= 1 GROUP BY l.a")(
    lambda s, d: next_pairs(s, d).select("id", F.round(v.mahalanobis(INVERSE)(F.col("features"), F.col("other")), 6).alias("dist"))
)


def both(s, d):
    parts = [(v.metric("euclidean"), 0.7), (v.metric("cityblock"), 0.1)]
    return next_pairs(s, d), parts, [(F.col("features"), F.col("other"))] * 2


@query("hybrid_sum", PAIRS + " SELECT a AS id, round(0.7 * sqrt(sum((x - y) * (x - y))) + 0.1 * sum(abs(x - y)), 6) AS dist FROM p GROUP BY a")
def hybrid_sum(s, d):
    rows, parts, cols = both(s, d)
    return rows.select("id", F.round(v.hybrid(parts)(cols), 6).alias("dist"))


@query("hybrid_pnorm", PAIRS + " SELECT a AS id, round(sqrt(pow(0.7 * sqrt(sum((x - y) * (x - y))), 2) + pow(0.1 * sum(abs(x - y)), 2)), 6) AS dist FROM p GROUP BY a")
def hybrid_pnorm(s, d):
    rows, parts, cols = both(s, d)
    return rows.select("id", F.round(v.hybrid(parts, 2.0)(cols), 6).alias("dist"))


@query("one_to_all", ROWS + " SELECT a.vec_id AS id, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS dist FROM e a JOIN e b ON b.vec_id = 0 AND a.k = b.k GROUP BY 1")
def one_to_all(s, d):
    e = embedded(s, d)
    one = F.broadcast(e.where("id = 0").select(F.col("features").alias("other")))
    return e.crossJoin(one).select("id", F.round(v.metric("euclidean")(F.col("features"), F.col("other")), 6).alias("dist"))


@query("pairwise_condensed", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def pairwise_condensed(s, d):
    e = embedded(s, d)
    return neighbors.all_pairs(e, "id", v.metric("euclidean"), blocks=max(8, -(-e.count() // 500))).select("a", "b", F.round("dist", 6).alias("dist"))


@query("pairwise_cityblock", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(z[1] - z[2]))), 6) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def pairwise_cityblock(s, d):
    e = embedded(s, d)
    return neighbors.all_pairs(e, "id", "cityblock", blocks=max(8, -(-e.count() // 500))).select("a", "b", F.round("dist", 6).alias("dist"))


ASSIGN = ROWS + ", g AS (SELECT a.vec_id AS id, b.vec_id AS gid, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM e a JOIN e b ON b.vec_id < 20 AND a.k = b.k GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, gid) AS r FROM g)"


def assigned(s, d):
    e = embedded(s, d)
    return neighbors.assign(e, e.where("id < 20").select(F.col("id").alias("gid"), "features"), ["id"])


query("assign_nearest", ASSIGN + " SELECT id, gid AS state, round(d, 6) AS dist FROM r WHERE r = 1")(lambda s, d: assigned(s, d).select("id", "state", F.round("dist", 6).alias("dist")))
query("cluster_radii", ASSIGN + " SELECT gid AS state, round(avg(d), 6) AS radius FROM r WHERE r = 1 GROUP BY 1")(lambda s, d: counting.cluster_radii(assigned(s, d)).select("state", F.round("radius", 6).alias("radius")))
query("trim_by_distance", ASSIGN + " SELECT id, CASE WHEN d <= 1 THEN gid END AS state, round(d, 6) AS dist FROM r WHERE r = 1")(
    lambda s, d: counting.trim_by_distance(assigned(s, d), 1.0).select("id", "state", F.round("dist", 6).alias("dist"))
)
query("p_norm", ASSIGN + " SELECT round(sqrt(avg(d * d)), 6) AS norm, round(max(d), 6) AS top FROM r WHERE r = 1")(
    lambda s, d: assigned(s, d).agg(F.round(neighbors.p_norm(F.col("dist"), 2), 6).alias("norm"), F.round(neighbors.p_norm(F.col("dist"), "max"), 6).alias("top"))
)
query("neighbours_within", ROWS + " SELECT b.vec_id AS gid, a.vec_id AS id FROM e a JOIN e b ON b.vec_id < 20 AND a.k = b.k GROUP BY 1, 2 HAVING sqrt(sum((a.x - b.x) * (a.x - b.x))) < 1")(
    lambda s, d: embedded(s, d).join(F.broadcast(embedded(s, d).where("id < 20").select(F.col("id").alias("gid"), F.col("features").alias("other"))), v.metric("euclidean")(F.col("features"), F.col("other")) < 1).select("gid", "id")
)

# The same under other metrics.
MIXED = "0.7 * list_distance(a.f, b.f) + 0.1 * list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))"
BY = "WITH e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings), g AS (SELECT a.id, b.id AS gid, {} AS d FROM e a JOIN e b ON b.id < 20), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), gid) AS r FROM g) SELECT id, gid AS state, round(d, 6) AS dist FROM r WHERE r = 1"


def assigned_by(metric):
    def run(s, d):
        e = embedded(s, d)
        return neighbors.assign(e, e.where("id < 20").select(F.col("id").alias("gid"), "features"), ["id"], metric=metric).select("id", "state", F.round("dist", 6).alias("dist"))

    return run


MIX = pairwise.hybrid([(pairwise.metric("euclidean"), slice(0, 64), 0.7), (pairwise.metric("cityblock"), slice(0, 64), 0.1)])
query("assign_hybrid", BY.format(MIXED))(assigned_by(MIX))
query("assign_cityblock", BY.format("list_sum(list_transform(list_zip(a.f, b.f), lambda z: abs(z[1] - z[2])))"))(assigned_by("cityblock"))
query("assign_cosine", BY.format("list_cosine_distance(a.f, b.f)"))(assigned_by("cosine"))

# Embeddings as trajectories: labels in order of the vector's id.
SEQ = "WITH v AS (SELECT label AS traj_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding FROM embeddings), e AS (SELECT traj_id, frame, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM v)"


def sequences(s, d):
    return counting.numbered(embedded(s, d), "label", ["id"]).select(F.col("label").alias("traj_id"), "frame", "features")


query("drift_tau", SEQ + ", p AS (SELECT a.traj_id, a.frame, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM e a JOIN e b ON a.traj_id = b.traj_id AND b.frame = a.frame + 3 AND a.k = b.k GROUP BY 1, 2) SELECT v.traj_id, v.frame, round(d, 6) AS drift FROM v LEFT JOIN p USING (traj_id, frame)")(
    lambda s, d: neighbors.drift(sequences(s, d), 3, v.metric("euclidean")).select("traj_id", "frame", F.round("drift", 6).alias("drift"))
)
query("square_drift", SEQ + " SELECT a.traj_id, a.frame, round(sum((a.x - b.x) * (a.x - b.x)), 6) AS drift FROM e a JOIN e b ON a.traj_id = b.traj_id AND b.frame = a.frame + 3 AND a.k = b.k GROUP BY 1, 2")(
    lambda s, d: neighbors.drift(sequences(s, d), 3, v.metric("euclidean")).where("drift is not null").select("traj_id", "frame", F.round(F.col("drift") * F.col("drift"), 6).alias("drift"))
)
query("epsilon_neighbourhood", SEQ + ", p AS (SELECT a.traj_id, a.frame, b.frame AS g, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM e a JOIN e b ON a.traj_id = b.traj_id AND abs(b.frame - a.frame) = 2 AND a.k = b.k GROUP BY 1, 2, 3) SELECT traj_id, frame, round(max(d), 6) AS epsilon FROM p GROUP BY 1, 2")(
    lambda s, d: neighbors.epsilon_neighbourhood(sequences(s, d), 2, v.metric("euclidean")).where("epsilon is not null").select("traj_id", "frame", F.round("epsilon", 6).alias("epsilon"))
)
query("hitting_time", SEQ + ", p AS (SELECT a.traj_id, a.frame, b.frame - a.frame AS h FROM e a JOIN e b ON a.traj_id = b.traj_id AND b.frame > a.frame AND a.k = b.k GROUP BY a.traj_id, a.frame, b.frame HAVING sqrt(sum((a.x - b.x) * (a.x - b.x))) > 1.3) SELECT v.traj_id, v.frame, min(h) AS hit FROM v LEFT JOIN p USING (traj_id, frame) GROUP BY 1, 2")(
    lambda s, d: neighbors.hitting_time(sequences(s, d), 1.3, v.metric("euclidean"))
)

TICA = SEQ + ", z AS (SELECT a.traj_id, a.frame, a.k, a.x, b.x AS y FROM e a JOIN e b ON a.traj_id = b.traj_id AND b.frame = a.frame + 1 AND a.k = b.k), n AS (SELECT count(*) / 64.0 AS n FROM z), u AS (SELECT k, (sum(x) + sum(y)) / (2 * (SELECT n FROM n)) AS m FROM z GROUP BY 1)"


def tica_moments(s, d):
    return tica.moments(sequences(s, d), 1, 64)


def entries(s, m):
    return s.createDataFrame([(i, j, round(float(m[i, j]), 6)) for i in range(len(m)) for j in range(len(m))], "i int, j int, v double")


query("tica_mean", TICA + " SELECT CAST(k - 1 AS INT) AS i, round(m, 6) AS v FROM u")(lambda s, d: s.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(tica.estimate(tica_moments(s, d))[0])], "i int, v double"))
query("tica_correlation", TICA + " SELECT CAST(a.k - 1 AS INT) AS i, CAST(b.k - 1 AS INT) AS j, round(sum(a.x * b.y + a.y * b.x) / (2 * (SELECT n FROM n)) - any_value(p.m) * any_value(q.m), 6) AS v FROM z a JOIN z b ON a.traj_id = b.traj_id AND a.frame = b.frame JOIN u p ON p.k = a.k JOIN u q ON q.k = b.k GROUP BY 1, 2")(
    lambda s, d: entries(s, tica.estimate(tica_moments(s, d))[1])
)
query("tica_covariance", TICA + " SELECT CAST(a.k - 1 AS INT) AS i, CAST(b.k - 1 AS INT) AS j, round(sum(a.x * b.x + a.y * b.y) / (2 * (SELECT n FROM n)) - any_value(p.m) * any_value(q.m), 6) AS v FROM z a JOIN z b ON a.traj_id = b.traj_id AND a.frame = b.frame JOIN u p ON p.k = a.k JOIN u q ON q.k = b.k GROUP BY 1, 2")(
    lambda s, d: entries(s, tica.estimate(tica_moments(s, d))[2])
)


@query("tica_solve")
def tica_solve(s, d):
    t = tica.solve(tica_moments(s, d), 1)
    return s.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(t.values)], "k int, v double")


@query("tica_project")
def tica_project(s, d):
    t = tica.solve(tica_moments(s, d), 1)
    return sequences(s, d).select("traj_id", "frame", F.transform(tica.project(F.col("features"), t, [0, 1]), lambda x: F.round(x, 4)).alias("projected"))


@query("pca_values")
def pca_values(s, d):
    t = tica.solve(tica.moments(sequences(s, d), 0, 64), 0)
    return s.createDataFrame([(k, round(float(x), 6)) for k, x in enumerate(t.values)], "k int, v double")


def _centres(k):
    """SQL of farthest-first traversal, one step after another."""
    sql = "WITH e AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings), c0 AS (SELECT id, f FROM e ORDER BY id LIMIT 1), t0 AS MATERIALIZED (SELECT e.id, e.f, 0 AS state, list_distance(e.f, c0.f) AS dist FROM e, c0)"
    for n in range(1, k):
        sql += f", c{n} AS MATERIALIZED (SELECT id, f FROM t{n - 1} ORDER BY dist DESC, id LIMIT 1), t{n} AS MATERIALIZED (SELECT t.id, t.f, CASE WHEN list_distance(t.f, c.f) < t.dist THEN {n} ELSE t.state END AS state, least(t.dist, list_distance(t.f, c.f)) AS dist FROM t{n - 1} t, c{n} c)"
    return sql + f" SELECT id, state, round(dist, 6) AS dist FROM t{k - 1}"


query("kcenters_k5", _centres(5))(lambda s, d: clustering.k_centers(embedded(s, d), 5)[0].select("id", "state", F.round("dist", 6).alias("dist")))
#: SQL of farthest-first traversal until no distance reaches a cutoff: centres and their distances to every vector, as lists that grow.
UNTIL = """WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings),
t(k, id, f, state, dist, far, fid) AS (SELECT 0, e.id, e.f, 0, list_distance(e.f, c.f), NULL::DOUBLE, NULL::BIGINT FROM e, (SELECT f FROM e ORDER BY id LIMIT 1) c UNION ALL
SELECT k + 1, id, f, CASE WHEN n < dist THEN k + 1 ELSE state END, least(dist, n), NULL, NULL FROM (SELECT t.*, list_distance(t.f, c.f) AS n FROM t, (SELECT f FROM t ORDER BY dist DESC, id LIMIT 1) c WHERE (SELECT max(dist) FROM t) >= {cutoff}))
SELECT id, state, round(dist, 6) AS dist FROM t WHERE k = (SELECT max(k) FROM t)"""
query("kcenters_cutoff", UNTIL.format(cutoff=1.42))(lambda s, d: clustering.k_centers(embedded(s, d), cutoff=1.42)[0].select("id", "state", F.round("dist", 6).alias("dist")))
query("kcenters_cityblock", _centres(4).replace("list_distance(e.f, c0.f)", "list_sum(list_transform(list_zip(e.f, c0.f), lambda z: abs(z[1] - z[2])))").replace("list_distance(t.f, c.f)", "list_sum(list_transform(list_zip(t.f, c.f), lambda z: abs(z[1] - z[2])))"))(
    lambda s, d: clustering.k_centers(embedded(s, d), 4, metric="cityblock")[0].select("id", "state", F.round("dist", 6).alias("dist"))
)
query("hybrid_kmedoids")(lambda s, d: clustering.hybrid_k_medoids(embedded(s, d), 8, rounds=3)[0].select("id", "state", F.round("dist", 6).alias("dist")))


@query("subsampled_clarans")
def subsampled_clarans(s, d):
    m = clustering.subsampled_clarans(embedded(s, d), 6)
    return s.createDataFrame([(k, x) for k, x in enumerate(m)], "state int, id long")


query("hierarchical")(lambda s, d: clustering.hierarchical(embedded(s, d), 10))


# Frames and catalogs. A frame delivered twice has the same content, so what is measured is taken first and then made distinct.
FINITE = "coalesce(list_bool_and(list_transform(flatten(xyz), lambda x: isfinite(x))), true)"
WHOLE = f"WITH f AS (SELECT frame_id, any_value(traj_id) AS traj_id, any_value(frame) AS frame, any_value(xyz) AS xyz FROM xyz_frames WHERE len(xyz) = 22 AND {FINITE} GROUP BY 1)"


def not_finite():
    return F.coalesce(F.exists(F.flatten("xyz"), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def complete(s, d):
    """Every frame that holds 22 atoms, however large its coordinates are; a frame delivered twice is there twice."""
    return table(s, d, "xyz_frames").where(F.size("xyz") == 22)


def finite(s, d):
    return complete(s, d).where(~not_finite())


def once(df):
    return df.dropDuplicates(["frame_id"])


def _d(i, j):
    return "sqrt(" + " + ".join(f"pow(xyz[{i + 1}][{k}] - xyz[{j + 1}][{k}], 2)" for k in (1, 2, 3)) + ")"


PAIR_LIST = [(0, 5), (3, 9), (7, 21)]


def atom_pair_distances(frames):
    return frames.withColumn("_p", v.atom_pairs(F.col("xyz"), PAIR_LIST)).select("frame_id", *[F.round(F.col("_p")[n], 6).alias(f"d{n}") for n in range(len(PAIR_LIST))])


def contact_bool(frames):
    return frames.withColumn("_c", v.boolean_contacts(v.atom_pairs(F.col("xyz"), PAIR_LIST), 0.5)).select("frame_id", *[F.col("_c")[n].alias(f"c{n}") for n in range(len(PAIR_LIST))])


def residue_contacts(frames):
    return frames.select("frame_id", F.round(v.contacts(F.col("xyz"), [[0, 1, 2], [10, 11]], [(0, 1)])[0], 6).alias("dist"))


def centred_frames(frames):
    return frames.select("frame_id", v.centre(F.col("xyz"))[0].alias("p")).select("frame_id", *[F.round(F.col("p")[k], 4).alias("xyz"[k]) for k in range(3)])


query("atom_pair_distances", WHOLE + " SELECT frame_id, " + ", ".join(f"round({_d(i, j)}, 6) AS d{n}" for n, (i, j) in enumerate(PAIR_LIST)) + " FROM f")(lambda s, d: once(atom_pair_distances(finite(s, d))))
query("contact_bool", WHOLE + " SELECT frame_id, " + ", ".join(f"{_d(i, j)} < 0.5 AS c{n}" for n, (i, j) in enumerate(PAIR_LIST)) + " FROM f")(lambda s, d: once(contact_bool(finite(s, d))))
query("residue_contacts", WHOLE + " SELECT frame_id, round(least(" + ", ".join(_d(i, j) for i in (0, 1, 2) for j in (10, 11)) + "), 6) AS dist FROM f")(lambda s, d: once(residue_contacts(finite(s, d))))
query("centred_frames", WHOLE + ", m AS (SELECT frame_id, xyz, list_sum(list_transform(xyz, lambda p: p[1])) / 22 AS a, list_sum(list_transform(xyz, lambda p: p[2])) / 22 AS b, list_sum(list_transform(xyz, lambda p: p[3])) / 22 AS c FROM f) SELECT frame_id, round(xyz[1][1] - a, 4) AS x, round(xyz[1][2] - b, 4) AS y, round(xyz[1][3] - c, 4) AS z FROM m")(
    lambda s, d: once(centred_frames(finite(s, d)))
)
TORSIONS = [(4, 6, 8, 14), (6, 8, 14, 16)]


def _torsion(n, i, j, k, m):
    """SQL of one torsion angle, step by step: differences of neighbours, normals, angle."""
    minus = lambda a, b: "[" + ", ".join(f"xyz[{a + 1}][{c}] - xyz[{b + 1}][{c}]" for c in (1, 2, 3)) + "]"
    return (f"SELECT frame_id, atan2(sqrt(list_dot_product(b2, b2)) * list_dot_product(b1, n2), list_dot_product(n1, n2)) AS t{n} FROM "
            f"(SELECT *, list_value(b1[2] * b2[3] - b1[3] * b2[2], b1[3] * b2[1] - b1[1] * b2[3], b1[1] * b2[2] - b1[2] * b2[1]) AS n1, "
            f"list_value(b2[2] * b3[3] - b2[3] * b3[2], b2[3] * b3[1] - b2[1] * b3[3], b2[1] * b3[2] - b2[2] * b3[1]) AS n2 FROM "
            f"(SELECT frame_id, {minus(j, i)} AS b1, {minus(k, j)} AS b2, {minus(m, k)} AS b3 FROM f))")


query("sincos_torsions", WHOLE + f", a AS ({_torsion(0, *TORSIONS[0])}), b AS ({_torsion(1, *TORSIONS[1])}) SELECT frame_id, [round(cos(t0), 6), round(cos(t1), 6), round(sin(t0), 6), round(sin(t1), 6)] AS features FROM a JOIN b USING (frame_id)")(
    lambda s, d: once(finite(s, d).select("frame_id", F.transform(v.torsions(F.col("xyz"), TORSIONS), lambda x: F.round(x, 6)).alias("features")))
)


def reference(s, d):
    rows = table(s, d, "atoms").orderBy("atom").select("x", "y", "z").collect()
    return np.array([list(r) for r in rows], float)


def rmsd_sql(pairs, tag=""):
    """SQL (from ``pairs``: keys ..., x, y as lists of 22 points) of the RMSD after superposition: the correlation of the centred atoms, its squared
    norm, determinant and cofactors, and Newton steps to the largest root of the quaternion matrix's polynomial. ``tag`` begins the names."""
    mean = lambda p, k: f"list_sum(list_transform({p}, lambda q: q[{k}])) / 22"
    centred = lambda p: f"list_transform({p}, lambda q: [" + ", ".join(f"q[{k}] - {p}{k}" for k in (1, 2, 3)) + "])"
    inner = ", ".join(f"list_sum(list_transform(range(1, 23), lambda n: u[n][{i}] * w[n][{j}])) AS m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    of = {(i, j): "(m{0}{2} * m{1}{3} - m{0}{3} * m{1}{2})".format(i % 3 + 1, (i + 1) % 3 + 1, j % 3 + 1, (j + 1) % 3 + 1) for i in (1, 2, 3) for j in (1, 2, 3)}
    norm = " + ".join(f"m{i}{j} * m{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    cofactors = " + ".join(f"{x} * {x}" for x in of.values())
    step = "CASE WHEN (4 * l * l - 4 * n) * l - 8 * t > 0 THEN l - (((l * l - 2 * n) * l - 8 * t) * l + n * n - 4 * q) / ((4 * l * l - 4 * n) * l - 8 * t) ELSE l END"
    sql = f"{tag}c0 AS (SELECT *, {', '.join(f'{mean(p, k)} AS {p}{k}' for p in 'xy' for k in (1, 2, 3))} FROM ({pairs})), {tag}c1 AS (SELECT *, {centred('x')} AS u, {centred('y')} AS w FROM {tag}c0)"
    sql += f", {tag}c2 AS (SELECT *, list_sum(list_transform(flatten(u), lambda z: z * z)) + list_sum(list_transform(flatten(w), lambda z: z * z)) AS g, {inner} FROM {tag}c1)"
    sql += f", {tag}c3 AS (SELECT *, {norm} AS n, m11 * {of[1, 1]} + m12 * {of[1, 2]} + m13 * {of[1, 3]} AS t, {cofactors} AS q FROM {tag}c2), {tag}l0 AS (SELECT * EXCLUDE (x, y, u, w), least(g / 2, sqrt(3 * n)) AS l FROM {tag}c3)"
    for k in range(1, 41):
        sql += f", {tag}l{k} AS (SELECT * REPLACE ({step} AS l) FROM {tag}l{k - 1})"
    return sql + f", {tag}rmsd AS MATERIALIZED (SELECT *, sqrt(greatest(g - 2 * l, 0) / 22) AS dist FROM {tag}l40)"


ATOMS = ", ref AS (SELECT list([x, y, z] ORDER BY atom) AS y FROM atoms)"
OFF = WHOLE + ATOMS + ", " + rmsd_sql("SELECT frame_id, traj_id, xyz AS x, y FROM f, ref")
query("reference_rmsd", OFF + " SELECT frame_id, traj_id, round(dist, 5) AS dist FROM rmsd")(lambda s, d: once(neighbors.reference_rmsd(finite(s, d), reference(s, d), ["frame_id", "traj_id"]).withColumn("dist", F.round("dist", 5))))


@query("rmsd_explosions", OFF + f" SELECT traj_id, CASE WHEN isinf(max(dist)) THEN 'Explosion: Infinity' ELSE printf('Explosion: %.4f', max(dist)) END AS errors FROM (SELECT traj_id, dist FROM rmsd UNION ALL SELECT traj_id, 'inf'::DOUBLE FROM xyz_frames WHERE len(xyz) = 22 AND NOT {FINITE}) GROUP BY 1 HAVING max(dist) > 0.5")
def rmsd_explosions(s, d):
    """A frame with a coordinate that is not finite is infinitely far off."""
    far = complete(s, d).where(not_finite()).select("frame_id", "traj_id", F.lit(float("inf")).alias("dist"))
    return cat.exploded(neighbors.reference_rmsd(finite(s, d), reference(s, d), ["frame_id", "traj_id"]).unionByName(far), 0.5)(None)


#: The first stored complete frame of each of the four first trajectories, as generators.
STARTS = ", o AS (SELECT traj_id, min(frame_id) AS frame_id FROM f GROUP BY 1 ORDER BY 1 LIMIT 4), g AS (SELECT CAST(row_number() OVER (ORDER BY o.traj_id) - 1 AS BIGINT) AS gid, f.xyz FROM o JOIN f ON f.frame_id = o.frame_id)"


def flattened(s, d):
    return finite(s, d).select("frame_id", "traj_id", F.flatten("xyz").alias("features"))


@query("assign_rmsd", WHOLE + STARTS + ", " + rmsd_sql("SELECT frame_id, gid, f.xyz AS x, g.xyz AS y FROM f, g") + ", best AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY round(dist, 6), gid) AS r FROM rmsd) SELECT frame_id, gid AS state, round(dist, 4) AS dist FROM best WHERE r = 1")
def assign_rmsd(s, d):
    """Every frame's nearest of four frames by RMSD."""
    x = flattened(s, d)
    first = x.groupBy("traj_id").agg(F.min_by("features", "frame_id").alias("features")).orderBy("traj_id").limit(4)
    starts = first.withColumn("gid", (F.row_number().over(Window.orderBy("traj_id")) - 1).cast("long"))
    return once(neighbors.assign(x, starts, ["frame_id"], metric="rmsd").select("frame_id", "state", F.round("dist", 4).alias("dist")))


def _rmsd_centres(k):
    """SQL of farthest-first traversal by RMSD over the frames below 100 nm."""
    sql = WHOLE + ", e AS MATERIALIZED (SELECT frame_id, xyz FROM f WHERE list_max(list_transform(flatten(xyz), lambda x: abs(x))) < 100), a0 AS (SELECT xyz FROM e ORDER BY frame_id LIMIT 1), "
    sql += rmsd_sql("SELECT e.frame_id, e.xyz AS x, a0.xyz AS y FROM e, a0", "z0_") + ", t0 AS MATERIALIZED (SELECT frame_id, 0 AS state, dist FROM z0_rmsd)"
    for n in range(1, k):
        sql += f", a{n} AS (SELECT xyz FROM e WHERE frame_id = (SELECT frame_id FROM t{n - 1} ORDER BY dist DESC, frame_id LIMIT 1)), " + rmsd_sql(f"SELECT e.frame_id, e.xyz AS x, a{n}.xyz AS y FROM e, a{n}", f"z{n}_")
        sql += f", t{n} AS MATERIALIZED (SELECT t.frame_id, CASE WHEN r.dist < t.dist THEN {n} ELSE t.state END AS state, least(t.dist, r.dist) AS dist FROM t{n - 1} t JOIN z{n}_rmsd r USING (frame_id))"
    return sql + f" SELECT frame_id, state, round(dist, 4) AS dist FROM t{k - 1}"


@query("kcenters_rmsd", _rmsd_centres(4))
def kcenters_rmsd(s, d):
    """Farthest-first centres by RMSD among the frames whose coordinates stay below 100 nm (the rest are explosions)."""
    x = flattened(s, d).where(F.array_max(F.transform("features", lambda z: F.abs(z))) < 100)
    return clustering.k_centers(once(x), 4, key="frame_id", metric="rmsd")[0].select("frame_id", "state", F.round("dist", 4).alias("dist"))


query("min_length_filter", "SELECT traj_id FROM (SELECT traj_id, count(*) AS n FROM xyz_frames WHERE traj_id IS NOT NULL GROUP BY 1) WHERE n < 100")(lambda s, d: cat.too_short(100)(table(s, d, "xyz_frames").where("traj_id is not null")).select("traj_id"))
query("valid_trajectories", "SELECT CAST(row_number() OVER (ORDER BY traj_id) - 1 AS BIGINT) AS index, traj_id, length FROM traj_catalog WHERE errors IS NULL")(lambda s, d: cat.Catalog(table(s, d, "traj_catalog")).lengths())
query("n_trajs", "SELECT count(*) AS n_trajs FROM traj_catalog WHERE errors IS NULL")(lambda s, d: cat.Catalog(table(s, d, "traj_catalog")).n_trajs())
query("trajectory_shapes", "SELECT traj_id, count(*) AS n_frames, max(len(xyz)) AS n_atoms FROM xyz_frames GROUP BY 1")(lambda s, d: cat.Catalog(table(s, d, "traj_catalog"), table(s, d, "xyz_frames")).shapes().withColumn("n_atoms", F.col("n_atoms").cast("long")))
query("catalog_problems", """WITH h AS (SELECT traj_id, count(*) AS n, max(len(xyz)) AS a FROM xyz_frames GROUP BY 1),
m AS (SELECT a FROM (SELECT a, count(*) AS c FROM h GROUP BY 1) ORDER BY c DESC, a NULLS FIRST LIMIT 1)
SELECT traj_id, problem FROM (SELECT t.traj_id, CASE WHEN h.n IS NULL THEN 'no frames' WHEN h.n IS DISTINCT FROM t.length THEN 'length' WHEN h.a <> m.a THEN 'atoms' END AS problem
FROM traj_catalog t CROSS JOIN m LEFT JOIN h ON h.traj_id = t.traj_id WHERE errors IS NULL) WHERE problem IS NOT NULL""")(lambda s, d: cat.Catalog(table(s, d, "traj_catalog"), table(s, d, "xyz_frames")).problems())
query("strided_scan", "SELECT frame_id, frame FROM xyz_frames WHERE traj_id = (SELECT traj_id FROM (SELECT traj_id, row_number() OVER (ORDER BY traj_id) AS r FROM traj_catalog WHERE errors IS NULL) WHERE r = 2) AND frame % 5 = 0")(
    lambda s, d: cat.Catalog(table(s, d, "traj_catalog"), table(s, d, "xyz_frames")).load_traj(1, stride=5).select("frame_id", "frame")
)
query("converted_files", "SELECT path, CAST(regexp_extract(path, 'RUN(\\d+)', 1) AS INT) AS run, CAST(regexp_extract(path, 'CLONE(\\d+)', 1) AS INT) AS clone, CAST(regexp_extract(regexp_extract(path, '[^/]*$'), '(\\d+)', 1) AS INT) AS gen FROM (SELECT unnest(converted_from) AS path FROM traj_catalog)")(
    lambda s, d: cat.listing(table(s, d, "traj_catalog").select(F.explode("converted_from").alias("path"))).select("path", "run", "clone", "gen")
)
query("atom_selection", "SELECT atom, name FROM atoms WHERE NOT regexp_matches(name, '^\\d*H')")(lambda s, d: cat.atom_selection(table(s, d, "atoms"), "heavy").select("atom", "name"))
query("natural_order", "SELECT path, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(path, '(\\d+)\\.', 1) AS INT), path) - 1 AS INT) AS ord FROM (SELECT DISTINCT 'trj' || traj_id || '.h5' AS path FROM traj_catalog)")(
    lambda s, d: table(s, d, "traj_catalog").select(F.concat(F.lit("trj"), "traj_id", F.lit(".h5")).alias("path")).distinct().select("path", (F.row_number().over(Window.orderBy(v.natural_key(F.col("path")))) - 1).alias("ord"))
)
query("network_edges", "WITH e AS (SELECT DISTINCT net_id, src, dst, w FROM edge_graph WHERE w IS NOT NULL), n AS (SELECT DISTINCT net_id, id FROM node_graph WHERE weight > 0.01) SELECT e.net_id, src, dst, round(w / max(w) OVER (PARTITION BY e.net_id), 9) AS w FROM e JOIN n a ON a.net_id = e.net_id AND a.id = src JOIN n b ON b.net_id = e.net_id AND b.id = dst")(
    lambda s, d: _network(s, d)
)


def _network(s, d):
    """Edges between nodes above a population, scaled by the largest of their network."""
    n = table(s, d, "node_graph").where("weight > 0.01").select("net_id", "id").distinct()
    e = table(s, d, "edge_graph").where("w is not null").distinct()
    kept = e.join(n.withColumnRenamed("id", "src"), ["net_id", "src"]).join(n.withColumnRenamed("id", "dst"), ["net_id", "dst"])
    return kept.select("net_id", "src", "dst", F.round(F.col("w") / F.max("w").over(Window.partitionBy("net_id")), 9).alias("w"))
