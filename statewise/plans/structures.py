"""Queries of streams and of structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewise.operators import counting, neighbors, structures
from statewise.plans.counting import COUNTS, EVENTS, HELD, event_states, held
from statewise.plans.geometry import ASSIGN, WHOLE, embedded, finite, once, reference
from statewise.plans.registry import query, table
from statewise.streaming import trajectories as st


@query("streaming_transition_counts", EVENTS + COUNTS.format(lag=1) + " SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, c FROM c")
def streaming_transition_counts(s, d):
    """The event sequences are written as a table, and read as a stream."""
    from statewise.session import materialize

    rows = materialize(event_states(s, d).select(F.col("traj_id").cast("long"), "frame", F.col("state").cast("long")).repartition("traj_id"))
    path = rows.inputFiles()[0].rsplit("/", 1)[0]
    return st.run_to_end(st.lag_pairs(st.files(s, path), 1)).groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))


@query("streaming_assign", ASSIGN + " SELECT id, gid AS state, round(d, 6) AS dist FROM r WHERE r = 1")
def streaming_assign(s, d):
    e = embedded(s, d)
    stream = st.files(s, f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    found = neighbors.assign(stream, e.where("id < 20").select(F.col("id").alias("gid"), "features"), ["id"])
    return st.run_to_end(found).select("id", "state", F.round("dist", 6).alias("dist"))


@query("streaming_event_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_event_windows(s, d):
    stream = st.files(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.run_to_end(st.windowed_counts(stream, "ts", "event_type"), "complete")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("aligned_positions")
def aligned_positions(s, d):
    a = structures.aligned(finite(s, d), reference(s, d), ["frame_id"])
    return once(a).select("frame_id", F.transform("features", lambda x: F.round(x, 4)).alias("features"))


@query("permuted_rmsd")
def permuted_rmsd(s, d):
    a = structures.permuted_rmsd(finite(s, d), reference(s, d), ["frame_id"], list(range(4, 16)), [[0, 1, 2, 3], [19, 20, 21]])
    return once(a).select("frame_id", F.round(F.col("features")[0], 6).alias("dist"))


POINTS = 96
_radius = "CASE " + " ".join(f"WHEN k = '{k}' THEN {r + structures.PROBE}" for k, r in structures.RADII.items()) + " END"


@query("surface_areas", WHOLE + f""", a AS (SELECT atom, {_radius} AS r FROM (SELECT atom, regexp_extract(name, '[A-Za-z]') AS k FROM atoms)),
p AS (SELECT k, acos(1 - 2 * (k + 0.5) / {POINTS}) AS phi, pi() * (1 + sqrt(5)) * (k + 0.5) AS th FROM range({POINTS}) t(k)),
u AS (SELECT k, cos(th) * sin(phi) AS ux, sin(th) * sin(phi) AS uy, cos(phi) AS uz FROM p),
x AS (SELECT frame_id, atom, r, xyz[atom + 1] AS c FROM f, a),
y AS (SELECT p.frame_id, p.atom, p.r, q.c[1] - p.c[1] AS dx, q.c[2] - p.c[2] AS dy, q.c[3] - p.c[3] AS dz, q.r AS o FROM x p JOIN x q ON p.frame_id = q.frame_id AND p.atom <> q.atom),
near AS (SELECT *, (dx * dx + dy * dy + dz * dz + r * r - o * o) / (2 * r) AS reach FROM y WHERE dx * dx + dy * dy + dz * dz <= (r + o) * (r + o)),
gone AS (SELECT DISTINCT frame_id, atom, k FROM near, u WHERE dx * ux + dy * uy + dz * uz > reach),
n AS (SELECT frame_id, atom, count(*) AS n FROM gone GROUP BY 1, 2)
SELECT x.frame_id, x.atom, round((1 - coalesce(n, 0) / {POINTS}.0) * 4 * pi() * r * r, 4) AS area FROM x LEFT JOIN n USING (frame_id, atom)""")
def surface_areas(s, d):
    names = [r[0] for r in table(s, d, "atoms").orderBy("atom").select("name").collect()]
    a = structures.surface_areas(finite(s, d), names, ["frame_id"])
    return once(a).select("frame_id", F.posexplode("area").alias("atom", "a")).select("frame_id", "atom", F.round("a", 4).alias("area"))


@query("network_graph", HELD + COUNTS.format(lag=1) + """,
y AS (SELECT i, j, sum(c) / 2 AS c FROM (SELECT i, j, c FROM c UNION ALL SELECT j, i, c FROM c) GROUP BY 1, 2),
n AS (SELECT * FROM (SELECT i, sum(c) / (SELECT sum(c) FROM y) AS v FROM y GROUP BY 1) WHERE v > 0.01),
k AS (SELECT i, j, p FROM (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM y) WHERE i <> j AND i IN (SELECT i FROM n) AND j IN (SELECT i FROM n)),
e AS (SELECT i, j, 2 * p / (SELECT max(p) FROM k) AS w FROM k)
SELECT 0 AS ord, 'digraph G {' AS line UNION ALL SELECT 3, '}' UNION ALL SELECT 1, printf('  %d [label="%d: %.2f"];', i, i, -ln(v)) FROM n UNION ALL SELECT 2, printf('  %d -> %d [penwidth=%.3f];', i, j, w) FROM e WHERE w > 0.1""")
def network_graph(s, d):
    counts = counting.transition_counts(held(s, d), [1]).select("i", "j", "c")
    y = counting.symmetrize(counts)
    nodes, edges = structures.network(counting.transition_matrix(y), counting.populations(y))
    return structures.dot_lines(nodes, edges)
