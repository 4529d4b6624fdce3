"""Queries over assignments: counts, matrices, relabelling, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewise.operators import counting as c
from statewise.plans.registry import query, table

#: SQL of the corrected assignments; the rest of a query follows it.
HELD = """
WITH held AS (SELECT traj_id, frame, max(loaded_at) AS at FROM assignments WHERE traj_id IS NOT NULL AND frame IS NOT NULL GROUP BY 1, 2),
s0 AS (SELECT a.traj_id, a.frame, max(a.state) AS state FROM assignments a JOIN held h ON a.traj_id = h.traj_id AND a.frame = h.frame AND a.loaded_at = h.at GROUP BY 1, 2),
s AS (SELECT traj_id, frame, CASE WHEN state >= 0 THEN state END AS state FROM s0)"""
#: SQL of the event sequences: users as trajectories, event types as states by alphabet.
EVENTS = """
WITH codes AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS state FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
s AS (SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, state FROM events LEFT JOIN codes USING (event_type) WHERE user_id IS NOT NULL)"""
COUNTS = ", c AS (SELECT a.state AS i, b.state AS j, count(*) AS c FROM s a JOIN s b ON a.traj_id = b.traj_id AND b.frame = a.frame + {lag} WHERE a.state IS NOT NULL AND b.state IS NOT NULL GROUP BY 1, 2)"


def held(spark, folder):
    return c.latest(table(spark, folder, "assignments"))


def event_states(spark, folder):
    events = table(spark, folder, "events")
    from pyspark.sql import Window

    codes = events.where("event_type is not null").select("event_type").distinct().withColumn("_c", F.row_number().over(Window.orderBy("event_type")) - 1)
    rows = events.join(F.broadcast(codes), "event_type", "left")
    return c.as_sequence(rows, "user_id", ["ts", "event_id"], F.col("_c"))


def counts1(spark, folder, states=held):
    return c.transition_counts(states(spark, folder), [1]).select("i", "j", "c")


for _lag in (1, 2, 5, 10):
    query(f"transition_counts_lag{_lag}", HELD + COUNTS.format(lag=_lag) + " SELECT * FROM c")(lambda s, d, k=_lag: c.transition_counts(held(s, d), [k]).select("i", "j", "c"))

query("transition_counts_lag_scan", HELD + " SELECT CAST(l.lag AS INT) AS lag, a.state AS i, b.state AS j, count(*) AS c FROM s a CROSS JOIN (VALUES (1), (2), (4), (8), (16)) l(lag) JOIN s b ON a.traj_id = b.traj_id AND b.frame = a.frame + l.lag WHERE a.state IS NOT NULL AND b.state IS NOT NULL GROUP BY 1, 2, 3")(
    lambda s, d: c.transition_counts(held(s, d), [1, 2, 4, 8, 16])
)

query("transition_counts_nonsliding", HELD + ", f AS (SELECT traj_id, min(frame) AS f0 FROM s WHERE state IS NOT NULL GROUP BY 1) SELECT a.state AS i, b.state AS j, count(*) AS c FROM s a JOIN f USING (traj_id) JOIN s b ON a.traj_id = b.traj_id AND b.frame = a.frame + 3 WHERE a.state IS NOT NULL AND b.state IS NOT NULL AND (a.frame - f0) % 3 = 0 GROUP BY 1, 2")(
    lambda s, d: c.transition_counts(held(s, d), [3], sliding=False).select("i", "j", "c")
)

query("event_transition_counts", EVENTS + COUNTS.format(lag=1) + " SELECT * FROM c")(lambda s, d: counts1(s, d, event_states))

query("transition_matrix", HELD + COUNTS.format(lag=1) + " SELECT i, j, round(c / sum(c) OVER (PARTITION BY i), 9) AS p FROM c")(
    lambda s, d: c.transition_matrix(counts1(s, d)).select("i", "j", F.round("p", 9).alias("p"))
)

query("symmetrized_counts", HELD + COUNTS.format(lag=1) + " SELECT i, j, sum(c) / 2 AS c FROM (SELECT i, j, c FROM c UNION ALL SELECT j, i, c FROM c) GROUP BY 1, 2")(
    lambda s, d: c.symmetrize(counts1(s, d))
)

query("populations_transpose", HELD + COUNTS.format(lag=1) + ", y AS (SELECT i, j, sum(c) / 2 AS c FROM (SELECT i, j, c FROM c UNION ALL SELECT j, i, c FROM c) GROUP BY 1, 2) SELECT i, round(sum(c) / (SELECT sum(c) FROM y), 9) AS v FROM y GROUP BY 1")(
    lambda s, d: c.populations(c.symmetrize(counts1(s, d))).select("i", F.round("v", 9).alias("v"))
)

RATES = ", w AS (SELECT state AS i, count(*) AS d FROM s WHERE state IS NOT NULL GROUP BY 1)"
query("rate_matrix", HELD + COUNTS.format(lag=1) + RATES + " SELECT i, j, round(c / d, 6) AS k FROM c JOIN w USING (i) WHERE i <> j UNION ALL SELECT i, i, round(-sum(c) - sum(CASE WHEN i = j THEN c / d ELSE 0 END), 6) FROM c JOIN w USING (i) GROUP BY 1, 2")(
    lambda s, d: c.rate_matrix(counts1(s, d), held(s, d)).select("i", "j", F.round("k", 6).alias("k"))
)

query("rate_from_transition", HELD + COUNTS.format(lag=1) + ", t AS (SELECT i, j, c / sum(c) OVER (PARTITION BY i) AS p FROM c) SELECT i, j, round(p, 9) AS k FROM t WHERE i <> j UNION ALL SELECT i, i, round(-sum(p), 9) FROM t WHERE i <> j GROUP BY 1, 2")(
    lambda s, d: c.rates_from_transitions(c.transition_matrix(counts1(s, d))).select("i", "j", F.round("k", 9).alias("k"))
)

query("log_likelihood", HELD + COUNTS.format(lag=1) + ", t AS (SELECT i, j, c, c / sum(c) OVER (PARTITION BY i) AS p FROM c) SELECT round(sum(c * ln(p)), 3) AS log_likelihood FROM t")(
    lambda s, d: c.log_likelihood(counts1(s, d), c.transition_matrix(counts1(s, d))).select(F.round("log_likelihood", 3).alias("log_likelihood"))
)

query("state_counts", HELD + " SELECT state, count(*) AS n FROM s WHERE state IS NOT NULL GROUP BY 1")(lambda s, d: c.state_counts(held(s, d)))

query("renumber_states", HELD + " SELECT state AS old, CAST(row_number() OVER (ORDER BY state) - 1 AS INT) AS new FROM (SELECT DISTINCT state FROM s WHERE state IS NOT NULL)")(
    lambda s, d: c.renumbering(held(s, d))
)

# Every third label is dropped, the others fold onto a tenth of the labels.
FOLD = "CASE WHEN old % 3 = 0 THEN -1 ELSE CAST(floor(old / 10) AS INT) END AS new"
query("apply_mapping", HELD + " SELECT traj_id, frame, CASE WHEN state % 3 <> 0 THEN CAST(floor(state / 10) AS INT) END AS state FROM s")(
    lambda s, d: c.apply_mapping(held(s, d), c.renumbering(held(s, d)).selectExpr("old", FOLD))
)

query("apply_mapping_to_vector", HELD + " SELECT CAST(floor(state / 10) AS INT) AS i, count(*) AS v FROM s WHERE state % 3 <> 0 GROUP BY state")(
    lambda s, d: c.map_vector(c.state_counts(held(s, d)).select(F.col("state").alias("i"), F.col("n").alias("v")), c.renumbering(held(s, d)).selectExpr("old", FOLD))
)

query("trim_states", HELD + COUNTS.format(lag=1) + ", n AS (SELECT q, CAST(row_number() OVER (ORDER BY q) - 1 AS INT) AS k FROM (SELECT i AS q FROM c UNION SELECT j FROM c) WHERE q >= 5) SELECT a.k AS i, b.k AS j, c FROM c JOIN n a ON i = a.q JOIN n b ON j = b.q")(
    lambda s, d: c.trim_states(counts1(s, d), s.range(5).select(F.col("id").cast("int").alias("state")))
)

query("inverse_assignments", HELD + " SELECT state, traj_id, frame FROM s WHERE state IS NOT NULL")(
    lambda s, d: c.invert(held(s, d)).select("state", F.explode("members").alias("m")).select("state", "m.traj_id", "m.frame")
)

query("deterministic_subsample", HELD + " SELECT traj_id, frame, state FROM s WHERE frame >= 3 AND (frame - 3) % 7 = 0")(lambda s, d: c.stride(held(s, d), 7, 3))

query("stochastic_subsample", None)(lambda s, d: c.stochastic_subsample(held(s, d), 10, seed=1))
query("sample_per_state", None)(lambda s, d: c.sample_per_state(held(s, d), 5, seed=1))
query("sample_per_state_replacement", None)(lambda s, d: c.sample_per_state(held(s, d), 5, seed=1, replacement=True))

LENGTHS = HELD + ", l AS (SELECT traj_id, max(frame) + 1 AS length FROM s GROUP BY 1), p AS (SELECT *, coalesce(sum(length) OVER (ORDER BY traj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0 FROM l)"


def lengths(s, d):
    return held(s, d).groupBy("traj_id").agg((F.max("frame") + 1).alias("length"))


query("virtual_trajectories", LENGTHS + " SELECT CAST(k.chunk AS BIGINT) AS chunk, traj_id, CAST(greatest(k.chunk * 1000 - off0, 0) AS BIGINT) AS start, CAST(least((k.chunk + 1) * 1000 - off0, length) AS BIGINT) AS stop FROM p, unnest(range(CAST(off0 // 1000 AS BIGINT), CAST((off0 + length - 1) // 1000 AS BIGINT) + 1)) AS k(chunk)")(
    lambda s, d: c.chunks(lengths(s, d), 1000)
)
query("chunk_hash", LENGTHS + ", q AS (SELECT k.chunk AS chunk, traj_id, CAST(greatest(k.chunk * 1000 - off0, 0) AS BIGINT) AS start, CAST(least((k.chunk + 1) * 1000 - off0, length) AS BIGINT) AS stop FROM p, unnest(range(CAST(off0 // 1000 AS BIGINT), CAST((off0 + length - 1) // 1000 AS BIGINT) + 1)) AS k(chunk)) SELECT CAST(chunk AS BIGINT) AS chunk, sha1(string_agg(traj_id || ':' || start || ':' || stop, ',' ORDER BY traj_id)) AS sha FROM q GROUP BY 1")(
    lambda s, d: c.chunk_hash(c.chunks(lengths(s, d), 1000))
)
