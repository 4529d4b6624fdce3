"""Queries of the two general problems on dirty data: a few keys with most rows, and implausible values."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewise.operators.anomalies import anomalies
from statewise.operators.skew import heavy_keys, skew_aggregate, skew_join, valid
from statewise.plans.registry import query, table


@query(
    "p2_found",
    """
WITH a AS (SELECT state AS k, count(*) AS n FROM assignments WHERE state >= 0 GROUP BY 1),
     b AS (SELECT id AS k, count(*) AS n FROM node_graph WHERE id >= 0 GROUP BY 1)
SELECT 'assignments' AS table_name, CAST(k AS BIGINT) AS hot_key FROM a WHERE n >= 0.03 * (SELECT sum(n) FROM a)
UNION ALL SELECT 'node_graph', CAST(k AS BIGINT) FROM b WHERE n >= 0.03 * (SELECT sum(n) FROM b)""",
)
def p2_found(spark, folder):
    states = heavy_keys(table(spark, folder, "assignments"), "state").select(F.lit("assignments").alias("table_name"), F.col("key").alias("hot_key"))
    nodes = heavy_keys(table(spark, folder, "node_graph"), "id").select(F.lit("node_graph").alias("table_name"), F.col("key").alias("hot_key"))
    return states.unionByName(nodes)


@query(
    "p2_state_results",
    """SELECT CAST(state AS INT) AS state, count(*) AS n_rows, min(frame) AS first_frame, max(frame) AS last_frame,
       CAST(sum(frame) AS BIGINT) AS frame_sum FROM assignments WHERE state >= 0 GROUP BY 1""",
)
def p2_state_results(spark, folder):
    rows = table(spark, folder, "assignments").where(valid("state"))
    first = {"n": F.count(F.lit(1)), "lo": F.min("frame"), "hi": F.max("frame"), "total": F.sum("frame")}
    return skew_aggregate(rows, "state", first, lambda: [F.sum("n").alias("n_rows"), F.min("lo").alias("first_frame"), F.max("hi").alias("last_frame"), F.sum("total").alias("frame_sum")])


@query(
    "p2_node_results",
    """WITH e AS (SELECT src AS id, count(*) AS n_edges FROM (SELECT DISTINCT net_id, src, dst, w FROM edge_graph) WHERE src >= 0 GROUP BY 1)
SELECT CAST(n.id AS INT) AS id, count(*) AS n_rows, count(n.hub) AS n_scored, CAST(max(coalesce(e.n_edges, 0)) AS BIGINT) AS n_edges
FROM node_graph n LEFT JOIN e ON n.id = e.id WHERE n.id >= 0 GROUP BY 1""",
)
def p2_node_results(spark, folder):
    nodes = table(spark, folder, "node_graph").where(valid("id")).select("net_id", "id", "label", "hub")
    out = table(spark, folder, "edge_graph").distinct().where("src >= 0").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    joined = skew_join(nodes, out, "id", how="left")
    return joined.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"), F.count("hub").alias("n_scored"), F.max(F.coalesce("n_edges", F.lit(0))).alias("n_edges"))


@query("p3_found")
def p3_found(spark, folder):
    return anomalies(table(spark, folder, "xyz_frames"), table(spark, folder, "traj_catalog"))
