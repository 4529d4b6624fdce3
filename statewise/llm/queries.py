"""Registered queries of the operators in this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from statewise.llm import clusters, leaks, neighbours, packing, sentences, stays


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda s, d: clusters.found(_table(s, d, "xyz_frames")),
    "p1_groups": lambda s, d: clusters.groups_of(_table(s, d, "xyz_frames")),
    "p4_found": lambda s, d: stays.found(_table(s, d, "assignments")),
    "p4_stays": lambda s, d: stays.stays(_table(s, d, "assignments")),
    "p4_runs": lambda s, d: stays.near_runs(_table(s, d, "assignments")),
    "p5_found": lambda s, d: neighbours.found(_table(s, d, "xyz_frames")),
    "p5_nearest": lambda s, d: neighbours.nearest_frames(_table(s, d, "xyz_frames")),
    "p6_packed": lambda s, d: packing.packed(_table(s, d, "documents")),
    "p7_found": lambda s, d: leaks.leaks(_table(s, d, "documents"), _table(s, d, "eval_items")),
    "p7_report": lambda s, d: leaks.leaks(_table(s, d, "documents"), _table(s, d, "eval_items"), report=True),
    "p8_found": lambda s, d: sentences.found(_table(s, d, "documents")),
    "p8_sentences": lambda s, d: sentences.sentence_texts(_table(s, d, "documents")),
}

SQL: dict[str, str] = {
    "p4_found": stays.SQL_STAYS + "SELECT traj_id, state, first_frame, last_frame FROM stays WHERE n_frames >= 6",
    "p4_stays": stays.SQL_STAYS + "SELECT traj_id, CAST(state AS BIGINT) AS state, first_frame, last_frame, n_frames, last_frame - first_frame + 1 AS duration FROM stays",
}
