"""Per-key results where a few keys hold most rows: heavy keys found by a sketch, then treated apart from the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statewise.session import BROADCAST_ROWS, materialize

#: Share of the rows from which a key is heavy, and counters a partition's sketch keeps per possible heavy key.
SHARE, COUNTERS = 0.03, 8
#: Parts over which a heavy key's rows are dealt.
SALTS = 32


def valid(key: str) -> Column:
    return F.coalesce(F.col(key) >= 0, F.lit(False))


def _sketch(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, int] = {}
    total = lost = 0
    for batch in batches:
        keys, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
        total += int(counts.sum())
        for k, c in zip(keys.tolist(), counts.tolist(), strict=True):
            held[k] = held.get(k, 0) + c
        if len(held) > size:
            cut = sorted(held.values(), reverse=True)[size]
            lost += cut
            held = {k: c - cut for k, c in held.items() if c > cut}
    if total:
        keys = [None, *held]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([total, *held.values()], pa.int64()), pa.array([lost] + [0] * len(held), pa.int64())], ["key", "n", "lost"])


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """``key`` (long), ``n``: the keys that hold at least ``share`` of the rows with a valid key (not null, not negative), with exact counts.

    Every partition summarises its keys by frequent-item counters (Misra-Gries: the least counters are paid back when the summary is
    full); the summaries are added up, with each partition's loss as the slack. A partition's loss is at most its rows / (counters + 1),
    so the slack is below share / COUNTERS of all rows and at most 1.2 / share keys may reach the share. Those are then counted exactly
    with partial aggregation, so no key's rows meet in one task. Repeated rows count. An empty table,
    or one without valid keys, has no heavy keys.
    """
    rows = df.where(valid(key)).select(F.col(key).cast("long").alias("_k"))
    size = int(COUNTERS / share)
    sketch = materialize(rows.mapInArrow(lambda it: _sketch(it, size), "key long, n long, lost long"))
    bound = sketch.where("key is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("lost"), F.lit(0)).alias("lost")).first()
    if not bound["n"]:
        return rows.limit(0).select(F.col("_k").alias("key"), F.lit(0).cast("long").alias("n"))
    least = share * bound["n"]
    hopeful = [r[0] for r in sketch.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") + F.lit(bound["lost"]) >= least).select("key").collect()]
    exact = rows.where(F.col("_k").isin(hopeful)).groupBy(F.col("_k").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return exact.where(F.col("n") >= least)


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = SHARE, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``key``, where few keys hold most rows of ``left`` and ``right`` has few rows per key.

    Rows of ``left`` with a heavy key meet the ``right`` rows of the (at most 1 / share) heavy keys in a broadcast join, all other rows are
    shuffled; both are united. The broadcast is counted first: beyond ``session.BROADCAST_ROWS`` rows of ``right`` under heavy keys, heavy rows
    of ``left`` are dealt over SALTS parts, with which ``right``'s are repeated, and shuffled. ``how`` is inner or left. Null and negative keys are never heavy; null keys match nothing. Columns that
    both sides have besides the key must be renamed before.
    """
    hot = [r[0] for r in heavy_keys(left, key, share).select("key").collect()]
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = right.where(is_hot)
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        heavy = left.where(is_hot).join(F.broadcast(few), key, how)
    else:
        dealt = left.where(is_hot).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        heavy = dealt.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], how).drop("_salt")
    return heavy.unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def skew_aggregate(df: DataFrame, key: str, partial: dict[str, Column], final: Callable[[], list[Column]], share: float = SHARE) -> DataFrame:
    """Aggregates per key in two steps: heavy keys first by (key, salt), the salt dealt by row number so that exact copies spread too (``df``
    should be read from storage, whose rows keep their order when a task is run again), other keys in one step.

    ``partial`` names the first step's aggregates, ``final`` gives the second step's over those names. Also for aggregates that Spark does
    not combine before the shuffle (collections, exact distinct counts by set).
    """
    hot = [r[0] for r in heavy_keys(df, key, share).select("key").collect()]
    salt = F.when(F.coalesce(F.col(key).isin(hot), F.lit(False)), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
    first = df.groupBy(key, salt.alias("_salt")).agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(key).agg(*final())
