"""Structured Streaming forms: assignment of frames, lag pairs with state, windowed event counts, incremental ingest."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewise.session import shared_dir

PAIRS = "traj_id long, frame long, i long, j long"
STATE = "frames array<long>, states array<long>"


def files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A parquet folder or file as a stream, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def lag_pairs(states: DataFrame, lag: int) -> DataFrame:
    """Stream of ``traj_id, frame, i, j`` (state at frame - lag and at frame) from a stream of ``traj_id, frame, state``.

    The last ``lag`` frames of each trajectory are kept as state between batches. Frames of a trajectory must arrive in order from batch to
    batch (any order within one); a frame not after the last one seen is a late duplicate and dropped. Null states make no pair.
    """

    def step(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        frames, labels = ([], []) if not state.exists else state.get
        frames = np.array(frames, np.int64)
        labels = np.array([np.nan if x is None else x for x in labels], float)
        for chunk in chunks:  # a batch of a trajectory may come in several pieces, in any order within it
            some = chunk.dropna(subset=["frame"])
            fresh.append((some["frame"].to_numpy(np.int64), some["state"].to_numpy(float, na_value=np.nan)))
        new, at = np.unique(np.concatenate([f for f, _ in fresh]), return_index=True)
        value = np.concatenate([x for _, x in fresh])[at]
        if len(frames):
            later = new > frames[-1]
            new, value = new[later], value[later]
        known, of = np.concatenate([frames, new]), np.concatenate([labels, value])
        place = np.searchsorted(known, new - lag)
        ok = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == new - lag) if len(known) else np.zeros(0, bool)
        ok[ok] = ~np.isnan(of[place[ok]]) & ~np.isnan(value[ok])
        if len(known):
            kept = known > known[-1] - lag
            state.update((known[kept].tolist(), [None if np.isnan(x) else int(x) for x in of[kept]]))
        yield pd.DataFrame({"traj_id": np.full(int(ok.sum()), key[0]), "frame": new[ok], "i": of[place[ok]].astype(np.int64), "j": value[ok].astype(np.int64)})

    return states.where("traj_id is not null").groupBy("traj_id").applyInPandasWithState(step, PAIRS, STATE, "append", "NoTimeout")


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per key and tumbling window of event time; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream that reads what is there now into a table in the shared folder, exactly once, and read it."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
    else:
        def keep(batch: DataFrame, n: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def ingest(frames: DataFrame, catalog_path: str, frames_path: str, checkpoint: str):
    """Continuous ingest: each batch of new frames is appended under its batch number, so a repeated batch replaces itself."""

    def append(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{frames_path}/batch={n}")
        batch.groupBy("traj_id").agg(F.count(F.lit(1)).cast("int").alias("length")).write.mode("overwrite").parquet(f"{catalog_path}/batch={n}")

    return frames.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
