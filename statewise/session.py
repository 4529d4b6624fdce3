"""Session helpers: lineage cuts in the shared checkpoint folder and size-checked joins."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow (two or three longs) side that may be broadcast: about 24 MB in memory.
BROADCAST_ROWS = 500_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, else a temporary one that is set for local sessions."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    own = spark.conf.get("spark.statewise.dir", None)
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="statewise-")
        spark.conf.set("spark.statewise.dir", own)
    return own


def _drop(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)
        else:
            _drop(path, spark)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, executors may be lost, columns are pruned."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/statewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files behind a materialized table that no later plan reads."""
    for path in {os.path.dirname(p) for p in df.inputFiles()}:
        _drop(path, df.sparkSession)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already materialized, narrow) with a broadcast hint if it has at most ``rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
