"""Maximal runs of linked neighbours in ordered sequences, without putting a whole sequence into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: str, link: Callable[[Column, Column], Column], carry: list[str] | None = None, block: Column | None = None) -> DataFrame:
    """Runs of rows in which each row is linked to the one before it in ``order`` within ``keys``.

    ``link(previous, current)`` gets structs of ``order`` and the ``carry`` columns and returns a condition (null counts as false). ``block``
    is a monotone integer function of ``order``: a sequence is cut into its blocks, runs are found per (keys, block), and only the first and
    last run of each block take part in the merge across blocks, so a key that holds most rows is spread over many tasks.

    Result: ``keys``, ``first``, ``last`` (structs of ``order`` and ``carry``), ``n`` (rows). Rows with a null ``order`` are left out; null
    keys form a key of their own. Rows that tie in ``order`` are neighbours in an unspecified order: make ``order`` unique per key first.
    """
    point = F.struct(F.col(order).alias(order), *[F.col(c).alias(c) for c in carry or []])
    rows = df.where(F.col(order).isNotNull()).select(*keys, F.col(order).alias("_o"), point.alias("_p"), (block if block is not None else F.lit(0)).cast("long").alias("_b"))
    within = Window.partitionBy(*keys, "_b").orderBy("_o")
    started = ~F.coalesce(link(F.lag("_p").over(within), F.col("_p")), F.lit(False))
    rows = rows.withColumn("_new", started).withColumn("_run", F.sum(F.col("_new").cast("int")).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "_b", "_run").agg(F.min_by("_p", "_o").alias("first"), F.max_by("_p", "_o").alias("last"), F.count(F.lit(1)).alias("n"))
    edge = Window.partitionBy(*keys, "_b")
    runs = runs.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(edge)))
    inner = runs.where(~F.col("_edge")).select(*keys, "first", "last", "n")
    across = Window.partitionBy(*keys).orderBy("_b", "_run")
    outer = runs.where("_edge").withColumn("_new", ~F.coalesce(link(F.lag("last").over(across), F.col("first")) & (F.lag("_b").over(across) != F.col("_b")), F.lit(False)))
    outer = outer.withColumn("_g", F.sum(F.col("_new").cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    merged = outer.groupBy(*keys, "_g").agg(F.min_by("first", F.col(f"first.{order}")).alias("first"), F.max_by("last", F.col(f"last.{order}")).alias("last"), F.sum("n").alias("n"))
    return inner.unionByName(merged.drop("_g"))
