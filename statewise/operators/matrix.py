"""Between long tables (i, j, value) and the dense matrices of a model, which are small: states, not frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: States a model may have; more are refused before anything is collected.
MOST_STATES = 5000


def to_dense(entries: DataFrame, value: str, n: int | None = None) -> np.ndarray:
    """``i, j, value`` as an n x n array (n: one more than the largest index)."""
    from pyspark.sql import functions as F

    top = entries.agg(F.max(F.greatest("i", "j"))).first()[0]
    n = n or (0 if top is None else int(top) + 1)
    if n > MOST_STATES:
        raise ValueError(f"{n} states; a model has at most {MOST_STATES}")
    out = np.zeros((n, n))
    rows = entries.select("i", "j", value).toArrow()
    np.add.at(out, (rows["i"].to_numpy(), rows["j"].to_numpy()), rows[value].to_numpy())
    return out


def from_dense(spark: SparkSession, matrix: np.ndarray, value: str, keep_zero: bool = False, names: np.ndarray | None = None) -> DataFrame:
    """``i, j, value`` of the entries that are not 0 (or all); ``names`` gives the states of the rows, else they are numbered from 0."""
    i, j = np.nonzero(np.ones_like(matrix) if keep_zero else matrix)
    label = np.arange(len(matrix)) if names is None else np.asarray(names)
    columns = [pa.array(label[i], pa.int32()), pa.array(label[j], pa.int32()), pa.array(matrix[i, j], pa.float64())]
    return spark.createDataFrame(pa.table(columns, ["i", "j", value]))


def from_vector(spark: SparkSession, vector: np.ndarray, value: str = "v", names: np.ndarray | None = None) -> DataFrame:
    """``i, value`` for every state."""
    label = np.arange(len(vector)) if names is None else np.asarray(names)
    return spark.createDataFrame(pa.table([pa.array(label, pa.int32()), pa.array(np.asarray(vector, float), pa.float64())], ["i", value]))
