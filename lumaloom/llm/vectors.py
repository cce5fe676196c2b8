"""What the vector operators share: validity, blocks and streaming of a block's rows before its probes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *more: str) -> DataFrame:
    """(key, vec array<double>, more) of rows with a key whose vector is not null, not zero, and has only finite components."""
    v = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), *more)
    fine = F.expr("vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vec, x -> x != 0)")
    return v.filter(fine & F.col("vec_id").isNotNull())


def lengths(vectors: DataFrame) -> list[int]:
    """The different lengths of usable vectors (vec): only equal ones can be compared.  A model has one."""
    return sorted(r["d"] for r in vectors.select(F.size("vec").alias("d")).distinct().collect())


def matrix(column) -> np.ndarray:
    """Rows of a pandas column of arrays as one matrix."""
    return np.array([np.asarray(x, dtype=np.float64) for x in column])


def unit(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(top > 0, top, 1)  # no overflow in squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)
