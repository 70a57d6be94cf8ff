"""Vectors of scaled integers and their exact products."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fuelspark.llm.rows import quoted

SCALE = 256
# Scaled components stay below this, so that a sum of squares of a thousand differences fits a long.
LARGEST = 1 << 26
# Products stay exact in double precision up to here; beyond it they are computed in 64-bit integers.
EXACT = 1 << 52


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """Id and integer vector of the rows without null, non-finite or too large components."""
    rows = df.select(F.col(quoted(id_col)).cast("bigint").alias("id"), F.col(quoted(vector_col)).cast("array<double>").alias("x"))
    usable = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (c * scale < LARGEST) & (c * scale > -LARGEST))
    # a failing cast would be an error where the optimizer evaluates it before the filter
    return rows.filter(F.col("x").isNotNull() & usable).select("id", F.transform("x", lambda c: F.floor(c * scale).try_cast("int")).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, rows: int, dtype=np.int64) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(rows, -1)


def products(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of the first with all rows of the second."""
    if not len(vectors) or not len(others):
        return np.zeros((len(vectors), len(others)), np.int64)
    bound = int(np.abs(vectors).max(initial=0)) * int(np.abs(others).max(initial=0)) * vectors.shape[1]
    if bound <= EXACT:
        return (vectors.astype(np.float64) @ others.T.astype(np.float64)).astype(np.int64)
    return vectors @ others.T
