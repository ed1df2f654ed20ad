"""Usable vectors of a table, and what tasks need to read them as matrices."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(table: DataFrame, name: str, vector: str) -> tuple[DataFrame, int]:
    """(name, _v) of vectors that are not null and hold finite entries only, and their length.

    All vectors of a table should be equally long. Where they are not, the commonest length
    counts (of equally common ones the longest), and vectors of other lengths are left out.
    An empty table, or one without such vectors, has length 0.
    """
    found = table.select(F.col(f"`{name}`"), F.col(f"`{vector}`").alias("_v")).where(
        F.col("_v").isNotNull()
        & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sizes = found.groupBy(F.size("_v").alias("size")).agg(F.count(F.lit(1)).alias("n")).where("size > 0")
    width = sizes.agg(F.max_by("size", F.struct("n", "size")).alias("size")).first().size or 0
    return found.where(F.size("_v") == width), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, all of one length, as doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def bytes_matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of a binary column, all of one length, as numbers."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros((0, 0), dtype)
    at = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(dtype).reshape(len(column), -1)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    size = rows.itemsize * rows.shape[1]
    at = np.arange(len(rows) + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(rows.tobytes())]).cast(pa.binary())
