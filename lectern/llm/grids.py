"""Vectors on a grid of whole numbers, shared by the operators on embeddings.

A row is kept if its vector is not null and no component is null, NaN or infinite.
A shorter vector counts as one filled with zeros up to the greatest length of the
table, so every kept row has the same width. A component whose whole number
exceeds the limit would leave the exact range, and raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def on_grid(table: DataFrame, vector: str, others: list[str], scale: int, limit: int, multiple: int = 1) -> tuple[DataFrame, int]:
    """The other columns and ``x``, an array of ``floor(scale * component)``; and its width, a multiple of ``multiple``."""
    doubles = table.select(*others, F.col(vector).cast("array<double>").alias("x")).where(_finite("x"))
    least, most = doubles.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    width = -(-max(most or 0, 1) // multiple) * multiple
    too_large = F.concat(F.lit("a component beyond the exact range: "), F.array_max(F.transform("x", F.abs)).cast("string"))
    whole = F.transform("x", lambda c: F.floor(c * scale))
    checked = F.when(F.exists("x", lambda c: F.abs(c) * scale >= limit), F.raise_error(too_large)).otherwise(whole)
    if most is not None and least < width:
        checked = F.concat(checked, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    return doubles.withColumn("x", checked), width


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * step
    return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    """Binary values of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    low = int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, low).reshape(-1, width)
