"""Vector tables as packed rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def widest(vectors: DataFrame, vec_col: str) -> int:
    return vectors.agg(F.max(F.size(vec_col))).first()[0] or 0


def packed(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id long, v binary of ``dim`` doubles); shorter vectors are padded with zeros."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            out = np.zeros((len(lists), dim))
            out[np.arange(dim)[None, :] < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), rows_of(out)], ["id", "v"])

    return own.mapInArrow(run, "id long, v binary")


def rows_of(matrix: np.ndarray) -> pa.Array:
    """A binary array with one row of the matrix each."""
    matrix = np.ascontiguousarray(matrix)
    size = matrix.shape[1] * matrix.itemsize if matrix.ndim == 2 else matrix.itemsize
    offsets = (np.arange(len(matrix) + 1, dtype=np.int64) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(matrix.tobytes())])


def matrix_of(column: pa.Array | list, dim: int, kind=np.float64) -> np.ndarray:
    raw = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim)


__all__ = ["usable", "widest", "packed", "rows_of", "matrix_of"]
