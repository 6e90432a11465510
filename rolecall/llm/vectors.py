"""Vectors as exact integers: reading them from Arrow columns, packing them, and exact products."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integers beyond this, from components of 32,768 and more, are held at it: sums of squares stay in 64 bits.
LIMIT = 1 << 25
#: Whole numbers below this are exact as doubles.
EXACT = 1 << 53


def columns(id_column: str = "vec_id", vector: str = "embedding") -> list[Column]:
    return [F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")]


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows without a null or non-finite component; start and length of every row, and all components."""
    n = len(column)
    there = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy().astype(np.int64)
    flat = column.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)  # nulls come as NaN
    bad = np.zeros(len(values) + 1, np.int64)
    np.cumsum(~np.isfinite(values), out=bad[1:])
    rows = np.flatnonzero(there & (bad[ends[1:]] == bad[ends[:-1]]))
    return rows, ends[:-1], np.diff(ends), values


def integers(values: np.ndarray, starts: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the ``dim`` components from each start, as a matrix."""
    found = values[starts[:, None] + np.arange(dim)] if len(starts) else np.zeros((0, dim))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(found * scale), -LIMIT, LIMIT).astype(np.int64)


def blobs(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.shape[1] * matrix.itemsize
    ends = np.arange(len(matrix) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.large_binary(), len(matrix), [
        None, pa.py_buffer(ends), pa.py_buffer(matrix.tobytes())]).cast(pa.binary())


def unblob(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Rows of equal size back as a matrix."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return data.view(kind).reshape(len(column), width)


def kind_for(*tops: int) -> type:
    """The fastest type in which a whole number up to the product of ``tops`` is exact."""
    bound = 1
    for top in tops:
        bound *= max(int(top), 1)
    return np.float64 if bound < EXACT else np.int64


def top(matrix: np.ndarray) -> int:
    return int(np.abs(matrix).max()) if matrix.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    kind = kind_for(top(a), top(b), a.shape[1])
    return (a.astype(kind, copy=False) @ b.astype(kind, copy=False).T).astype(np.int64, copy=False)


def floored(totals: list[int], count: int) -> list[int]:
    return [t // count for t in totals]
