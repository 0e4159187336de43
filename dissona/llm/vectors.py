"""Integer vectors as the operators on embeddings use them: read, checked, scaled and packed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dissona.runtime import ship

#: Scaled components are cut at this, where a double still counts in ones.
LARGEST = 1 << 52


def scaled(column: pa.Array, scale: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists of doubles are there and hold finite numbers only, and floor(scale * c) of all as a matrix; shorter lists end in zeros."""
    n = len(column)
    parents = pc.list_parent_indices(column).to_numpy()
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    good = ~column.is_null().to_numpy(zero_copy_only=False)
    good[parents[~np.isfinite(values)]] = False
    first = np.searchsorted(parents, np.arange(n))
    place = np.arange(len(parents)) - first[parents]
    out = np.zeros((n, width), np.int64)
    use = good[parents]
    with np.errstate(over="ignore"):  # a product beyond all doubles is cut like any other
        out[parents[use], place[use]] = np.clip(np.floor(scale * values[use]), -LARGEST, LARGEST).astype(np.int64)
    return good, out


def packed(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(matrix)
    each = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * each).astype(np.int32)), pa.py_buffer(data.tobytes())])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """The matrix again."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([np.empty((0, width), kind), *(unpacked(c, kind, width) for c in column.chunks)])
    each = width * np.dtype(kind).itemsize
    data = column.buffers()[2]
    if not len(column) or not each:
        return np.empty((len(column), width), kind)
    at = int(np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0])
    return np.frombuffer(data, kind, len(column) * width, at).reshape(-1, width)


def largest_inner(width: int) -> int:
    """The size of components below which no inner product leaves a long."""
    return int(((1 << 62) / max(width, 1)) ** 0.5)


def integer_vectors(vectors: DataFrame, vector_column: str, scale: int, keep: list[Column], most: Callable[[int], int] = lambda width: LARGEST) -> tuple[DataFrame, str, int]:
    """keep and x (packed integers) of the rows whose vector is there, without null or non-finite components; the kind of integers; their number.

    One scan finds the longest vector and the largest component, so that x takes no more bytes than needed. The result isn't computed yet.
    Components are cut at most(width).
    """
    ship(vectors.sparkSession)
    rows = vectors.select(*keep, F.col(f"`{vector_column}`").cast("array<double>").alias("__v"))
    finite = F.forall("__v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = rows.filter(F.col("__v").isNotNull() & finite).agg(F.max(F.size("__v")), F.max(F.greatest(F.abs(F.array_max("__v")), F.abs(F.array_min("__v"))))).first()
    width, limit = int(top[0] or 0), min(LARGEST, most(int(top[0] or 0)))
    size = min(limit, scale * (top[1] or 0) + 1)
    kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<i8"
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = scaled(batch.column(batch.num_columns - 1), scale, width)
            rest = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], packed(np.clip(x[good], -limit, limit).astype(kind))], names)

    return rows.mapInArrow(run, schema), kind, width
