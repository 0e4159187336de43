"""Whitening of embeddings by merged moments (Chan, Golub and LeVeque, 1979).

Components become integers, floor(scale * c). The fit list holds each distinct integer vector once. Each of its partitions computes its
count, mean and centred scatter, batch by batch; two such triples merge by the pairwise formula

    n = n1 + n2,  mean = mean1 + (mean2 - mean1) * n2 / n,  scatter = scatter1 + scatter2 + outer(mean2 - mean1) * n1 * n2 / n

in a treeReduce, so the driver gets a few triples however many partitions there are. Nothing is multiplied before it is centred. The
sums are kept as integers beside, so the mean is exact to the last bit. eigh of the covariance (divisor n) runs on the driver; it is
as large as the square of a vector's length and doesn't grow with the rows. A second pass over the fit list merges the moments of the
whitened vectors in the same way and tells how far their covariance is from the identity.

Defined cases: a null vector, or one with a null or non-finite component, is left out; shorter vectors count as if they ended in
zeros, also empty ones; null and shared identifiers stay as they are, one result for each row; repeated rows count once in the fit and
are all whitened; components are cut at 2**52; an empty table gives an empty result. With fewer dimensions than components asked for
there are as many as dimensions. A component without variance (its eigenvalue is zero but for rounding) has a null `whitened` and takes no part in
`identity_error`; `explained` is null where no dimension varies; `deviation` is null where it doesn't fit a long. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissona.runtime import stored

from .vectors import integer_vectors, unpacked

SCALE, COMPONENTS, FAN_IN = 256, 4, 32
Moments = tuple[int, np.ndarray, np.ndarray, np.ndarray]  # count, exact sums, mean, centred scatter


def moments(x: np.ndarray) -> Moments:
    """Of some vectors, at least one."""
    sums = x.astype(object).sum(0) if x.dtype.kind == "i" and x.itemsize == 8 else x.sum(0, dtype=np.int64 if x.dtype.kind == "i" else np.float64).astype(object)
    mean = (sums / len(x)).astype(np.float64)
    centred = x - mean
    return len(x), sums, mean, centred.T @ centred


def merged(a: Moments, b: Moments) -> Moments:
    """Of both lists together."""
    n, step = a[0] + b[0], b[2] - a[2]
    return n, a[1] + b[1], a[2] + step * (b[0] / n), a[3] + b[3] + np.outer(step, step) * (a[0] * (b[0] / n))


def reduced(rows: DataFrame, function: Callable[[pa.RecordBatch], np.ndarray]) -> Moments | None:
    """The moments of the matrices that function makes of all batches; None of no rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if batch.num_rows:
                part = moments(function(batch))
                own = part if own is None else merged(own, part)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["m"])

    parts = rows.mapInArrow(partial, "m binary").rdd.map(lambda r: pickle.loads(r[0]))
    depth = max(2, math.ceil(math.log(max(2, parts.getNumPartitions()), FAN_IN)))
    pair = lambda a, b: b if a is None else a if b is None else merged(a, b)
    return parts.treeReduce(pair, depth) if parts.getNumPartitions() else None


@dataclass(frozen=True)
class Whitening:
    """What the fit list says: n, sums (integers), mean, components as columns by falling eigenvalue, eigenvalues, trace, the second pass's error."""

    scale: int
    kind: str
    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None

    @property
    def varies(self) -> np.ndarray:
        """Components whose eigenvalue isn't zero but for rounding."""
        return self.values > len(self.mean) * np.finfo(float).eps * max(self.values[:1], default=0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN for components without variance."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.varies, (x - self.mean) @ self.components / np.sqrt(np.where(self.varies, self.values, 1)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sums) ** 2, exactly."""
        top = max((self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)), 1)
        if top * top * max(1, len(self.sums)) < 1 << 63:
            d = self.n * x.astype(np.int64) - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def fit_whitening(rows: DataFrame, kind: str, width: int, components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """The model of integer vectors (x, packed); None of no rows. Distinct vectors are found by an aggregate, which combines before its shuffle."""
    with stored(rows.select("x").distinct()) as once:
        found = reduced(once, lambda batch: unpacked(batch.column(0), kind, width))
        if found is None:
            return None
        n, sums, _, scatter = found
        mean = (sums / n).astype(np.float64)
        values, vectors = np.linalg.eigh(scatter / n)
        order = np.argsort(-values, kind="stable")[:components]
        model = Whitening(scale, kind, n, [int(s) for s in sums], mean, vectors[:, order], np.maximum(values[order], 0), float(np.trace(scatter) / n), None)
        use = model.varies
        if not use.any():
            return model
        second = reduced(once, lambda batch: model.project(unpacked(batch.column(0), kind, width))[:, use])
        return Whitening(*(getattr(model, f) for f in ("scale", "kind", "n", "sums", "mean", "components", "values", "trace")), float(np.abs(second[3] / second[0] - np.eye(int(use.sum()))).max()))


def whiten(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component. See the module."""
    rows, kind, width = integer_vectors(vectors, vector_column, scale, [F.col(f"`{id_column}`").cast("long").alias("vec_id")])
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(rows, kind, width, components, scale)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.values)
    share = [v / model.trace if model.trace else None for v in model.values.tolist()]
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rows = unpacked(batch.column(1), kind, width), batch.num_rows
            white = model.project(x).ravel()
            each = pa.array(np.repeat(np.arange(rows), k))
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array([model.n] * (rows * k), pa.int64()), pa.array(model.deviations(x), pa.int64()).take(each)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(white, pa.float64(), mask=np.isnan(white)), pa.array(share * rows, pa.float64()), pa.array([model.error] * (rows * k), pa.float64())], names)

    return rows.mapInArrow(run, schema)
