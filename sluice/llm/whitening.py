"""Whitening of embeddings: a two-pass covariance over the distinct vectors, its eigenvectors, and the projection of every vector on them.

Each entry c becomes the integer x = floor(scale * c) + offset. The fit list holds each distinct x vector once. The first pass sums it in
integers, so the mean S / n is exact; the second subtracts the mean and sums outer products, a NumPy matrix product for each batch. Tasks hold one sum or
matrix each, and treeAggregate merges those in tasks, so that the driver gets a few. The driver takes the eigenvectors (LAPACK, symmetric) of one
matrix of dimensions x dimensions, and the projection is broadcast. A third pass measures how far the whitened fit list's covariance is from the identity.

The mean is kept as base + rest / n with integers base and rest (0 <= rest < n), so that x - base is exact and the only rounding is that of doubles
near 0, however large the offset or the sums are.

Cases: a row whose vector is null, or holds a null or an entry that is not finite, takes no part; a vector that is shorter than the longest (an empty one too) counts
as filled up with zeros; repeated vectors count once in the fit and are all projected; ties among eigenvalues leave the choice of their vectors to LAPACK; directions without variance (an eigenvalue within rounding of 0,
as compared to the largest) have no whitened value and are left out, so fewer components come back; an empty table gives no rows. An entry of 2 ** 53 or more once
scaled is an error. Extra columns stay; one with the name of the result is replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import drop, staged

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Levels in which treeAggregate merges the tasks' sums.
DEPTH = 2
#: Entries of vectors that one matrix product takes.
BLOCK = 1 << 21
_FIT = "struct<deviation decimal(38,0), whitened array<double>>"


def integers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset of each entry as array<long>; null for a vector that takes no part."""
    usable = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c: Column) -> Column:
        at = F.lit(float(scale)) * c.cast("double")
        return F.when(F.abs(at) < float(1 << 53), F.floor(at) + offset).otherwise(F.raise_error(F.lit("an entry is too large for exact integers")).cast("long"))

    return F.when(usable, F.transform(vector, whole))


def _matrix(vectors: pa.Array, width: int, fill: int) -> np.ndarray:
    """rows x width of an array of lists, shorter ones filled up."""
    flat, size = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(np.asarray(vectors.offsets))
    if (size == width).all():
        return flat.reshape(len(vectors), width)
    out = np.full((len(vectors), width), fill, np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of vectors of one length."""
    for batch in batches:
        vectors = batch.column(0)
        x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0), np.int64)
        rows = max(1, BLOCK // max(1, x.shape[1]))
        for k in range(0, len(x), rows):
            yield x[k : k + rows]


def _aggregate(vectors: DataFrame, partial: Callable[[Iterable[pa.RecordBatch]], Any], merge: Callable[[Any, Any], Any]) -> Any:
    """merge of what partial makes of each task's vectors; None without rows. A task hands on one value, and tasks merge them level by level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(partial(batches))]})

    both = lambda a, b: b if a is None else a if b is None else merge(a, b)
    parts = vectors.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r["part"]))
    return parts.treeAggregate(None, both, both, DEPTH)


def _sums(batches: Iterable[pa.RecordBatch]) -> tuple[int, np.ndarray] | None:
    """(n, sum by dimension in integers of any size)."""
    n, total = 0, None
    for x in _blocks(batches):
        own = (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        n, total = n + len(x), own if total is None else total + own
    return (n, total) if n else None


def _merge_sums(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


@dataclass(frozen=True)
class Whitening:
    n: int
    #: Sums by dimension; base and rest are their quotients and remainders by n.
    sums: tuple[int, ...]
    base: np.ndarray
    rest: tuple[int, ...]
    eigenvalues: np.ndarray
    #: dimensions x components, unit columns.
    vectors: np.ndarray
    trace: float
    identity_error: float = float("nan")
    #: What fills up shorter vectors.
    offset: int = OFFSET

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - S) ** 2 over the dimensions of each row: n ** 2 * sum d ** 2 - 2 * n * sum d * rest + sum rest ** 2, d = x - base."""
        d = x - self.base
        most = int(np.abs(d).max(initial=0)) + 1
        exact = np.int64 if d.shape[1] * most * max(most, self.n) < 1 << 62 else object
        d = d.astype(exact)
        squares, cross = (d * d).sum(axis=1).astype(object), (d * np.array(self.rest, exact)).sum(axis=1).astype(object)
        return (self.n * self.n * squares - 2 * self.n * cross + sum(r * r for r in self.rest)).tolist()

    def explained(self) -> list[float]:
        return (self.eigenvalues / self.trace).tolist()


def _outer(of: Callable[[np.ndarray], np.ndarray]) -> Callable[[Iterable[pa.RecordBatch]], tuple | None]:
    """(n, sums, sums of outer products) of what a function makes of the rows."""

    def partial(batches: Iterable[pa.RecordBatch]) -> tuple | None:
        n, total, outer = 0, 0.0, 0.0
        for x in _blocks(batches):
            y = of(x)
            n, total, outer = n + len(y), total + y.sum(axis=0), outer + y.T @ y
        return (n, total, outer) if n else None

    return partial


def _merge_outer(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def fit(vectors: DataFrame, components: int = COMPONENTS, offset: int = OFFSET) -> Whitening | None:
    """The whitening of the distinct vectors in the frame's one column, array<long>, shorter ones filled up with offset; None if there are none."""
    listed = staged(vectors.toDF("x").distinct(), "vectors")
    size = listed.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if size["most"] and size["least"] < size["most"]:
        raw, filler = listed, F.array_repeat(F.lit(offset).cast("long"), size["most"] - F.size("x"))
        listed = staged(raw.select(F.concat("x", filler).alias("x")).distinct(), "vectors")
        drop(raw)
    try:
        got = _aggregate(listed, _sums, _merge_sums) if size["most"] else None
        if got is None:
            return None
        n, sums = got[0], tuple(int(s) for s in got[1])
        base, rest = np.array([s // n for s in sums], np.int64), tuple(s % n for s in sums)
        none = np.zeros((len(sums), 0))
        model = Whitening(n, sums, base, rest, np.zeros(0), none, 0.0, offset=offset)
        _, _, outer = _aggregate(listed, _outer(model.centred), _merge_outer)
        covariance = outer / n
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1], axes[:, ::-1]
        kept = min(components, int((values > values[0] * len(sums) * np.finfo(float).eps).sum()) if values[0] > 0 else 0)
        axes = axes[:, :kept] * np.where(axes[np.abs(axes[:, :kept]).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
        model = Whitening(n, sums, base, rest, values[:kept], axes, float(np.trace(covariance)), offset=offset)
        if not kept:
            return model
        _, total, outer = _aggregate(listed, _outer(model.whitened), _merge_outer)
        mean = total / n
        error = float(np.abs(outer / n - np.outer(mean, mean) - np.eye(kept)).max())
        return Whitening(n, sums, base, rest, values[:kept], axes, model.trace, error, offset)
    finally:
        drop(listed)


def project(x: Column, model: Whitening, broadcast: Any) -> Column:
    """(deviation, whitened) of vectors of integers; null for null."""

    @F.arrow_udf(_FIT)
    def projected(vectors: pa.Array) -> pa.Array:
        own: Whitening = broadcast.value
        there = vectors.drop_null()
        m, far = _matrix(there, len(own.base), own.offset), []
        white = np.empty((len(m), len(own.eigenvalues)))
        rows = max(1, BLOCK // max(1, m.shape[1]))
        for k in range(0, len(m), rows):
            white[k : k + rows] = own.whitened(m[k : k + rows])
            far += own.deviations(m[k : k + rows])
        kind = pa.decimal128(38, 0)
        exact = pa.array(far, pa.int64()).cast(kind) if max(far, default=0) < 1 << 62 else pa.array([Decimal(f) for f in far], kind)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
        whole = pa.StructArray.from_arrays([exact, lists], ["deviation", "whitened"])
        if not vectors.null_count:
            return whole
        there = vectors.is_valid().to_numpy(zero_copy_only=False)
        return whole.take(pa.array(np.cumsum(there) - 1, pa.int64(), mask=~there))

    return projected(x)


def whiten(embeddings: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, out_col: str = "whitening") -> tuple[DataFrame, Whitening | None]:
    """(the rows that take part, with deviation and whitened values in the struct out_col; the model that they were projected by).

    deviation is decimal(38,0), as n times a distance passes 64 bits on large tables; whitened holds a value for each component.
    """
    x = integers(F.col(vector_col), scale, offset)
    rest = embeddings.drop(out_col) if out_col != vector_col else embeddings
    model = fit(embeddings.select(x.alias("x")).where(F.col("x").isNotNull()), components, offset)
    if model is None:
        return rest.where(F.lit(False)).withColumn(out_col, F.lit(None).cast(_FIT)), None
    held = embeddings.sparkSession.sparkContext.broadcast(model)
    return rest.where(x.isNotNull()).withColumn(out_col, project(x, model, held)), model
