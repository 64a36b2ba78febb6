"""Embedding whitening: mean and covariance by Welford's updates, components by a symmetric QR solver.

A vector's entries c become long integers x = floor(scale * c) + offset. The fit takes each distinct integer vector once.
Each partition streams its vectors through Welford's rank-one updates; partitions are merged by the parallel update
formula, in two shuffled levels, so the driver gets one state of d x d numbers. Vectors are taken relative to one of
them, which is exact, so that a mean far from zero costs no digits; sums are exact integers. Components are the unit
eigenvectors of the covariance (divisor n), by Householder tridiagonalisation and implicitly shifted QR.

Rows with a null vector, or with an entry that is null, not finite or beyond 2^56 in size, are dropped, and so are rows
whose length is not the one most rows have (the longer of two equally frequent ones; empty vectors never count).
Components without variance (up to rounding) do not exist, so a table of one distinct vector has none, and an empty table
gives an empty result. Ids may be null or repeated: each row has its result. Columns of rows with the names of results
are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.batches import bounded_batches
from sparkloom.session import discard, written

STATE = "n long, sums array<string>, mean binary, m2 binary"
_LIMIT = 2.0**56


# ---- streaming moments


@dataclass
class Moments:
    """Count, exact sums of integers, and mean and scatter matrix relative to the origin of the fit."""

    n: int
    sums: np.ndarray  # of Python integers
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def zero(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, object), np.zeros(d), np.zeros((d, d)))

    def add(self, row: np.ndarray) -> None:
        """Welford's update by one vector."""
        self.n += 1
        delta = row - self.mean
        self.mean += delta / self.n
        self.m2 += delta[:, None] * (delta * ((self.n - 1) / self.n))

    def merge(self, other: Moments) -> None:
        """The parallel update by another's moments."""
        n = self.n + other.n
        if other.n:
            delta = other.mean - self.mean
            self.m2 += other.m2 + delta[:, None] * (delta * (self.n / n * other.n))
            self.mean += delta * (other.n / n)
            self.sums = self.sums + other.sums
            self.n = n

    def packed(self) -> pa.RecordBatch:
        sums = pa.array([[str(s) for s in self.sums]], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), sums, pa.array([self.mean.tobytes()], pa.binary()), pa.array([self.m2.tobytes()], pa.binary())], ["n", "sums", "mean", "m2"])

    @classmethod
    def unpacked(cls, n: int, sums: list[str], mean: bytes, m2: bytes) -> Moments:
        d = len(sums)
        return cls(n, np.array([int(s) for s in sums], object), np.frombuffer(mean).copy(), np.frombuffer(m2).reshape(d, d).copy())


def _sums(block: np.ndarray) -> np.ndarray:
    """Exact sums of the columns of integers below 2^62, of at most 2^20 rows."""
    return (block >> 20).sum(axis=0).astype(object) * (1 << 20) + (block & 0xFFFFF).sum(axis=0).astype(object)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def moments(vectors: DataFrame, origin: np.ndarray, project=None, fan_in: int = 32) -> Moments:
    """Moments of the column of vectors (array of long), relative to origin; of project(vectors) where that is given."""
    d = len(origin)
    size = d if project is None else project(np.zeros((1, d), np.int64)).shape[1]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments.zero(size)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            if project is None:
                own.sums = own.sums + _sums(x)
            for row in (x - origin).astype(float) if project is None else project(x):
                own.add(row)
        if own.n:
            yield own.packed()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments.zero(size)
        for batch in batches:
            for row in batch.to_pylist():
                own.merge(Moments.unpacked(**row))
        if own.n:
            yield own.packed()

    fan_in = min(fan_in, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with bounded_batches(vectors.sparkSession):
        states = vectors.mapInArrow(stream, STATE).withColumn("_part", F.spark_partition_id() % fan_in).repartition(fan_in, "_part").drop("_part")
        row = states.mapInArrow(merge, STATE).repartition(1).mapInArrow(merge, STATE).first()
    return Moments.unpacked(**row.asDict()) if row else Moments.zero(size)


# ---- eigenvectors


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and orthogonal q of a = q t q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        rest = np.linalg.norm(v[1:])
        if rest == 0:
            continue
        alpha = -np.copysign(np.hypot(v[0], rest), v[0])
        v[0] -= alpha
        v /= np.linalg.norm(v)
        sub = a[k + 1 :, k + 1 :]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = alpha
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns, by QR steps with Wilkinson's
    shift on the tridiagonal form."""
    n = len(a)
    d, e, q = _tridiagonal((a + a.T) / 2)
    q = q.T.copy()  # eigenvectors as rows, so that a rotation mixes two contiguous ones
    eps, hi = np.finfo(float).eps, n - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if small[hi - 1]:
            hi -= 1
            continue
        cut = np.flatnonzero(small)
        lo = cut[-1] + 1 if len(cut) else 0
        half, off = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        x = d[lo] - (d[hi] - off * off / (half + np.copysign(np.hypot(half, off), half)))
        z = e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, b, t = d[k], e[k], d[k + 1]
            d[k] = c * c * p + 2 * c * s * b + s * s * t
            d[k + 1] = s * s * p - 2 * c * s * b + c * c * t
            e[k] = c * s * (t - p) + (c * c - s * s) * b
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


# ---- the operator


@dataclass
class Whitening:
    """A fitted model: n distinct vectors with sums, the variances and unit vectors of the components, trace of the
    covariance, and the largest absolute entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: of 64-bit integers where they fit, of Python's where not."""
        most = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * self.n + max(map(abs, self.sums), default=0)
        return x * self.n - np.array(self.sums, np.int64) if most < 1 << 62 else x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(float) / self.n) @ (self.components / np.sqrt(self.variances))


def integers(vector: Column, scale: int, offset: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset)


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite entries of the usual length."""
    good = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
    good = good.where(F.forall(F.col(vector), lambda c: c.isNotNull() & F.coalesce(F.abs(c.cast("double")) < _LIMIT, F.lit(False))))
    usual = good.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return good.where(F.size(vector) == (usual.d if usual else 0))


def fit(rows: DataFrame, vector: str, scale: int = 64, offset: int = 1_000_000, components: int = 16) -> Whitening:
    """The model of rows that usable() gave. The distinct vectors are written once and read for the moments and for
    the covariance of what the model makes of them."""
    distinct = written(rows.select(integers(F.col(vector), scale, offset).alias("x")).distinct(), "distinct-vectors")
    first = distinct.first()
    if first is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    m = moments(distinct, np.array(first.x, np.int64))
    values, vectors = eigen(m.m2 / m.n)
    trace = float(np.trace(m.m2) / m.n)
    k = min(components, int((values > len(values) * np.finfo(float).eps * max(values[0], 0)).sum()))
    model = Whitening(m.n, m.sums.tolist(), values[:k], vectors[:, :k], trace)
    if k:
        back = moments(distinct, np.array(first.x, np.int64), lambda x: model.whitened(model.deviations(x)))
        model.identity_error = float(np.abs(back.m2 / back.n - np.eye(k)).max())
    discard(distinct)
    return model


def whiten(rows: DataFrame, vector: str, model: Whitening, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """rows with whitened (an array of a number for each component) and deviation: the exact sum over the dimensions of
    (n * x - sum)^2, null where that is too large for a long."""
    d = len(model.sums)
    rows = rows.drop("whitened", "deviation")
    given = rows.columns

    def squared(r: np.ndarray) -> list[int | None]:
        if r.dtype != object and d * max(abs(int(r.max(initial=0))), abs(int(r.min(initial=0)))) ** 2 < 1 << 63:
            return (r * r).sum(axis=1).tolist()
        exact = (r.astype(object) ** 2).sum(axis=1)
        return [int(s) if s < 1 << 63 else None for s in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = model.deviations(_matrix(batch.column(len(given)), d))
            w = model.whitened(r)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1] or 1, dtype=np.int32) if w.size else np.zeros(len(r) + 1, np.int32)), pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], flat, pa.array(squared(r), pa.int64())], [*given, "whitened", "deviation"])

    schema = T.StructType([*rows.schema.fields, T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    return rows.withColumn("_x", integers(F.col(vector), scale, offset)).mapInArrow(run, schema)
