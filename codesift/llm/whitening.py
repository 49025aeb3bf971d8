"""Embedding whitening: covariances by polarisation of exact sums of squares, eigenvectors, whitened components.

Entries become whole numbers first, so every sum is exact, in any order and at any size. Cov(i, j) is half of
Var(i + j) - Var(i) - Var(j): only squares of single and of summed centred values are ever added up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.llm import rows

#: Entries are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: |SCALE * c| is held to this, so that sums of squares of any number of rows fit in decimals of 38 digits.
LARGEST = 1 << 40
#: Components with less than this share of the variance are rounding and have no scale to be whitened by.
LEAST_SHARE = 1e-12
#: Rows whose numbers are held at once.
STEP_ROWS = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has no null and no entry that is not finite."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~wrong, F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Whole numbers of the vectors, one row each; shorter ones are filled up with entries of 0."""
    flat = column.values if isinstance(column, pa.ListArray) else column.flatten()
    ends = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    numbers = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    out = np.zeros((len(size), width))
    if (size == width).all():
        out = numbers.reshape(len(size), width)
    else:
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(numbers)) - np.repeat(np.cumsum(size) - size, size)] = numbers
    return np.clip(np.floor(SCALE * out), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _exact(values: np.ndarray, rows_added: int = 1) -> np.ndarray:
    """values as they are if sums of that many squares fit in 64 bits, else as Python's numbers without bounds."""
    most = int(np.abs(values).max(initial=0))
    return values if most * most * rows_added < 1 << 63 else values.astype(object)


@dataclass(frozen=True)
class Sums:
    """n vectors and the sums of their whole numbers, dimension by dimension."""

    n: int
    sums: tuple[int, ...]

    @property
    def centres(self) -> list[int]:
        """The whole numbers below the means."""
        return [s // self.n for s in self.sums]

    @property
    def rests(self) -> list[int]:
        """n times what the centres are below the means."""
        return [s - self.n * c for s, c in zip(self.sums, self.centres, strict=True)]


def _total(parts: DataFrame, *keys: str) -> list:
    """Exact sums of parts (keys, value decimal(38,0)); parts hold one row a key and task."""
    return parts.groupBy(*keys).agg(F.sum("value").alias("value")).collect()


def sums(vectors: DataFrame, vector: str) -> Sums:
    """Count and sums over usable vectors; what comes to the driver is one number a dimension."""
    small = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    width = small.agg(F.max(F.size("v"))).first()[0] or 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in rows.pieces(batches, STEP_ROWS):
            x = _matrix(batch.column("v"), width)
            n, total = n + len(x), total + x.sum(axis=0).astype(object)
        yield _decimals([range(-1, width)], [n, *total], ["i"])

    found = {r["i"]: int(r["value"]) for r in _total(rows.map_arrow(small, add, "i int, value decimal(38,0)"), "i")}
    return Sums(found.get(-1, 0), tuple(found.get(i, 0) for i in range(width)))


def _decimals(keys: list, values: list[int], names: list[str]) -> pa.RecordBatch:
    from decimal import Decimal

    return pa.RecordBatch.from_arrays(
        [*[pa.array(k, pa.int32()) for k in keys], pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))],
        names=[*names, "value"])


def covariance(vectors: DataFrame, vector: str, fit: Sums) -> np.ndarray:
    """Covariances (divisor n) of usable vectors, each the nearest double of the exact value.

    Tasks add up the squares of centred values d and of all sums d_i + d_j, centred at whole numbers; n * n * Var is then
    n * sum of squares - rest * rest, exactly. Width * (width + 1) / 2 numbers come to the driver.
    """
    width, centres = len(fit.sums), fit.centres
    first, second = np.triu_indices(width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in rows.pieces(batches, STEP_ROWS):
            x = _matrix(batch.column("v"), width)
            d = _exact(x - np.array(centres, np.int64), 4 * len(x))
            part = np.zeros((width, width), object)
            for i in range(width):
                pair = d[:, i:i + 1] + d[:, i:]
                pair[:, 0] = d[:, i]  # a dimension by itself, not with itself
                part[i, i:] = (pair * pair).sum(axis=0)
            total = total + part
        yield _decimals([first, second], list(total[first, second]), ["i", "j"])

    small = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    squares = {(r["i"], r["j"]): int(r["value"]) for r in _total(
        rows.map_arrow(small, add, "i int, j int, value decimal(38,0)"), "i", "j")}
    n, rest = fit.n, fit.rests
    own = [n * squares[i, i] - rest[i] ** 2 for i in range(width)]
    out = np.zeros((width, width))
    for i in range(width):
        out[i, i] = own[i] / n ** 2
        for j in range(i + 1, width):
            both = n * squares[i, j] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n ** 2)
    return out


@dataclass(frozen=True)
class Model:
    """vectors: unit eigenvectors as columns, by falling eigenvalue; explained: shares of the trace."""

    fit: Sums
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n: the whole part is taken off exactly, what is left is below one."""
        return (x - np.array(self.fit.centres, np.int64)) - np.array([r / self.fit.n for r in self.fit.rests])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S) ** 2; null where that is no 64-bit number."""
        n = self.fit.n
        d = x - np.array(self.fit.centres, np.int64)
        most = n * (int(np.abs(d).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            y = n * d - np.array(self.fit.rests, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * d.astype(object) - np.array(self.fit.rests, object)
        return [v if v < 1 << 63 else None for v in map(int, (y * y).sum(axis=1))]


def fitted(vectors: DataFrame, vector: str = "embedding", components: int = 32) -> Model:
    """The model of usable vectors: at most components, fewer where the vectors span fewer dimensions."""
    fit = sums(vectors, vector)
    width = len(fit.sums)
    v = covariance(vectors, vector, fit) if fit.n and width else np.zeros((width, width))
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    trace = math.fsum(np.diag(v))
    n = int((values[:components] > LEAST_SHARE * trace).sum()) if trace > 0 else 0
    return Model(fit, values[:n], basis[:, :n], values[:n] / trace if n else values[:0])


def identity_error(vectors: DataFrame, model: Model, vector: str = "embedding") -> float:
    """The largest absolute entry of the covariance of whitened vectors, as they come out, minus the identity."""
    width, k = len(model.fit.sums), len(model.values)
    if not k:
        return 0.0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, products = np.zeros(k), np.zeros((k, k))
        for batch in rows.pieces(batches, STEP_ROWS):
            z = model.whitened(_matrix(batch.column("v"), width))
            first, products = first + z.sum(axis=0), products + z.T @ z
        i, j = (x.ravel() for x in np.indices((k, k)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.full(k, -1), i], pa.int32()), pa.array(np.r_[np.arange(k), j], pa.int32()),
             pa.array(np.r_[first, products.ravel()])], names=["i", "j", "value"])

    small = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    found = _total(rows.map_arrow(small, add, "i int, j int, value double"), "i", "j")
    mean, out = np.zeros(k), np.zeros((k, k))
    for r in found:
        if r["i"] < 0:
            mean[r["j"]] = r["value"] / model.fit.n
        else:
            out[r["i"], r["j"]] = r["value"] / model.fit.n
    return float(np.abs(out - np.outer(mean, mean) - np.eye(k)).max())


def whitened(table: DataFrame, vector: str = "embedding", components: int = 32) -> DataFrame:
    """row (struct of all columns of table), n, deviation, whitened, explained (arrays of double), identity_error.

    Rows whose vector is null or holds an entry that is null or not finite are left out; all others, repeated ones too,
    are fitted and returned. Vectors shorter than the longest are filled up with zeros; entries beyond 2**34 are held to
    that. deviation is null where it exceeds 64 bits. Components without variance (equal vectors, fewer of them than
    dimensions) are left out, so the arrays may be shorter or empty; an empty table stays empty. Eigenvectors are those
    of one call, computed once on the driver from width * width numbers. Components of equal eigenvalues have no order.
    """
    good = table.where(usable(F.col(vector)))
    model = fitted(good, vector, components)
    error, width = identity_error(good, model, vector), len(model.fit.sums)
    explained = model.explained.tolist()
    schema = T.StructType([
        T.StructField("row", table.schema, False), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.pieces(batches, STEP_ROWS):
            x = _matrix(batch.column("v"), width)
            z = model.whitened(x)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(model.deviations(x), pa.int64()), lists], names=["row", "deviation", "whitened"])

    out = rows.map_arrow(
        good.select(F.struct("*").alias("row"), F.col(vector).cast("array<double>").alias("v")), apply, schema)
    return out.select(
        "row", F.lit(model.fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.lit(explained).cast("array<double>").alias("explained") if explained else
        F.array().cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))
