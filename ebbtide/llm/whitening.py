"""Whitening of embeddings by the leading eigenvectors of their covariance.

1. Components become whole numbers x = floor(scale * c) + shift. One pass adds up every
   dimension exactly.
2. A second pass centres the vectors, (n * x - S) / n with the numerator as a whole number,
   and each task adds up its products; the partial matrices are added row by row.
3. The driver has the matrix, whose size is the width squared, whatever the number of rows.
   Householder reflections make it tridiagonal, bisection on Sturm counts finds the largest
   eigenvalues, inverse iteration their vectors; vectors of eigenvalues that lie close
   together are made orthogonal to each other in every round.
4. The projection is broadcast, and a third pass projects the vectors. The covariance of what
   comes out is taken in the same way and compared with the identity.

Rows whose vector is null or has a null or non-finite component take no part. A shorter vector
counts as if zeros followed; an empty one is all zeros. Values beyond 2 ** 62 count as that. An
id may be null or repeated, every row comes out. Directions in which the rows do not differ
(an eigenvalue below ``RANK`` of the largest) have no component, so equal vectors, one vector
or none give no rows. ``deviation`` is null where it exceeds a long. The table is read three
times and must not change meanwhile. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ebbtide.llm.scratch import reachable, stored
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
LARGEST = 2.0**62
#: The covariance has the square of this many numbers at most, 128 MB.
MOST_DIMENSIONS = 4_096
#: Eigenvalues below this share of the largest are rounding, not variance.
RANK = 1e-11
#: Eigenvalues closer than this share of the largest are one cluster.
CLUSTER = 1e-3
ROUNDS = 4
#: Rows that a task centres and multiplies together.
ROWS = 4_096
LONG = (1 << 63) - 1


def whole_vectors(embeddings: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``(vec_id, x)`` of the rows that take part."""
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"),
                             embeddings["embedding"].cast("array<double>").alias("e"))
    sound = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(F.lit(scale) * c, F.lit(LARGEST)), F.lit(-LARGEST)))

    return rows.where(F.col("e").isNotNull() & sound).select(
        "vec_id", F.transform("e", lambda c: whole(c) + F.lit(shift)).alias("x"))


def _lists(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each list, and all values."""
    return np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


@dataclass(frozen=True)
class Sums:
    """Number of vectors and the exact sum of every dimension."""

    n: int
    sums: tuple[int, ...]
    shift: int

    def centred(self, vectors: pa.Array) -> np.ndarray:
        """n * x - S of every dimension, as whole numbers."""
        size, values = _lists(vectors)
        x = np.full((len(size), len(self.sums)), self.shift, np.int64)
        x[np.arange(len(self.sums)) < size[:, None]] = values
        largest = int(max(x.max(initial=0), -x.min(initial=0)))
        if 2 * self.n * largest + max(map(abs, self.sums), default=0) < LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


def summed(vectors: DataFrame, shift: int = SHIFT) -> Sums:
    """Sums of the dimensions, each taken as two halves of 32 bits so that none overflows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, seen = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            size, values = _lists(batch.column(0))
            n += len(size)
            wide = int(size.max(initial=0))
            if wide > len(seen):
                high, low, seen = (np.pad(v, (0, wide - len(v))) for v in (high, low, seen))
            at = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
            np.add.at(high, at, values >> 32)
            np.add.at(low, at, values & 0xFFFFFFFF)
            np.add.at(seen, at, 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(seen))), *[pa.array(np.concatenate(([a], v)))
             for a, v in ((0, high), (0, low), (n, seen))]],
            names=["dimension", "high", "low", "seen"])

    parts = vectors.select("x").mapInArrow(run, "dimension long, high long, low long, seen long")
    rows = parts.groupBy("dimension").agg(*[F.sum(c).alias(c) for c in ("high", "low", "seen")])
    # One row per dimension; a row more than the limit tells that there are too many.
    found = {r["dimension"]: r for r in rows.orderBy("dimension").limit(MOST_DIMENSIONS + 2).collect()}
    total = found.pop(-1, None)
    if len(found) > MOST_DIMENSIONS:
        raise ValueError(f"vectors with more than {MOST_DIMENSIONS} components")
    n = total["seen"] if total else 0
    return Sums(n, tuple((found[i]["high"] << 32) + found[i]["low"] + shift * (n - found[i]["seen"])
                         for i in range(len(found))), shift)


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of all matrices, given as rows ``(row, values)``."""
    rows = parts.groupBy("row").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("values"))))
                                    .alias("values")).collect()
    found = np.zeros((width, width))
    for r in rows:
        found[r["row"]] = r["values"]
    return found


def _matrix_rows(matrix: np.ndarray) -> pa.RecordBatch:
    n = len(matrix)
    ends = pa.array(np.arange(0, n * n + 1, max(n, 1), dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(n)), pa.ListArray.from_arrays(ends, pa.array(matrix.ravel()))],
        names=["row", "values"])


def covariance(vectors: DataFrame, known: Sums) -> np.ndarray:
    """Covariance of the vectors, divided by their number."""
    width = len(known.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for part in _parts(batch):
                y = known.centred(part.column(0)).astype(np.float64) / known.n
                total += y.T @ y
        yield _matrix_rows(total)

    return _added(vectors.select("x").mapInArrow(run, "row long, values array<double>"),
                  width) / max(known.n, 1)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and reflections that make a symmetric matrix tridiagonal.

    Each reflection I - 2 v v' clears a column below its first subdiagonal number, and changes
    what remains by a product of rank two.
    """
    a, n = matrix.astype(np.float64).copy(), len(matrix)
    off, reflections = np.zeros(max(n - 1, 0)), []
    for k in range(n - 1):
        v = a[k + 1:, k].copy()
        if not v[1:].any():
            off[k] = v[0]
            reflections.append(None)
            continue
        off[k] = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        moved = rest @ v
        w = 2 * (moved - (v @ moved) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        reflections.append(v)
    return np.diag(a).copy(), off, reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number: the negative
    terms of its Sturm sequence."""
    square = off**2
    least = np.finfo(np.float64).tiny * max(1.0, square.max(initial=0))
    q = np.full(len(at), np.inf)
    below = np.zeros(len(at), np.int64)
    for d, e2 in zip(diagonal, (0.0, *square)):
        q = d - at - e2 / q
        # A term of zero counts as negative, as the next one would be infinite.
        q = np.where(np.abs(q) < least, -least, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, in falling order, by bisection to the last bit."""
    n = len(diagonal)
    beside = np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))
    reach = 1e-10 + 1e-10 * (np.abs(diagonal) + beside).max()
    low = np.full(k, (diagonal - beside).min() - reach)
    high = np.full(k, (diagonal + beside).max() + reach)
    # Numbered from below, as the counts are.
    number = n - 1 - np.arange(k)
    while True:
        middle = low + (high - low) / 2
        if not ((low < middle) & (middle < high)).any():
            return middle
        above = sturm_counts(diagonal, off, middle) > number
        low, high = np.where(above, low, middle), np.where(above, middle, high)


def _solver(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray):
    """Solves (T - at) x = b for every number at once: elimination with row exchanges."""
    n, k = len(diagonal), len(at)
    least = np.finfo(np.float64).eps * max(np.abs(diagonal).max(), np.abs(off).max(initial=0), 1e-300)
    main = diagonal[:, None] - at
    lower = np.repeat(off[:, None], k, axis=1)
    up = np.vstack([lower, np.zeros((1, k))])
    up2 = np.zeros((n, k))
    swap, factor = np.zeros((n, k), bool), np.zeros((n, k))
    for i in range(n - 1):
        swap[i] = s = np.abs(lower[i]) > np.abs(main[i])
        pivot = np.where(s, lower[i], main[i])
        pivot = np.where(np.abs(pivot) < least, least, pivot)
        factor[i] = np.where(s, main[i], lower[i]) / pivot
        first = np.where(s, main[i + 1], up[i])
        second = np.where(s, up[i + 1], 0.0)
        main[i + 1] = np.where(s, up[i], main[i + 1]) - factor[i] * first
        up[i + 1] = np.where(s, 0.0, up[i + 1]) - factor[i] * second
        main[i], up[i], up2[i] = pivot, first, second
    main[-1] = np.where(np.abs(main[-1]) < least, least, main[-1])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for i in range(n - 1):
            top, under = np.where(swap[i], x[i + 1], x[i]), np.where(swap[i], x[i], x[i + 1])
            x[i], x[i + 1] = top, under - factor[i] * top
        for i in reversed(range(n)):
            if i + 1 < n:
                x[i] -= up[i] * x[i + 1]
            if i + 2 < n:
                x[i] -= up2[i] * x[i + 2]
            x[i] /= main[i]
            # Columns only have a direction; keep them from overflowing.
            if i % 16 == 0:
                large = np.abs(x).max(axis=0)
                x /= np.where(large > 1e100, large, 1.0)
        return x / np.linalg.norm(x, axis=0)

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of eigenvalues in falling order, by inverse iteration.

    In every round a vector is made orthogonal to those before it in its cluster, twice, as
    one pass leaves rounding behind where vectors nearly agree.
    """
    solve = _solver(diagonal, off, values)
    first, near = [], CLUSTER * np.abs(values).max(initial=0)
    for j in range(len(values)):
        first.append(first[-1] if j and values[j - 1] - values[j] <= near else j)
    x = np.random.default_rng(1).uniform(-1, 1, (len(diagonal), len(values)))
    for _ in range(ROUNDS):
        x = solve(x)
        for j in range(len(values)):
            others = x[:, first[j]:j]
            for _ in range(2):
                x[:, j] -= others @ (others.T @ x[:, j])
                x[:, j] /= np.linalg.norm(x[:, j])
    return x


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and unit vectors as columns."""
    k = min(k, len(matrix))
    if not k or not matrix.any():
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    x = tridiagonal_vectors(diagonal, off, values)
    for at, v in reversed(list(enumerate(reflections))):
        if v is not None:
            x[at + 1:] -= 2 * np.outer(v, v @ x[at + 1:])
    return values, x


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector, and how much of the variance each component explains."""

    known: Sums
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def apply(self, vectors: DataFrame) -> DataFrame:
        """``(vec_id, deviation, whitened)`` of every row of ``whole_vectors``."""
        shared = vectors.sparkSession.sparkContext.broadcast(
            (self.known, self.vectors / np.sqrt(self.values)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, projection = shared.value
            k = projection.shape[1]
            for batch in batches:
                for part in _parts(batch):
                    d = known.centred(part.column("x"))
                    found = (d.astype(np.float64) / known.n) @ projection
                    ends = np.arange(0, found.size + 1, k, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("vec_id"), _square_sums(d),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))],
                        names=["vec_id", "deviation", "whitened"])

        return vectors.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def _square_sums(d: np.ndarray) -> pa.Array:
    """Sums of squares by row, exact; null where one exceeds a long."""
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < LONG:
        return pa.array((d * d).sum(axis=1))
    sums = [int(s) for s in (d.astype(object) ** 2).sum(axis=1)]
    return pa.array([s if s <= LONG else None for s in sums], pa.int64())


def fitted(vectors: DataFrame, components: int = COMPONENTS, shift: int = SHIFT) -> Whitening:
    """The whitening of all rows of ``whole_vectors``."""
    known = summed(vectors, shift)
    matrix = covariance(vectors, known) if known.n else np.zeros((0, 0))
    values, columns = leading(matrix, components)
    real = values > RANK * values.max(initial=0)
    values, columns = values[real], columns[:, real]
    return Whitening(known, values, columns, values / (np.trace(matrix) or 1.0))


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest entry of the covariance of the ``whitened`` rows less the identity."""
    if not k:
        return 0.0
    total = rows.agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("whitened"))))
                     .alias("s")).first()["s"]
    mean = np.array(total) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k, k))
        for batch in batches:
            y = batch.column(0).flatten().to_numpy().reshape(-1, k) - mean
            found += y.T @ y
        yield _matrix_rows(found)

    parts = rows.select("whitened").mapInArrow(run, "row long, values array<double>")
    return float(np.abs(_added(parts, k) / n - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE,
             shift: int = SHIFT) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for
    every vector and component."""
    reachable(embeddings.sparkSession)
    vectors = whole_vectors(embeddings, scale, shift)
    fit = fitted(vectors, components, shift)
    k = len(fit.values)
    if not k:
        return embeddings.sparkSession.createDataFrame(
            [], "vec_id long, component int, n long, deviation long, whitened double, "
                "explained double, identity_error double")
    rows = stored(fit.apply(vectors), "whitened")
    error = identity_error(rows, fit.known.n, k)
    shares = F.array(*[F.lit(float(x)) for x in fit.explained])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.known.n).cast("long").alias("n"),
        "deviation", F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"))
