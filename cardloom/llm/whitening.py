"""Whitening of vectors by the leading eigenvectors of their covariance, found by spectrum slicing.

Entries are turned into whole numbers, so that sums and deviations are exact. The covariance of the
distinct vectors is added up over tasks, centred before multiplying; it is as small as the vectors
are long, and its spectrum is the driver's work. The inertia of V - s I, read off an LDL' factorisation,
counts the eigenvalues below s: bisection by such counts isolates each leading eigenvalue, Rayleigh
quotient iteration finds it, and two more counts certify that it is the one of that number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.llm.common import ready, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# The covariance is held whole by every task: longer vectors are refused.
MOST_DIMENSIONS = 2048
# Eigenvalues closer than this part of the largest are not told apart; those below it have no direction.
SAME = 1e-13
_PIVOT = (1 + 17**0.5) / 8


class Factors:
    """P A P' = L D L' of a symmetric matrix, D of blocks of one or two (diagonal pivoting)."""

    def __init__(self, a: np.ndarray) -> None:
        a = a.copy()
        n = len(a)
        self.order, self.blocks, self.lower = np.arange(n), [], np.eye(n)
        floor = np.finfo(float).tiny / np.finfo(float).eps
        k = 0
        while k < n:
            size = 1
            column = np.abs(a[k + 1 :, k])
            if len(column) and column.max() > 0:
                r = k + 1 + int(column.argmax())
                top = column.max()
                if abs(a[k, k]) < _PIVOT * top:
                    row = np.abs(a[k:, r])
                    row[r - k] = 0
                    if abs(a[k, k]) * row.max() >= _PIVOT * top * top:
                        pass
                    elif abs(a[r, r]) >= _PIVOT * row.max():
                        self._swap(a, k, r)
                    else:
                        self._swap(a, k + 1, r)
                        size = 2
            if size == 1 and abs(a[k, k]) < floor:
                a[k, k] = floor  # an eigenvalue at the shift itself: read as above it
            block = a[k : k + size, k : k + size].copy()
            self.blocks.append((k, block))
            below = a[k + size :, k : k + size]
            rows = np.linalg.solve(block, below.T).T if len(below) else below
            self.lower[k + size :, k : k + size] = rows
            a[k + size :, k + size :] -= rows @ below.T
            k += size

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]
            done = min((k for k in range(len(a)) if k >= min(i, j)), default=0)
            self.lower[[i, j], :done] = self.lower[[j, i], :done]

    def negative(self) -> int:
        """Negative eigenvalues of D, and so of the matrix: its inertia."""
        return sum(int((np.linalg.eigvalsh(b) < 0).sum()) if len(b) == 2 else int(b[0, 0] < 0) for _, b in self.blocks)

    def solve(self, x: np.ndarray) -> np.ndarray:
        y = x[self.order].copy()
        for k in range(len(y)):
            y[k + 1 :] -= self.lower[k + 1 :, k] * y[k]
        for k, b in self.blocks:
            y[k : k + len(b)] = np.linalg.solve(b, y[k : k + len(b)])
        for k in range(len(y) - 1, -1, -1):
            y[k] -= self.lower[k + 1 :, k] @ y[k + 1 :]
        out = np.empty_like(y)
        out[self.order] = y
        return out


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than the shift."""
    return len(v) - Factors(v - shift * np.eye(len(v))).negative()


def _without(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """x made orthogonal to the vectors found, twice for the sake of rounding, at length one."""
    for _ in range(2):
        for u in found:
            x = x - (u @ x) * u
        x = x / np.linalg.norm(x)
    return x


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    Fewer where others are zero, next to the largest. Equal eigenvalues get orthogonal vectors.
    """
    n = len(v)
    v = (v + v.T) / 2
    # No eigenvalue lies beyond the largest sum of a row.
    limit = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if limit == 0 or not np.isfinite(limit):
        return np.zeros(0), np.zeros((n, 0))
    same = SAME * limit
    values: list[float] = []
    vectors: list[np.ndarray] = []
    draw = np.random.default_rng(0)
    while len(values) < min(count, n):
        k = len(values)
        # low has more than k eigenvalues above it, high at most k: narrow until just one lies between.
        low, high = -limit * 1e-3 - same, limit * 1.001
        n_low, n_high = n, 0
        while n_low - n_high > 1 or n_high < k:
            if high - low <= same:
                break
            middle = (low + high) / 2
            got = above(v, middle)
            if got > k:
                low, n_low = middle, got
            else:
                high, n_high = middle, got
        if high <= same:
            break  # what is left is zero
        pair = _iterate(v, low, high, vectors, draw)
        values.append(pair[0])
        vectors.append(pair[1])
    keep = [k for k, e in enumerate(values) if e > same]
    order = sorted(keep, key=lambda k: -values[k])
    return np.array([values[k] for k in order]), np.array([vectors[k] for k in order]).reshape(len(order), n).T


def _iterate(v: np.ndarray, low: float, high: float, found: list[np.ndarray], draw: np.random.Generator) -> tuple[float, np.ndarray]:
    """The eigenvalue between low and high and its vector, by Rayleigh quotient iteration from the middle.

    Where the iteration leaves the interval, counts halve it and it starts again. An interval too narrow to halve
    holds eigenvalues that are equal: inverse iteration orthogonal to those found gives one of them.
    """
    n, scale = len(v), max(abs(low), abs(high), np.finfo(float).tiny)
    top = above(v, high)
    while True:
        narrow = high - low <= SAME * np.abs(v).sum(axis=1).max()
        x = _without(draw.normal(size=n), found)
        shift = (low + high) / 2
        for _ in range(3):  # towards the interval's own vector first
            x = _without(Factors(v - shift * np.eye(n)).solve(x), found)
        rho, best = float(x @ v @ x), np.inf
        for _ in range(20):
            residual = np.linalg.norm(v @ x - rho * x)
            if residual >= best / 2 or not (low <= rho <= high):
                break
            best, kept = residual, (rho, x)
            if residual <= 1e-16 * scale:
                break
            x = _without(Factors(v - rho * np.eye(n)).solve(x), found if narrow else [])
            rho = float(x @ v @ x)
        if narrow:
            return float(x @ v @ x), x
        # Counts certify the number: one more eigenvalue above just below it than above the interval.
        if best <= 1e-10 * scale and low <= kept[0] <= high:
            slack = max(4 * best, 1e-14 * scale)
            if above(v, kept[0] - slack) == top + 1 and above(v, kept[0] + slack) == top:
                return kept[0], _without(kept[1], found)  # sets vectors of close eigenvalues apart
        middle = (low + high) / 2
        if above(v, middle) > top:
            low = middle
        else:
            high = middle


def _whole(column: pa.ListArray, size: int) -> np.ndarray:
    """Rows of `size` whole numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _pairs(sums: np.ndarray) -> pa.RecordBatch:
    """The entries on and above the diagonal as rows."""
    i, j = np.triu_indices(len(sums))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j])], ["i", "j", "v"])


def _added_up(parts: DataFrame, size: int) -> np.ndarray:
    """Matrices of tasks, as rows (i, j, v), in one symmetric matrix; Spark adds up before anything meets."""
    out = np.zeros((size, size))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # size**2 / 2 rows, MOST_DIMENSIONS at most
        out[i, j] = out[j, i] = v
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each row and component.

    Every entry c becomes x = floor(64 c) + 1,000,000, worked out in doubles. Mean, covariance and n
    are those of the distinct x vectors. `deviation` is exact; it and x must fit 64 bits, beyond which
    Arrow or Spark raise an error. `whitened` projects x minus the mean on the component and divides by
    the root of its eigenvalue; `explained` is that eigenvalue by the covariance's trace;
    `identity_error` is how far the covariance of `whitened` over the distinct vectors is from the identity.

    Rows whose vector is NULL, empty or holds NULL or non-finite entries are dropped; so are rows whose
    length is not the most frequent one (the longer of two). Repeated rows and NULL ids keep a row each; other columns play no
    part. Components whose eigenvalue is zero next to the largest have no direction and are left out: a
    table of equal vectors, or an empty one, gives no rows. At most MOST_DIMENSIONS entries a vector.
    """
    spark = ready(vectors.sparkSession)
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    given = given.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    rows = given.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    size = lengths.dim if lengths else 0
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {size} entries: at most {MOST_DIMENSIONS} are whitened")
    rows = rows.filter(F.size("x") == size)
    fit = written(rows.select("x").distinct(), "whitening-fit")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, np.int64)
        for batch in batches:
            n, total = n + len(batch), total + _whole(batch.column(0), size).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size)), pa.array(np.concatenate([[n], total]))], ["i", "s"])

    found = dict(map(tuple, fit.mapInArrow(sums, "i long, s long").groupBy("i").agg(F.sum("s")).collect()))  # one row for each entry
    n = found.get(-1, 0)
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n or not size:
        return spark.createDataFrame([], out)
    total = np.array([found[i] for i in range(size)], np.int64)
    shared = spark.sparkContext.broadcast((n, total))  # one number for each entry of a vector

    def centred(x: np.ndarray) -> np.ndarray:
        n, total = shared.value
        return (n * x - total) / n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((size, size))
        for batch in batches:
            y = centred(_whole(batch.column(0), size))
            held += y.T @ y
        yield _pairs(held)

    covariance = _added_up(fit.mapInArrow(products, "i int, j int, v double"), size) / n
    values, basis = leading(covariance, components)
    if not len(values):
        return spark.createDataFrame([], out)
    project = spark.sparkContext.broadcast(basis / np.sqrt(values))

    def whitened_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(values), len(values)))
        for batch in batches:
            w = centred(_whole(batch.column(0), size)) @ project.value
            held += w.T @ w
        yield _pairs(held)

    identity = _added_up(fit.mapInArrow(whitened_products, "i int, j int, v double"), len(values)) / n
    error = float(np.abs(identity - np.eye(len(values))).max())
    explained = values / np.trace(covariance)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = shared.value
        k = len(values)
        for batch in batches:
            x = _whole(batch.column(1), size)
            from_mean = n * x - total
            if float(np.abs(from_mean).max(initial=0)) ** 2 * size < 2.0**62:
                deviation = (from_mean**2).sum(axis=1)
            else:  # whole numbers of any size; Arrow refuses what does not fit
                deviation = [sum(int(y) ** 2 for y in line) for line in from_mean]
            rows = pa.array(np.repeat(np.arange(len(batch)), k))
            many = len(batch) * k
            arrays = [
                batch.column(0).take(rows), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(batch))), pa.array(np.full(many, n, np.int64)),
                pa.array(deviation, pa.int64()).take(rows), pa.array(((from_mean / n) @ project.value).ravel()),
                pa.array(np.tile(explained, len(batch))), pa.array(np.full(many, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in out.split(", ")])

    return rows.mapInArrow(apply, out)
