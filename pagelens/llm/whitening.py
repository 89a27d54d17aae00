"""Whitening of embeddings: principal components from a triangular factor.

The covariance V of the vectors is factored as P L L' P' by Cholesky with complete pivoting. One-sided Jacobi
rotations from the right then make the columns of the triangular factor L orthogonal. V is never diagonalised
itself: the norm of a rotated column, squared, is an eigenvalue, and the column divided by its norm is the unit
eigenvector. Working on L keeps small eigenvalues accurate.

The covariance is exact until it is rounded once: entries are whole numbers, tasks centre them by the whole number
nearest to the mean before they multiply, and the rest of the mean is taken off in whole numbers as well.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
# Vectors that a task multiplies at once.
ROWS = 1024
_LONG = 2 ** 63


def integer_entries(vectors: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which rows of an array of lists take part, and for each length (row numbers, x) with x = floor(64 c) + 1000000.

    A row that is null or holds a null or non-finite entry takes no part. An x beyond a long is an error."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    flat = vectors.flatten()  # entries of null rows are left out
    entries = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    usable = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[starts[1:]] == bad[starts[:-1]])
    out = []
    for size in np.unique(sizes[usable]):
        rows = np.flatnonzero(usable & (sizes == size))
        values = np.floor(SCALE * entries[starts[rows][:, None] + np.arange(size)[None, :]])
        if values.size and np.abs(values).max() >= float(_LONG - 2 * SHIFT):
            raise OverflowError("an entry is beyond a long after scaling")
        out.append((rows, values.astype(np.int64) + SHIFT))
    return usable, out


@dataclass(frozen=True)
class Whitening:
    """The model of all vectors of one length. ``components`` has one unit eigenvector in each column, ``values`` the
    eigenvalues, falling; ``trace`` is that of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once: the whole part of the mean goes off exactly first."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        return (x - whole).astype(float) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n x - S)^2 of every row."""
        n, sums = self.n, self.sums
        whole = np.array([s // n for s in sums], np.int64)
        rest = np.array([s % n for s in sums], np.int64)
        near = x - whole
        # Without a chance of overflow in numpy's longs, else in Python's whole numbers.
        reach = (float(np.abs(near).max(initial=0)) + 1) * n
        if reach * reach * max(len(sums), 1) < _LONG:
            return ((near * n - rest) ** 2).sum(axis=1).tolist()
        out = [sum((int(v) * n - int(r)) ** 2 for v, r in zip(row, rest, strict=True)) for row in near]
        if max(out) >= _LONG:
            raise OverflowError("the deviation of a vector is beyond a long")
        return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L): v[order][:, order] = L L' with L lower trapezoidal, its columns as many as the rank of v. The largest
    remaining diagonal entry is the next pivot; an entry within rounding of zero, against what it was at first, is zero."""
    a = np.array(v, np.longdouble)
    d = len(a)
    order, low = np.arange(d), np.zeros((d, d), np.longdouble)
    # v itself is rounded to double, which is what limits the rank.
    noise = d * np.finfo(np.float64).eps * np.diagonal(a)
    for k in range(d):
        left = np.diagonal(a)[k:]
        left = np.where(left > noise[order[k:]], left, 0)
        p = k + int(np.argmax(left))
        if not left[p - k]:
            return order, low[:, :k]
        for m in (a, low):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1:, k] = a[k + 1:, k] / low[k, k]
        a[k + 1:, k + 1:] -= np.outer(low[k + 1:, k], low[k + 1:, k])
    return order, low


def one_sided_jacobi(low: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Rotate pairs of columns until all are orthogonal to double precision; the product with its transpose stays."""
    columns = np.array(low.T, np.longdouble)  # a column in each row, so that a rotation touches two runs of memory
    r = len(columns)
    small = np.finfo(np.float64).eps / 8
    for _ in range(sweeps):
        turned = False
        for i in range(r - 1):
            for j in range(i + 1, r):
                a, b = columns[i], columns[j]
                across, aa, bb = a @ b, a @ a, b @ b
                if abs(across) <= small * np.sqrt(aa * bb):
                    continue
                turned = True
                zeta = (bb - aa) / (2 * across)
                t = (1 if zeta >= 0 else -1) / (abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                columns[i], columns[j] = c * a - c * t * b, c * t * a + c * b
        if not turned:
            return columns.T
    raise ArithmeticError("the rotations did not converge")


def principal(v: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(unit eigenvectors as columns, eigenvalues) of a covariance, by falling eigenvalue; those of value zero are left
    out. Equal eigenvalues may come in any order."""
    order, low = pivoted_cholesky(v)
    rotated = one_sided_jacobi(low)
    norms = np.sqrt((rotated * rotated).sum(axis=0))
    first = np.argsort(-norms, kind="stable")[:components]
    vectors = np.empty((len(v), len(first)))
    vectors[order] = (rotated[:, first] / norms[first]).astype(float)
    return vectors, (norms[first] ** 2).astype(float)


def _chunks(batches, column: int):
    """(batch, row numbers, x) of all usable rows, at most ROWS of one length at a time."""
    for batch in batches:
        _, groups = integer_entries(batch.column(column))
        for rows, x in groups:
            for at in range(0, len(rows), ROWS):
                yield batch, rows[at:at + ROWS], x[at:at + ROWS]


class _Totals:
    """Whole-number sums of a task, kept in Python's whole numbers so that they never wrap."""

    def __init__(self):
        self.held: dict[int, list] = {}

    def add(self, size: int, n: int, first: np.ndarray, second: np.ndarray | None = None) -> None:
        parts = [n, first.astype(object)] + ([] if second is None else [second.astype(object)])
        if size in self.held:
            parts = [a + b for a, b in zip(self.held[size], parts, strict=True)]
        self.held[size] = parts

    def rows(self) -> pa.RecordBatch:
        """(size, i, j, total): i = -1 the count, j = -1 a sum, else a sum of products with i <= j."""
        out = []
        for size, (n, first, *second) in self.held.items():
            out.append((size, -1, -1, n))
            out += [(size, i, -1, t) for i, t in enumerate(first)]
            if second:
                out += [(size, i, j, second[0][i, j]) for i in range(size) for j in range(i, size)]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array([str(t) for t in columns[3]], pa.string())],
            ["size", "i", "j", "total"])


def _gathered(rows: DataFrame, run) -> dict[int, dict[tuple[int, int], int]]:
    """Sums of all tasks: Spark adds them by place, so a length of d gives at most d (d + 3) / 2 + 1 rows."""
    found = rows.mapInArrow(run, "size int, i int, j int, total string").groupBy("size", "i", "j").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    out: dict[int, dict[tuple[int, int], int]] = {}
    for r in found:
        out.setdefault(r["size"], {})[r["i"], r["j"]] = int(r["total"])
    return out


def _sums(z: np.ndarray) -> np.ndarray:
    wide = z.astype(object) if float(np.abs(z).max(initial=0)) * len(z) >= 2 ** 62 else z
    return wide.sum(axis=0).astype(object)


def _products(z: np.ndarray) -> np.ndarray:
    """z'z in whole numbers: by floats while they are exact, else by Python's whole numbers."""
    top = float(np.abs(z).max(initial=0))
    if top * top * len(z) < 2 ** 53:
        return (z.T.astype(float) @ z.astype(float)).astype(np.int64)
    wide = z.astype(object)
    return wide.T @ wide


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> dict[int, Whitening]:
    """A model for each length of vector. Two passes: sums, then products of centred entries. The driver holds d * d numbers
    and turns columns of length d."""
    only = vectors.select(F.col(vector_col).alias("v"))

    def first_pass(batches):
        totals = _Totals()
        for _, rows, x in _chunks(batches, 0):
            totals.add(x.shape[1], len(rows), _sums(x - SHIFT) + SHIFT * len(rows))
        yield totals.rows()

    sums: dict[int, tuple[int, list[int]]] = {
        size: (t[-1, -1], [t[i, -1] for i in range(size)]) for size, t in _gathered(only, first_pass).items()}
    middles = {size: [round(Fraction(s, n)) for s in each] for size, (n, each) in sums.items()}

    def second_pass(batches):
        totals = _Totals()
        for _, rows, x in _chunks(batches, 0):
            z = x - np.array(middles[x.shape[1]], np.int64)
            totals.add(x.shape[1], len(rows), _sums(z), _products(z))
        yield totals.rows()

    models = {}
    for size, t in _gathered(only, second_pass).items():
        n = t[-1, -1]
        rest = [t[i, -1] for i in range(size)]
        v = np.zeros((size, size))
        trace = Fraction(0)
        for i in range(size):
            for j in range(i, size):
                exact = Fraction(n * t[i, j] - rest[i] * rest[j], n * n)
                v[i, j] = v[j, i] = float(exact)
                trace += exact if i == j else 0
        found, values = principal(v, components)
        models[size] = Whitening(n, tuple(sums[size][1]), found, values, float(trace))
    return models


def identity_errors(vectors: DataFrame, models: dict[int, Whitening], vector_col: str = "embedding") -> dict[int, float]:
    """For each length the largest entry, without sign, of the measured covariance of the whitened vectors minus the identity."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for _, _, x in _chunks(batches, 0):
            w = models[x.shape[1]].whitened(x)
            w = np.hstack([w, np.ones((len(w), 1))])  # the last row and column: sums and the count
            held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for size, m in held.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, size), pa.int32()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                 pa.array(m.ravel())], ["size", "i", "j", "total"])

    rows = vectors.select(F.col(vector_col).alias("v")).mapInArrow(run, "size int, i int, j int, total double").groupBy(
        "size", "i", "j").agg(F.sum("total").alias("total")).collect()
    out = {}
    for size, model in models.items():
        k = len(model.values)
        m = np.zeros((k + 1, k + 1))
        for r in rows:
            if r["size"] == size:
                m[r["i"], r["j"]] = r["total"]
        # Their mean is zero but for rounding, so taking it off afterwards loses nothing.
        mean = m[:k, k] / model.n
        covariance = m[:k, :k] / model.n - np.outer(mean, mean)
        out[size] = float(np.abs(covariance - np.eye(k)).max(initial=0))
    return out


def transform(
    vectors: DataFrame, models: dict[int, Whitening], vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id",),
) -> DataFrame:
    """``keep`` columns, component (from 1), n, deviation, whitened and explained of every usable row and component."""
    names = list(keep)

    def run(batches):
        for batch, rows, x in _chunks(batches, len(names)):
            model = models[x.shape[1]]
            k = len(model.values)
            taken = pa.array(np.repeat(rows, k))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(taken) for c in batch.columns[:len(names)]),
                 pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()),
                 pa.array(np.full(k * len(rows), model.n), pa.int64()),
                 pa.array(np.repeat(np.array(model.deviation(x), np.int64), k), pa.int64()),
                 pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, len(rows)) if k else [], pa.float64()),
                 pa.array(np.full(k * len(rows), x.shape[1]), pa.int32())],
                [*names, "component", "n", "deviation", "whitened", "explained", "size"])

    kept = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in names)
    return vectors.select(*names, F.col(vector_col).alias("_v")).mapInArrow(
        run, f"{kept}, component int, n bigint, deviation bigint, whitened double, explained double, size int")


def report(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row and component up to 32.

    Null vectors and those with null or non-finite entries are dropped; null ids and repeated rows are rows like others.
    Vectors of another length are a fit list of their own. Components without variance are not reported, so an empty table,
    a single vector, equal vectors and empty vectors give no rows.
    """
    models = fit(embeddings)
    errors = identity_errors(embeddings, models)
    error = F.lit(None).cast("double")
    for size, value in errors.items():
        error = F.when(F.col("size") == size, F.lit(value)).otherwise(error)
    return transform(embeddings, models).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", error.alias("identity_error"))
