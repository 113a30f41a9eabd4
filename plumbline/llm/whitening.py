"""Whitening of embeddings: principal components by spectral divide and conquer over QDWH polar factors.

The polar factor of a covariance less a shift is its matrix sign: half of (sign + 1) projects on the eigenvectors above
the shift. An orthonormal basis of that projector's range and its complement turns the covariance into two smaller
blocks, which are cut again, down to single components. The polar factor comes from dynamically weighted Halley steps,
by QR while the matrix is ill-conditioned and by Cholesky factors after.

Vectors are read as whole numbers, ``x = floor(64 c) + 1000000`` for each entry ``c`` as a double, so counts and sums
are exact. The covariance is gathered in one pass, from rows less their exact mean; a task returns one partial matrix.
Only matrices of the vectors' length reach the driver, and the mean and components are broadcast.

Defined results: rows whose vector is null, empty, or holds null or non-finite entries, and entries whose x is no long,
have no rows. Vectors of each length are a list of their own, with its own n, mean and components. Components whose
eigenvalue is zero, up to rounding, are left out, so one vector, or equal ones, give no rows. Of equal eigenvalues any
basis is used; the largest entry of a component is positive. Null and repeated ids are kept, a row for a row.
``deviation`` is null where it is no long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import pick, type_of

#: Components returned for each vector.
MOST = 32
SCALE, OFFSET = 64.0, 1_000_000
EPS = float(np.finfo(float).eps)
#: Products that stay below this are exact in 64 bits.
SAFE = 1 << 62


# The eigenvectors of one matrix.


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix without a zero eigenvalue, by QDWH steps."""
    size = len(a)
    eye = np.eye(size)
    x = a / np.linalg.norm(a)
    low = EPS  # a bound below the smallest singular value; too small a one costs a step
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        r = np.sqrt(1 + d)
        p = r + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * r))) / 2
        q = (p - 1) ** 2 / 4
        s = p + q - 1
        if s > 100:
            top, _ = np.linalg.qr(np.vstack([np.sqrt(s) * x, eye]))
            new = q / s * x + (p - q / s) / np.sqrt(s) * top[:size] @ top[size:].T
        else:
            lower = np.linalg.cholesky(eye + s * x.T @ x)
            new = q / s * x + (p - q / s) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (p + q * square) / (1 + s * square))
        if 1 - low < 10 * EPS and moved < np.cbrt(EPS):
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below the shift, unless one is empty or they aren't invariant."""
    size = len(a)
    sign = polar(a - shift * np.eye(size))
    projector = (sign + np.eye(size)) / 2
    above = round(float(np.trace(projector)))
    if not 0 < above < size:
        return None
    basis, _ = np.linalg.qr(projector @ np.random.default_rng(size).standard_normal((size, above)), mode="complete")
    # Once more: the projector's own range, to working precision.
    basis, _ = np.linalg.qr(projector @ basis[:, :above], mode="complete")
    upper, lower = basis[:, :above], basis[:, above:]
    off = np.linalg.norm(lower.T @ a @ upper)
    return (upper, lower) if off <= 100 * size * EPS * np.linalg.norm(a) else None


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in the columns, of a symmetric matrix."""
    a = (a + a.T) / 2
    whole = np.linalg.norm(a)

    def split(block: np.ndarray, basis: np.ndarray) -> list[np.ndarray]:
        size = len(block)
        middle = np.trace(block) / size
        spread = np.linalg.norm(block - middle * np.eye(size))
        # What is left is a multiple of one, up to rounding: any basis will do.
        if size == 1 or spread <= size * EPS * whole:
            return [basis]
        diagonal = np.sort(np.diag(block))
        candidates = [middle, diagonal[size // 2], *(middle + spread * f / np.sqrt(size) for f in (0.1, -0.1, 0.3, -0.3, 0.5, -0.5, 0.9, -0.9))]
        for shift in candidates:
            found = _halves(block, shift)
            if found is not None:
                return [part for half in found for part in split(_symmetric(half.T @ block @ half), basis @ half)]
        return [basis]

    basis, _ = np.linalg.qr(np.hstack(split(a, np.eye(len(a)))))
    values = np.einsum("ij,ij->j", basis, a @ basis)
    order = np.argsort(-values, kind="stable")
    basis = basis[:, order]
    signs = np.sign(basis[np.abs(basis).argmax(axis=0), np.arange(len(a))])
    return values[order], basis * signs


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


# The table.


def _finite(vector: Column) -> Column:
    """Vectors of finite entries whose whole number is a long."""
    def usable(c: Column) -> Column:
        return c.isNotNull() & (F.abs(c.cast("double") * SCALE) < float(1 << 62))  # not true of NaN or infinity

    return (F.size(vector) > 0) & F.forall(vector, usable)


def _rows(embeddings: DataFrame) -> DataFrame:
    plain = pick(embeddings, "vec_id", "embedding").filter(F.col("embedding").isNotNull())
    return plain.filter(_finite(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, row numbers, whole numbers)`` of the vectors of one batch."""
    lists = batch.column(column)
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        cells = values[ends[rows][:, None] + np.arange(length)]
        yield int(length), rows, np.floor(SCALE * cells).astype(np.int64) + OFFSET


def _totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length the number of vectors and the exact sums of their whole numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for length, at, x in _by_length(batch, 0):
                n, old = sums.get(length, (0, [0] * length))
                small = np.abs(x).max(initial=0) * len(at) < SAFE
                new = x.sum(axis=0).tolist() if small else [sum(c) for c in x.T.tolist()]
                sums[length] = (n + len(at), [a + b for a, b in zip(old, new, strict=True)])
        for length, (n, total) in sums.items():
            cells = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()),
                                              pa.array([n] * length, pa.int64()), cells], ["length", "place", "n", "total"])

    parts = rows.select("v").mapInArrow(run, "length int, place int, n long, total decimal(38,0)")
    # A row for each entry of a vector of each length.
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("length", "place").collect():
        found.setdefault(r.length, (r.n, []))[1].append(int(r.total))
    return found


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Rows less their mean, rounded once: whole parts are taken off exactly."""
    whole, rest = np.array([t // n for t in total], dtype=np.int64), np.array([t % n / n for t in total])
    return (x - whole) - rest


def _covariances(rows: DataFrame, totals: dict[int, tuple[int, list[int]]], weights: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """For each length the covariance, divisor n, of the vectors, or of what the weights make of them."""
    state = rows.sparkSession.sparkContext.broadcast((totals, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, factors = state.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in _by_length(batch, 0):
                centred = _centred(x, *means[length])
                if factors is not None:
                    centred = centred @ factors[length]
                sums[length] = sums.get(length, 0) + centred.T @ centred
        for length, total in sums.items():
            width = len(total)
            row, cells = pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([length] * width, pa.int32()), row, cells], ["length", "row", "cells"])

    parts = rows.select("v").mapInArrow(run, "length int, row int, cells array<double>")
    cells = parts.select("length", "row", F.posexplode("cells").alias("place", "cell"))
    found: dict[int, np.ndarray] = {}
    for r in cells.groupBy("length", "row", "place").agg(F.sum("cell").alias("cell")).collect():
        width = r.length if weights is None else weights[r.length].shape[1]
        found.setdefault(r.length, np.zeros((width, width)))[r.row, r.place] = r.cell / totals[r.length][0]
    return found


class Whitening:
    """For each length of vectors: count and sums, eigenvalues, components in columns, and the trace."""

    def __init__(self, totals: dict[int, tuple[int, list[int]]], values: dict[int, np.ndarray], vectors: dict[int, np.ndarray],
                 traces: dict[int, float]) -> None:
        self.totals, self.values, self.vectors, self.traces = totals, values, vectors, traces

    def weights(self) -> dict[int, np.ndarray]:
        return {k: v / np.sqrt(self.values[k]) for k, v in self.vectors.items()}


def fit(embeddings: DataFrame, most: int = MOST) -> Whitening:
    """Means and components of all usable vectors."""
    rows = _rows(embeddings)
    totals = _totals(rows)
    values, vectors, traces = {}, {}, {}
    for length, covariance in _covariances(rows, totals).items():
        found, basis = eigen(covariance)
        traces[length] = float(np.trace(covariance))
        used = min(most, int((found > length * EPS * max(found[0], 0.0) * 8).sum()))
        values[length], vectors[length] = found[:used], basis[:, :used]
    return Whitening(totals, values, vectors, traces)


def identity_errors(embeddings: DataFrame, model: Whitening) -> dict[int, float]:
    """For each length the largest entry of the whitened vectors' covariance less the identity, from all vectors."""
    found = _covariances(_rows(embeddings), model.totals, model.weights())
    return {k: float(np.abs(v - np.eye(len(v))).max(initial=0.0)) for k, v in found.items()}


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The exact sum over places of (n x - total) squared."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, total), default=0)
    if largest < SAFE:
        off = n * x - np.array(total, dtype=np.int64)
        if int(np.abs(off).max(initial=0)) ** 2 * len(total) < SAFE:
            return (off * off).sum(axis=1).tolist()
    exact = [reduce(lambda s, p: s + (n * p[0] - p[1]) ** 2, zip(r, total, strict=True), 0) for r in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(embeddings: DataFrame, model: Whitening, errors: dict[int, float]) -> DataFrame:
    """A row for each vector and component."""
    rows = _rows(embeddings)
    # Matrices of the vectors' length: the bound doesn't depend on the number of rows.
    state = rows.sparkSession.sparkContext.broadcast((model, errors))
    schema = f"vec_id {type_of(rows, 'vec_id')}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, off = state.value
        weights = own.weights()
        for batch in batches:
            for length, at, x in _by_length(batch, 1):
                n, total = own.totals[length]
                values = _centred(x, n, total) @ weights[length]
                count = values.shape[1]
                if not count:
                    continue
                each = np.repeat(np.arange(len(at)), count)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(each), n, np.int64)), pa.array(_deviations(x, n, total), pa.int64()).take(pa.array(each)),
                    pa.array(values.ravel()), pa.array(np.tile(own.values[length] / own.traces[length], len(at))),
                    pa.array(np.full(len(each), off[length]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
