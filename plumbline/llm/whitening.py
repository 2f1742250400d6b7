"""Embedding whitening by mixed-precision refinement of a distributed covariance.

The covariance of the whole table is summed up over partitions, each row centred by the
exact mean before it is multiplied. Its eigenvectors are found in float32 and corrected
by the iteration of Ogita and Aishima: matrix products in double precision give the loss
of orthogonality R = I - X'X and the projected matrix S = X'AX, from which first-order
corrections of all vectors follow at once; the error is squared each time. Eigenvalues
that lie closer than the error estimate can't be told apart so; they form a cluster, and
the small eigenproblem of the matrix on the cluster's own subspace is solved instead.

Sums are whole numbers and exact. What reaches the driver is a matrix of dimension x
dimension, never a row of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
MOST_COMPONENTS = 8
ROUNDS = 12


def refine(a: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of Ogita and Aishima on approximate eigenpairs of symmetric ``a``.

    Gives values, vectors and the size of the correction.
    """
    n = len(a)
    r = np.eye(n) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    w = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    near = 2 * (np.linalg.norm(off, 2) + np.linalg.norm(a, 2) * np.linalg.norm(r, 2))
    gap = w[None, :] - w[:, None]
    apart = np.abs(gap) > near
    e = np.where(apart, (s + w[None, :] * r) / np.where(apart, gap, 1.0), r / 2)
    x = x + x @ e
    order = np.argsort(-w, kind="stable")
    w, x = w[order], x[:, order]
    # Values that the estimate can't tell apart: neighbours closer than it, chained.
    cuts = np.flatnonzero(-np.diff(w) > near) + 1
    for part in np.split(np.arange(n), cuts):
        if len(part) > 1:
            w[part], x[:, part] = _sub_solve(a, x[:, part])
    return w, x, float(np.abs(e).max(initial=0.0))


def _sub_solve(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``a`` on the span of ``x``; what the values share is taken off first,
    so that the small problem is as large as their differences."""
    q = np.linalg.qr(x)[0]
    aq = a @ q
    mid = float(np.trace(q.T @ aq)) / q.shape[1]
    small = q.T @ (aq - mid * q)
    v, u = np.linalg.eigh((small + small.T) / 2)
    return mid + v[::-1], q @ u[:, ::-1]


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, to double
    precision. Each vector's largest entry (the first of equals) is positive."""
    n = len(v)
    size = float(np.abs(v).max(initial=0.0))
    if n == 0 or size == 0.0:
        return np.zeros(n), np.eye(n)
    a = (v + v.T) / (2 * size)
    w, x = np.linalg.eigh(a.astype(np.float32))
    w, x = w.astype(float), x.astype(float)
    last = np.inf
    for _ in range(ROUNDS):
        w, x, step = refine(a, w, x)
        # The error is squared until rounding is all that is left of it.
        if step < 1e-14 * n or step >= last and step < 1e-9:
            break
        last = step
    x /= np.linalg.norm(x, axis=0)
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(n)] < 0, -1.0, 1.0)
    return w * size, x


def _vectors(column: pa.Array, scale: int, shift: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and whole-number vectors of a list column's sound entries, by length.

    A component is floor(scale * c) + shift; one that leaves 62 bits raises.
    """
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float)  # a null gives nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    sound = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    out = {}
    for dim in np.unique(sizes[sound]).tolist():
        rows = np.flatnonzero(sound & (sizes == dim))
        at = (ends - sizes)[rows]
        c = values if len(values) == len(rows) * dim else values[at[:, None] + np.arange(dim)]
        c = np.floor(scale * c.reshape(-1, dim))
        if np.abs(c).max(initial=0.0) >= 1 << 62:
            raise OverflowError("a component leaves the range of a long")
        out[dim] = rows, c.astype(np.int64) + shift
    return out


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two exact sums over the rows of ``x``: of the high parts and of the low 31 bits."""
    return (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)


def totals(rows: DataFrame, embedding: str, scale: int, shift: int) -> tuple[int, list[int]]:
    """(number of rows, exact sum of each component) of the vectors of the usual length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, (at, x) in _vectors(batch.column(0), scale, shift).items():
                high, low = _halves(x)
                one = held.setdefault(dim, [0, [0] * dim])
                one[0] += len(at)
                one[1] = [s + (int(h) << 31) + int(l) for s, h, l in zip(one[1], high, low)]
        data = [(d, n, k, str(s)) for d, (n, sums) in held.items() for k, s in enumerate(sums)]
        columns = zip(*data) if data else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string()))],
            names=["dim", "n", "k", "s"],
        )

    parts = rows.select(embedding).mapInArrow(run, "dim int, n long, k int, s string")
    sums = parts.groupBy("dim", "k").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    )
    # The length that most rows have, the longer one of equals: a row per dimension.
    best = sums.where("k = 0").orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not best:
        return 0, []
    found = sums.where(F.col("dim") == best[0]["dim"]).collect()
    return best[0]["n"], [int(r["s"]) for r in sorted(found, key=lambda r: r["k"])]


def summed(rows: DataFrame, width: int, partial) -> np.ndarray:
    """The sum of the matrices that ``partial`` makes of partitions, each of ``width`` columns.

    Partitions send rows of their matrix, which are added up where they meet; the
    driver gets one matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = partial(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(got), dtype=np.int32)),
                    pa.array([x.tobytes() for x in got.astype("<f8")], pa.binary()),
                ],
                names=["i", "x"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(x, "<f8")
                held[i] = held[i] + x if i in held else x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
            names=["i", "x"],
        )

    kinds = "i int, x binary"
    made = rows.mapInArrow(run, kinds).repartition("i").mapInArrow(add, kinds).collect()
    out = np.zeros((max((r["i"] for r in made), default=-1) + 1, width))
    for r in made:
        out[r["i"]] += np.frombuffer(r["x"], "<f8")
    return out


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - S as exact whole numbers: Python's where a long might not hold them."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, s.tolist()), default=0)
    return n * x - s.astype(np.int64) if most < 1 << 62 else n * x.astype(object) - s


def _decimals(x: np.ndarray) -> pa.Array:
    if x.dtype == object:
        return pa.array([Decimal(int(v)) for v in x], pa.decimal128(38, 0))
    return pa.array(x).cast(pa.decimal128(38, 0))


class Whitener:
    """Mean, eigenvalues and components of a table; made by ``fit``."""

    def __init__(self, n: int, sums: list[int], values, vectors, trace: float, scale: int, shift: int):
        self.n, self.sums, self.trace = n, np.array(sums, dtype=object), trace
        self.scale, self.shift = scale, shift
        self.values, self.vectors = values, vectors
        self.identity_error = 0.0

    def centred(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, n * x - S) of a column's vectors that take part."""
        dim = len(self.sums)
        at, x = _vectors(column, self.scale, self.shift).get(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
        return at, _centred(x, self.n, self.sums)

    def project(self, d: np.ndarray) -> np.ndarray:
        return (d.astype(float) / self.n) @ self.vectors / np.sqrt(self.values)


def fit(
    rows: DataFrame, *, components: int = MOST_COMPONENTS, embedding: str = "embedding",
    scale: int = SCALE, shift: int = SHIFT,
) -> Whitener:
    """The whitener of all rows that take part.

    Components whose eigenvalue is nothing but rounding (constant or dependent
    dimensions, fewer rows than components) are left out.
    """
    n, sums = totals(rows, embedding, scale, shift)
    dim = len(sums)
    none = Whitener(n, sums, np.zeros(dim), np.eye(dim), 0.0, scale, shift)

    def covariance(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            d = none.centred(batch.column(0))[1].astype(float) / n
            total = d.T @ d if total is None else total + d.T @ d
        return total

    if not dim:
        return none
    v = summed(rows.select(embedding), dim, covariance) / n
    values, vectors = eigenvectors(v)
    real = values > dim * np.finfo(float).eps * values.max(initial=0.0)
    keep = np.flatnonzero(real)[:components]
    got = Whitener(n, sums, values[keep], vectors[:, keep], float(np.trace(v)), scale, shift)
    k = len(keep)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            y = got.project(got.centred(batch.column(0))[1])
            own = np.vstack([y.sum(axis=0), y.T @ y])
            total = own if total is None else total + own
        return total

    if k:
        # Projections of centred rows: their mean is zero but for rounding, and is taken off too.
        m = summed(rows.select(embedding), k, moments) / n
        spread = m[1:] - np.outer(m[0], m[0])
        got.identity_error = float(np.abs(spread - np.eye(k)).max())
    return got


def whitened(rows: DataFrame, model: Whitener, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per
    vector and component, components from 1 by falling eigenvalue.

    ``deviation``, a decimal, is the sum of (n * x - S) squared over the dimensions. Vectors
    that are null, empty, of another length than most, or hold a null or non-finite entry
    have no rows; a null vec_id stays null; rows that repeat count and come out each.
    """
    k = len(model.values)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, d = model.centred(batch.column(1))
            if not len(at) or not k:
                continue
            y = model.project(d)
            safe = d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 62
            squares = ((d if safe else d.astype(object)) ** 2).sum(axis=1)
            m = len(at) * k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(m, model.n)),
                    _decimals(squares).take(pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(y.reshape(-1)),
                    pa.array(np.tile(model.values / model.trace, len(at))),
                    pa.array(np.full(m, model.identity_error)),
                ],
                names=names,
            )

    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), embedding).mapInArrow(
        run,
        "vec_id long, component int, n long, deviation decimal(38,0), "
        "whitened double, explained double, identity_error double",
    )
