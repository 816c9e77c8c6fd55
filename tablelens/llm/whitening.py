"""Whitened principal components of embeddings: pivoted Cholesky, then one-sided Jacobi.

Entries become integers ``x = floor(64 c) + 1000000`` and the model is fitted on
the distinct x-vectors, once each:

1. one pass sums the vectors exactly (two limbs a sum, so no sum overflows);
2. one pass adds up products of ``z = x - round(mean)``, vectors centred to less
   than half a unit a dimension.  They are small integers, so float64 products
   and sums are exact whatever the order of tasks, as long as a sum stays below
   2 ** 53; the rest of the mean is taken off in exact integers;
3. the driver holds the d x d scatter only.  Pivoted Cholesky writes it as L L',
   stopping at its rank; one-sided Jacobi rotates pairs of columns of L until
   all are orthogonal.  Then the columns' squared norms are the eigenvalues and
   the normalised columns the components;
4. one pass over the fit list checks that the whitened covariance is the
   identity, one pass over all rows writes the result.

Vectors are shuffled once, to drop repeats, after partial aggregation (a vector
that a third of the rows share leaves each task once).  Tasks send sums: d
numbers, then d (d + 1) / 2; the fit list lies in few enough partitions that a
task sums ``LEAST_ROWS`` vectors or more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.worker import free, slices
from tablelens.session import materialize

SCALE, SHIFT = 64, 1_000_000  # fixed by the operator's contract
COMPONENTS = 16
LEAST_SHARE = 1e-12  # eigenvalues below this share of the largest one are rounding noise
SWEEPS = 60
LEAST_ROWS = 4096  # vectors of a task, lest its sums outnumber them
_MOST = float(1 << 62)
_LIMB = 31


@dataclass(frozen=True)
class Model:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit columns
    trace: float
    identity_error: float = 0.0

    @property
    def middle(self) -> np.ndarray:
        """Rounded means: integers that centre a vector without loss."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        """What ``n * (x - middle)`` still has to lose."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.middle)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        left = np.array([r / self.n for r in self.rest])
        return ((x - self.middle).astype(np.float64) - left) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n x - S)^2 as decimals of 38 digits; null beyond them."""
        z, rest = x - self.middle, self.rest
        most = self.n * float(np.abs(z).max(initial=0)) + max(map(abs, rest), default=0)
        if most * most * max(1, x.shape[1]) < 2.0**62:
            squares = (self.n * z - np.array(rest, np.int64)) ** 2
            return pa.array(squares.sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in z]
        return pa.array([v if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(__id, __v array<double>) without null vectors and vectors that hold null or non-finite entries."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where(v.isNotNull() & ~F.coalesce(odd, F.lit(True)))
    return rows.select(F.col(id_col).alias("__id"), v.cast("array<double>").alias("__v"))


def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """x-vectors, rows x dim; entries that a shorter vector lacks count as 0, extreme ones end at 2 ** 62."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = np.clip(flat, -_MOST, _MOST).astype(np.int64)
    return out + SHIFT


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def _fit_list(rows: DataFrame, dim: int) -> DataFrame:
    """Each distinct x-vector once, as bytes."""

    def run(batches):
        free()
        for batch in slices(batches):
            x = _integers(batch.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    fit = materialize(rows.select("__v").mapInArrow(run, "x binary").distinct())
    return fit.coalesce(max(1, -(-fit.count() // LEAST_ROWS)))


def _summed(fit: DataFrame, dim: int, make, empty: np.ndarray) -> np.ndarray:
    """The sum over all vectors of ``make(x)``, an array; tasks send one number an entry, added by partial aggregates."""
    kind, name = ("long", pa.int64()) if empty.dtype == np.int64 else ("double", pa.float64())

    def run(batches):
        total = empty.copy()
        for batch in slices(batches, 8192):
            total += make(_unpacked(batch.column(0), dim))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at], name)], names=["at", "s"])

    out = empty.copy()
    for r in fit.mapInArrow(run, f"at long, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (rows in the order of ``a``, one column a pivot) with ``L L' = a``; as many columns as ``a`` has rank."""
    d = len(a)
    left, order, out = a.astype(np.float64).copy(), list(range(d)), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(float(left.diagonal().max(initial=0.0)), 0.0)
    for k in range(d):
        pivot = max(order[k:], key=lambda i: left[i, i])
        if left[pivot, pivot] <= least:
            return out[:, :k]
        at = order.index(pivot)
        order[k], order[at] = order[at], order[k]
        rest = order[k + 1:]
        out[pivot, k] = np.sqrt(left[pivot, pivot])
        out[rest, k] = left[rest, pivot] / out[pivot, k]
        left[np.ix_(rest, rest)] -= np.outer(out[rest, k], out[rest, k])
    return out


def jacobi_columns(factor: np.ndarray) -> np.ndarray:
    """The columns of ``factor`` turned, pair by pair, until all are orthogonal to working precision.

    A sweep is a round-robin tournament, so the pairs of a round are disjoint and turn together.
    """
    w = factor.T.copy()
    n = len(w)
    seats = list(range(n + n % 2))
    eps = np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], seats[:half - 1:-1]) if max(p, q) < n]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            a, b, c = (w[p] ** 2).sum(axis=1), (w[q] ** 2).sum(axis=1), (w[p] * w[q]).sum(axis=1)
            turn = np.abs(c) > eps * np.sqrt(a) * np.sqrt(b)
            if not turn.any():
                continue
            turned = True
            p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
            zeta = (b - a) / (2 * c)
            tan = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = 1 / np.hypot(1.0, tan)
            sin = cos * tan
            w[p], w[q] = cos[:, None] * w[p] - sin[:, None] * w[q], sin[:, None] * w[p] + cos[:, None] * w[q]
        if not turned:
            break
    return w.T


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling positive eigenvalues of a symmetric positive semidefinite matrix and its unit eigenvectors
    (largest entry positive); what is rounding noise beside the largest is left out."""
    turned = jacobi_columns(pivoted_cholesky(scatter))
    norms = np.sqrt((turned**2).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] ** 2 > LEAST_SHARE * (norms.max(initial=0.0) ** 2)]
    vectors = turned[:, order] / norms[order]
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] if len(order) else np.ones(0)
    return norms[order] ** 2, vectors * np.sign(top)


def _fitted(rows: DataFrame, dim: int, components: int) -> Model | None:
    """The model, or None if there is no direction in which the vectors differ."""
    fit = _fit_list(rows, dim)

    def limbs(x):
        low = (x & ((1 << _LIMB) - 1)).sum(axis=0)
        return np.concatenate([[len(x)], low, (x >> _LIMB).sum(axis=0)])

    got = _summed(fit, dim, limbs, np.zeros(1 + 2 * dim, np.int64)).tolist()
    n, sums = got[0], [(h << _LIMB) + lo for lo, h in zip(got[1:dim + 1], got[dim + 1:])]
    if n < 2:
        return None
    blank = Model(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)
    middle, upper = blank.middle, np.triu_indices(dim)

    def products(x):
        z = (x - middle).astype(np.float64)
        return (z.T @ z)[upper]

    raw = _summed(fit, dim, products, np.zeros(len(upper[0])))
    scatter, rest = np.zeros((dim, dim)), blank.rest
    for i, j, s in zip(*upper, raw):
        scatter[i, j] = scatter[j, i] = (n * int(s) - rest[i] * rest[j]) / n
    values, vectors = eigen(scatter)
    if not len(values):
        return None
    k = min(components, len(values))
    model = Model(n, sums, values[:k] / n, vectors[:, :k], float(np.trace(scatter)) / n)

    def moments(x):
        w = model.whitened(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    got = _summed(fit, dim, moments, np.zeros(k + k * k)) / n
    found = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
    return Model(n, sums, model.values, model.vectors, model.trace, float(np.abs(found - np.eye(k)).max()))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null or holds a null or non-finite entry are left
    out; repeated rows, repeated and null ids stay, one result each.  A shorter
    vector's missing entries count as 0; entries beyond 2 ** 62 after scaling
    end there.  Components in which the vectors don't differ (at most 1e-12 of
    the largest eigenvalue) can't be whitened and have no rows: with one
    distinct vector, or none, the result is empty.  Other columns don't count.
    ``deviation`` is exact: a decimal of 38 digits, null beyond them.
    """
    rows = _usable(vectors, id_col, vector_col)
    kind = rows.schema["__id"].dataType.simpleString()
    dim = rows.agg(F.max(F.size("__v"))).first()[0] or 0
    model = _fitted(rows, dim, components) if dim else None

    def run(batches):
        free()
        for batch in slices(batches) if model else ():
            x = _integers(batch.column(1), dim)
            white, k = model.whitened(x), len(model.values)
            row = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), model.deviations(x).take(row),
                 pa.array(white.ravel()), pa.array(np.tile(model.values / model.trace, len(x)))],
                names=["__id", "component", "deviation", "whitened", "explained"])

    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    return rows.mapInArrow(run, f"__id {kind}, component int, deviation decimal(38,0), whitened double, explained double").select(
        F.col("__id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"))
