"""Embedding whitening by FEAST contour integration.

Entries are made integers, x = floor(SCALE * c) + SHIFT. One pass sums floor(SCALE * c) and its products:
integers, so nothing is lost, and n * sum(x_i x_j) - S_i S_j is n squared times the covariance of the centred
entries to the last digit; it is divided once. The driver gets d * (d + 1) / 2 sums for vectors of d entries,
however many vectors there are.

The eigenvalues wanted are cut into intervals, at wide gaps, by inertia counts: the signs of the pivots of
V - s, of a tridiagonal matrix that is similar to it, tell how many eigenvalues lie below s. In each interval FEAST applies the quadrature of the contour
integral of (z - V)^-1, that is a few complex shifted solves, to a block of vectors; this projects onto the
interval's eigenvectors. Rayleigh-Ritz extracts them, the projection is repeated until residuals are at
rounding, and the number found inside must be the inertia count, or the interval is tried again with a
larger block.

A second pass sums the whitened products, which gives identity_error; a third gives the rows. Vectors of
different lengths are whitened apart, each length over its own rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
NODES, WIDEST, ROUNDS = 8, 12, 20
#: Of the matrix's norm: how closely borders are sought, and the least gap that separates two intervals.
TOLERANCE, GAP = 1e-10, 1e-7
ROWS = 2048
#: Whole numbers up to here are exact as doubles.
EXACT = 2**53
SEED = 12


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar matrix (Householder), whose inertia is that of v."""
    a = v.copy()
    for k in range(len(a) - 2):
        u = a[k + 1 :, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        size = np.linalg.norm(u)
        if not size:
            continue
        u /= size
        for part in (a[k + 1 :, k:], a.T[k + 1 :, k:]):
            part -= 2 * np.outer(u, u @ part)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each shift: negative pivots of matrix - shift."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off):
        pivot = d - shifts - e * e / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def brackets(diagonal: np.ndarray, off: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each eigenvalue, from the largest, by bisection of inertia counts."""
    d = len(diagonal)
    low, high, number = np.full(d, -top), np.full(d, top), np.arange(1, d + 1)
    while (high - low).max() > TOLERANCE * top:
        middle = (low + high) / 2
        over = d - inertia(diagonal, off, middle) >= number
        low, high = np.where(over, middle, low), np.where(over, high, middle)
    return low, high


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top, until `wanted` are covered.

    A border is put in the widest gap that leaves half of WIDEST to WIDEST in an interval; a cluster
    without a gap of GAP stays whole, however many it holds.
    """
    d, top = len(v), float(np.abs(v).sum(1).max()) * 1.01
    low, high = brackets(*tridiagonal(v), top)
    gaps = np.append(low[:-1] - high[1:], 2 * top)  # after each eigenvalue; the last is open
    out, border, done = [], top, 0
    while done < min(wanted, d):
        first = min(d, wanted) if done + WIDEST >= min(d, wanted) else done + WIDEST // 2
        last = max(first, min(d, done + WIDEST))
        cut = first + int(gaps[first - 1 : last].argmax())
        while gaps[cut - 1] <= GAP * top:
            cut += 1
        under = -top if cut == d else (low[cut - 1] + high[cut]) / 2
        out.append((under, border, cut - done))
        border, done = under, cut
    return out


def feast(v: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues in (low, high), `inside` of them by inertia, and unit eigenvectors."""
    d, size = len(v), float(np.abs(v).sum(1).max())
    x, w = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(0.5j * np.pi * (1 + x))  # the upper half; the lower one is its mirror
    inverse = [np.linalg.inv((middle + radius * t) * np.eye(d) - v) for t in turn]
    block = min(d, inside + max(4, inside // 2))
    while True:
        y = np.random.default_rng([SEED, block]).standard_normal((d, block))
        last = np.inf
        for _ in range(ROUNDS):
            q = sum(0.5 * wk * (radius * t * (inv @ y)).real for wk, t, inv in zip(w, turn, inverse))
            q = np.linalg.qr(np.linalg.qr(q)[0])[0]
            values, turned = np.linalg.eigh(q.T @ v @ q)
            y = q @ turned
            found = (values > low) & (values < high)
            residual = np.linalg.norm(v @ y[:, found] - y[:, found] * values[found], axis=0).max(initial=0)
            if found.sum() == inside and (residual <= 4e-16 * d**0.5 * size or residual > last / 2 and residual <= 1e-13 * size):
                return values[found], y[:, found]
            last = residual
        if block == d:
            raise ArithmeticError(f"{inside} eigenvalues lie between {low} and {high}, {int(found.sum())} were found")
        block = min(d, 2 * block)


def components(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and unit eigenvectors, the largest entry of each positive.

    Eigenvalues that are zero up to rounding have no component.
    """
    trace = float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    scaled = v / trace
    parts = [feast(scaled, *i) for i in intervals(scaled, wanted)]
    q = np.linalg.qr(np.concatenate([p[1] for p in parts], axis=1))[0]
    values, turned = np.linalg.eigh(q.T @ scaled @ q)
    order = np.argsort(-values, kind="stable")[: min(wanted, len(v))]
    values, vectors = values[order], q @ turned[:, order]
    real = values > len(v) * 1e-14
    values, vectors = values[real] * trace, vectors[:, real]
    largest = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])


@dataclass
class Whitening:
    """n vectors of d entries with sums S of x; V's eigenvalues and eigenvectors; trace of V."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of integer x."""
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers: as long where that can't overflow, else as Python's."""
        bound = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if bound < 2**62 else object
        return self.n * x.astype(kind) - np.array(self.sums, dtype=kind)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int]:
        y = self.scaled(x)
        small = y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * max(1, y.shape[1]) < 2**62
        return [int(s) for s in ((y if small else y.astype(object)) ** 2).sum(1)]


def usable(vector):
    """Not null, all entries finite; an empty vector has no component and goes too."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def whole(flat: np.ndarray, dims: int) -> np.ndarray:
    """floor(SCALE * c) of entries as doubles; beyond a long is an error."""
    x = np.floor(SCALE * np.asarray(flat, dtype=np.float64).reshape(-1, dims))
    if x.size and np.abs(x).max() >= 2.0**63 - SHIFT:
        raise OverflowError(f"an entry times {SCALE} is beyond a long")
    return x.astype(np.int64)


def parts(batches, column: int, dims: int):
    """(batch slice, floors) for at most ROWS rows at a time."""
    for big in batches:
        for k in range(0, big.num_rows, ROWS):
            b = big.slice(k, ROWS)
            yield b, whole(b.column(column).flatten().to_numpy(zero_copy_only=False), dims)


def products(x: np.ndarray) -> np.ndarray:
    """x' x in whole numbers."""
    most = int(np.abs(x).max(initial=0))
    if most * most * len(x) < EXACT:
        return np.rint(x.astype(np.float64).T @ x.astype(np.float64)).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def fit(rows: DataFrame, dims: int, wanted: int = COMPONENTS) -> Whitening:
    """The whitening of a table (uid, vector) of usable vectors of one length."""

    def run(batches):
        n, total, square = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for _, x in parts(batches, 0, dims):
            n, total, square = n + len(x), total + x.sum(0, dtype=object), square + products(x)
        if n:
            i, j = np.triu_indices(dims)
            ids = np.concatenate([[-1], np.arange(dims), dims + i * dims + j])
            digits = [str(s) for s in (n, *total, *square[i, j])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digits)], names=["id", "digits"])

    # a task gives d * (d + 3) / 2 + 1 rows, whatever its share; they are added before they get here
    partial = rows.select("vector").mapInArrow(run, "id long, digits string")
    got = dict(partial.groupBy("id").agg(F.sum(F.col("digits").cast("decimal(38,0)")).alias("s")).collect())
    n = int(got[-1])
    floors = [int(got[k]) for k in range(dims)]
    v = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            v[i, j] = v[j, i] = (n * int(got[dims + i * dims + j]) - floors[i] * floors[j]) / n**2
    values, vectors = components(v, wanted)
    return Whitening(n, [s + SHIFT * n for s in floors], values, vectors, float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry, absolute, of the whitened rows' covariance less the identity."""
    dims, k = model.vectors.shape

    def run(batches):
        total = np.zeros((k, k))
        for _, x in parts(batches, 0, dims):
            w = model.apply(x + SHIFT)
            total += w.T @ w  # their mean is zero: x is centred on the mean itself
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i * k + j, pa.int64()), pa.array(total[i, j])], names=["id", "s"])

    sums = rows.select("vector").mapInArrow(run, "id long, s double").groupBy("id").agg(F.sum("s").alias("s"))
    return max((abs(r["s"] / model.n - (r["id"] // k == r["id"] % k)) for r in sums.collect()), default=0.0)


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries go. Rows may repeat, and ids too.
    Components without variance are left out: one row, or equal rows, give none. Other columns of df play no part.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    # lengths are no more than entries of the longest vector
    lengths = sorted(r["dims"] for r in rows.select(F.size("vector").alias("dims")).distinct().collect())
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for dims in lengths:
        of = rows if len(lengths) == 1 else rows.filter(F.size("vector") == dims)
        model = fit(of, dims, wanted)
        error, k = identity_error(of, model), len(model.values)

        def run(batches, model=model, dims=dims, error=error, k=k):
            share = model.values / model.trace if k else model.values
            for b, x in parts(batches, 1, dims):
                x, m = x + SHIFT, len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array([s for s in model.deviation(x) for _ in range(k)], pa.int64()),
                        pa.array(model.apply(x).ravel() if k else np.zeros(0)),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

        made = of.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def op12_whitening(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
