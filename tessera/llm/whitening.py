"""Whitening of embeddings: moments by Welford's updates, axes by a symmetric QR solver.

An entry c becomes the long floor(256 * c), so that equal vectors are equal bytes and sums are exact.  The fit
list holds each different vector once: the distinct rows are made by one shuffle of packed vectors, in which
copies collapse before they are sent.  Each partition then runs over its vectors and keeps count, exact sums,
mean and centred products by rank-one updates; a run ends after RUN vectors and is merged with earlier runs of
its size, so that rounding grows with the logarithm of the rows.  Partitions are merged in a tree by the same
formula for two parts.  What reaches the driver is one state a length and subtree, of the size of the
covariance, whatever the rows.

The covariance is brought to three diagonals by reflections and solved there by implicit QR steps with a shift.
A second pass over the fit list whitens it and takes the moments of that; their distance from the identity is
measured, not derived.

Defined results
    null vector, null or non-finite entry, empty vector, entry beyond a long    left out
    vectors of several lengths    each length is fitted and whitened by itself
    repeated rows                 each gets its rows; the fit list holds a vector once
    null vec_id                   kept, as null
    fewer than `components` axes  as many as there are
    axis without variance         whitened is null (nothing to scale by); not part of identity_error
    one vector only               explained and identity_error are null too
    empty table                   empty result
    deviation                     exact, as decimal text in `whiten`; of any size
    ties of eigenvalues           any basis of their space, the same for all rows
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, vectors

SCALE = 256
COMPONENTS = 4
RUN = 256


class Moments:
    """Count, exact sums, mean and centred products of vectors; the mean is kept as a distance from an origin of whole numbers."""

    def __init__(self, origin: np.ndarray) -> None:
        length = len(origin)
        self.n, self.total, self.origin = 0, [0] * length, origin
        self.mean, self.spread = np.zeros(length), np.zeros((length, length))

    def add(self, rows: np.ndarray) -> None:
        """Welford's step for one vector after the other."""
        away, product = np.empty_like(self.mean), np.empty_like(self.spread)
        safe = rows.dtype.kind == "f" or max(np.abs(rows).max(initial=0), np.abs(self.origin).max(initial=0)) < 2**62
        for row in (rows - self.origin if safe else rows.astype(np.float64) - self.origin).astype(np.float64):
            self.n += 1
            np.subtract(row, self.mean, out=away)
            np.multiply.outer(away * ((self.n - 1) / self.n), away, out=product)
            self.spread += product
            away /= self.n
            self.mean += away

    def sum_up(self, x: np.ndarray) -> None:
        """Exact sums of whole numbers, in pieces that a long holds."""
        step = max(1, (2**63 - 1) // (int(np.abs(x).max(initial=0)) or 1))
        for k in range(0, len(x), step):
            self.total = [a + b for a, b in zip(self.total, x[k : k + step].sum(axis=0).tolist())]

    def merge(self, other: Moments) -> Moments:
        """The moments of both parts together."""
        n = self.n + other.n
        if n:
            apart = other.mean - self.mean + np.array([b - a for a, b in zip(self.origin.tolist(), other.origin.tolist())], np.float64)
            self.spread += other.spread + np.multiply.outer(apart, apart) * (self.n * other.n / n)
            self.mean += apart * (other.n / n)
        self.n, self.total = n, [a + b for a, b in zip(self.total, other.total)]
        return self

    def covariance(self) -> np.ndarray:
        return (self.spread + self.spread.T) / (2 * self.n)


class Runs:
    """Moments of a stream: runs of RUN vectors, merged with their like as bits carry in a counter."""

    def __init__(self, origin: np.ndarray) -> None:
        self.done, self.open = [], Moments(origin)

    def add(self, rows: np.ndarray) -> None:
        k = 0
        while k < len(rows):
            take = min(RUN - self.open.n, len(rows) - k)
            self.open.add(rows[k : k + take])
            if rows.dtype.kind == "i":
                self.open.sum_up(rows[k : k + take])
            k += take
            if self.open.n == RUN:
                self.done.append(self.open)
                self.open = Moments(self.open.origin)
                while len(self.done) > 1 and self.done[-2].n <= self.done[-1].n:
                    self.done[-2:] = [self.done[-2].merge(self.done[-1])]

    def all(self) -> Moments:
        out = self.open
        for m in reversed(self.done):
            out = m.merge(out)
        return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, side diagonal and axes (rows) of a symmetric matrix, by reflections."""
    a, n = np.array(a, dtype=np.float64), len(a)
    axes = np.eye(n)
    for k in range(n - 2):
        u = a[k + 1 :, k].copy()
        size = float(np.linalg.norm(u))
        if not np.any(u[1:]):
            continue
        size = math.copysign(size, u[0])
        u[0] += size
        u /= np.linalg.norm(u)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ u
        w = 2.0 * (w - u * (u @ w))
        rest -= np.multiply.outer(u, w) + np.multiply.outer(w, u)
        a[k + 1 :, k] = a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = -size
        axes[k + 1 :] -= np.multiply.outer(2.0 * u, u @ axes[k + 1 :])
    return np.diag(a).copy(), np.diag(a, 1).copy(), axes


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix, by QR steps on its three diagonals."""
    d, e, axes = tridiagonal(a)
    tiny, last = np.finfo(np.float64).eps, len(d) - 1
    while last > 0:
        small = np.abs(e[:last]) <= tiny * (np.abs(d[:last]) + np.abs(d[1 : last + 1]))
        e[:last][small] = 0.0
        if small[-1]:
            last -= 1
            continue
        cuts = np.flatnonzero(small)
        first = int(cuts[-1]) + 1 if len(cuts) else 0
        half, side = (d[last - 1] - d[last]) / 2, e[last - 1]
        shift = d[last] - side * side / (half + math.copysign(math.hypot(half, side), half))
        x, z = d[first] - shift, e[first]
        for k in range(first, last):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                e[k - 1] = r
            p, q, o = d[k], d[k + 1], e[k]
            d[k] = c * c * p + 2 * c * s * o + s * s * q
            d[k + 1] = s * s * p - 2 * c * s * o + c * c * q
            e[k] = c * s * (q - p) + (c * c - s * s) * o
            if k + 1 < last:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            axes[k : k + 2] = np.array([[c, s], [-s, c]]) @ axes[k : k + 2]
    order = np.argsort(-d, kind="stable")
    return d[order], axes[order]


@dataclass
class Axes:
    """What whitens the vectors of one length."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def scaled(self, components: int) -> np.ndarray:
        """The first axes over the roots of their eigenvalues, as columns; NaN where an axis has no variance."""
        values = self.values[:components]
        has = values > len(self.values) * np.finfo(np.float64).eps * max(self.values[0], 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(has, self.vectors[:components].T / np.sqrt(np.where(has, values, 1.0)), np.nan)

    def away(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where they hold it, else Python's numbers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.total))
        if most * most * len(self.total) < 2**63:
            return self.n * x - np.array(self.total, np.int64)
        return self.n * x.astype(object) - np.array(self.total, object)

    def whitened(self, away: np.ndarray, components: int) -> np.ndarray:
        return (away / self.n).astype(np.float64) @ self.scaled(components)


def encoded(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x (packed) of the vectors that take part."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in vectors.matrices(batches):
            x = vectors.whole_numbers(rows, scale)
            if x is None:
                fits = (np.abs(rows) < 2.0**63 / scale).all(axis=1)
                ids, x = ids.filter(pa.array(fits)), vectors.whole_numbers(rows[fits], scale)
            if len(x):
                order, packed = vectors.pack(x)
                yield pa.record_batch([ids.take(pa.array(order)), pa.concat_arrays(packed)], ["vec_id", "x"])

    return vectors.id_and_vector(df).mapInArrow(run, "vec_id long, x binary")


def merged(parts: DataFrame) -> dict[int, Moments]:
    """All states (pickled, by length) of a table of them, merged in a tree."""

    def both(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
        return a | {k: a[k].merge(m) if k in a else m for k, m in b.items()}

    rdd = parts.rdd.map(lambda r: pickle.loads(bytes(r[0])))
    return rdd.treeAggregate({}, both, both, depth=2 if rdd.getNumPartitions() < 1000 else 3)


def moments(fit_list: DataFrame, axes: dict[int, Axes] | None = None, components: int = COMPONENTS) -> dict[int, Moments]:
    """Of the vectors of the fit list by length; with axes, of the whitened ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, Runs] = {}
        for batch in batches:
            for _, x in vectors.unpack(batch.column(0)):
                length = x.shape[1]
                rows = x if axes is None else axes[length].whitened(axes[length].away(x), components)
                if length not in runs:  # the first vector is the origin: what is summed is then of the size of the spread
                    runs[length] = Runs(x[0].copy() if axes is None else np.zeros(rows.shape[1]))
                runs[length].add(rows)
        if runs:
            yield pa.record_batch([pa.array([pickle.dumps({k: r.all() for k, r in runs.items()})], pa.binary())], ["state"])

    return merged(fit_list.mapInArrow(run, "state binary"))


def fit(df: DataFrame, scale: int = SCALE, components: int = COMPONENTS) -> dict[int, Axes]:
    """The axes of each length of vectors in df: vec_id and embedding."""
    fit_list = common.scratch_table(encoded(df, scale).select("x").distinct(), "fit-list")
    out = {}
    for length, m in moments(fit_list).items():
        covariance = m.covariance()
        out[length] = Axes(m.n, m.total, *eigen(covariance), float(np.trace(covariance)))
    for length, m in moments(fit_list, out, components).items() if out else ():
        has = np.isfinite(out[length].scaled(components)).all(axis=0)
        if has.any():
            out[length].identity_error = float(np.abs(m.covariance()[np.ix_(has, has)] - np.eye(int(has.sum()))).max())
    return out


def whiten(df: DataFrame, axes: dict[int, Axes], scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation (exact, as text), whitened, explained, identity_error: a row a vector and component."""
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.string()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in vectors.unpack(batch.column(1)):
                a = axes[x.shape[1]]
                away = a.away(x)
                white = a.whitened(away, components)
                rows, k = white.shape
                share = a.values[:k] / a.trace if a.trace > 0 else np.full(k, np.nan)
                each = lambda v: np.repeat(v, k)
                columns = [batch.column(0).take(pa.array(each(at))), np.tile(np.arange(1, k + 1), rows), np.full(rows * k, a.n), each(np.array([str(v) for v in (away * away).sum(axis=1)], object)), white.ravel(), np.tile(share, rows), [a.identity_error] * (rows * k)]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, schema)], schema=schema)

    return encoded(df, scale).mapInArrow(run, "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double")
