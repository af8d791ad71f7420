"""Whitening of vectors by streamed moments.

Each partition's iterator keeps a running count, mean and sum of centred products, updated by one vector at a time (Welford's
rank-one updates); the states of partitions are merged by the parallel formula, a few of them a task and round, so neither a
task nor the driver holds more than ``FAN_IN`` states at once. The covariance's eigenvectors come from the symmetric QR
algorithm: reflections to tridiagonal form, then shifted rotations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.operators.lineage import cut

#: States that one task merges.
FAN_IN = 16
STATE = "dim int, part long, n long, mean binary, products binary, sums array<decimal(38,0)>"
LONG = np.iinfo(np.int64)


class Moments:
    """Count, mean and sum of centred products of vectors."""

    def __init__(self, dim: int) -> None:
        self.n, self.mean, self.products = 0, np.zeros(dim), np.zeros((dim, dim))

    def add(self, x: np.ndarray) -> None:
        """One vector: the mean moves by its share, the products by one outer product."""
        self.n += 1
        off = x - self.mean
        self.mean += off / self.n
        self.products += np.outer(off, x - self.mean)

    def merge(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        """The moments of both, from those of each."""
        total = self.n + n
        if not n:
            return
        off = mean - self.mean
        self.products += products + np.outer(off, off) * (self.n / total * n)
        self.mean += off * (n / total)
        self.n = total

    def covariance(self) -> np.ndarray:
        """With the count as divisor; as symmetric as it is meant."""
        c = self.products / self.n
        return (c + c.T) / 2


def exact_sums(x: np.ndarray) -> list[int]:
    """Of each column of whole numbers, without overflow."""
    if not len(x):
        return [0] * x.shape[1]
    most = max(abs(int(x.min())), abs(int(x.max())))
    return [int(s) for s in (x.sum(0) if most * len(x) <= LONG.max else x.astype(object).sum(0))]


def moments(vectors: DataFrame, column: str = "x", exact: bool = False) -> dict[int, tuple[Moments, list[int]]]:
    """Of an array column, for each length of vectors that occurs: the moments and, if ``exact``, the columns' sums of whole
    numbers (else zeros)."""
    kind = np.int64 if exact else np.float64

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[int, Moments] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for dim, _, rows in by_length(batch.column(0), kind):
                state = states.setdefault(dim, Moments(dim))
                for x in rows.astype(np.float64):
                    state.add(x)
                if exact:
                    sums[dim] = [a + b for a, b in zip(sums.get(dim, [0] * dim), exact_sums(rows), strict=True)]
        for dim, s in states.items():
            yield pa.RecordBatch.from_pandas(_state(dim, TaskContext.get().partitionId(), s, sums.get(dim, [0] * dim)), schema=_ARROW)

    def merge(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        state, sums = Moments(dim), [0] * dim
        for row in got.sort_values("part").itertuples():
            state.merge(row.n, np.frombuffer(row.mean), np.frombuffer(row.products).reshape(dim, dim))
            sums = [a + int(b) for a, b in zip(sums, row.sums, strict=True)]
        return _state(dim, int(got["part"].min()) // FAN_IN, state, sums)

    states, last = vectors.select(column).mapInArrow(stream, STATE), 1
    while last:  # the largest number of a state
        states = cut(states.groupBy("dim", F.floor(F.col("part") / FAN_IN).alias("few")).applyInPandas(merge, STATE))
        last = states.agg(F.max("part")).first()[0]
    found = {}
    for row in states.toLocalIterator():  # one state a length of vectors
        m = Moments(row.dim)
        m.merge(row.n, np.frombuffer(bytes(row.mean)), np.frombuffer(bytes(row.products)).reshape(row.dim, row.dim))
        found[row.dim] = m, [int(s) for s in row.sums]
    return found


_ARROW = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("products", pa.binary()), ("sums", pa.list_(pa.decimal128(38, 0)))])


def _state(dim: int, part: int, m: Moments, sums: list[int]) -> pd.DataFrame:
    from decimal import Decimal

    return pd.DataFrame([(dim, part, m.n, m.mean.tobytes(), m.products.tobytes(), [Decimal(s) for s in sums])], columns=_ARROW.names)


def by_length(column: pa.Array, kind: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, rows) of a list column without nulls: its vectors as matrices, one for each length but 0."""
    lengths = np.asarray(column.value_lengths())
    flat, ends = np.asarray(column.flatten()).astype(kind, copy=False), np.cumsum(lengths)
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        yield dim, at, flat[(ends[at] - dim)[:, None] + np.arange(dim)]


# --- eigenvectors ---------------------------------------------------------------------------------------------------


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as rows, each with its largest entry positive.

    Reflections bring it to tridiagonal form. Then, on the last block whose side entries aren't negligible, rotations chase a
    bulge from the first row down, begun with the shift of the last two rows, until that block's last side entry vanishes.
    """
    a, dim = np.array(a, np.float64), len(a)
    q = np.eye(dim)
    for k in range(dim - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if not norm or not np.any(v[1:]):
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    d, e = np.diag(a).copy(), np.diag(a, 1).copy()
    hi, eps = dim - 1, np.finfo(np.float64).eps
    for _ in range(60 * dim):
        while hi > 0 and abs(e[hi - 1]) <= eps * (abs(d[hi - 1]) + abs(d[hi])):
            e[hi - 1] = 0
            hi -= 1
        if hi <= 0:
            break
        lo = hi - 1
        while lo > 0 and abs(e[lo - 1]) > eps * (abs(d[lo - 1]) + abs(d[lo])):
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half or 1.0))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            p, t, w = d[k], e[k], d[k + 1]
            d[k], d[k + 1] = c * c * p + 2 * c * s * t + s * s * w, s * s * p - 2 * c * s * t + c * c * w
            e[k] = c * s * (w - p) + (c * c - s * s) * t
            x = e[k]
            if k + 1 < hi:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[[k, k + 1]] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    else:
        raise ArithmeticError("the rotations did not settle")
    order = np.argsort(-d, kind="stable")
    values, vectors = d[order], q[order]
    largest = vectors[np.arange(dim), np.abs(vectors).argmax(1)]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)[:, None]


# --- the operator ---------------------------------------------------------------------------------------------------


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each entry as long; null if the vector or an entry is null, or one isn't finite."""
    usable = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(usable, F.transform(vector, lambda c: F.floor(scale * c.cast("double")).cast("long")))


def whiten(df: DataFrame, vector_col: str, id_cols: tuple[str, ...] = ("vec_id",), components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each usable row of ``df`` and component: the id columns, ``component`` (from 1), ``n, deviation, whitened,
    explained, identity_error``.

    Rows whose vector is null or holds null or entries that aren't finite are left out. The others' entries become whole
    numbers, x = floor(scale * c) (beyond a long: its largest or smallest). The fit is over each distinct x once, n of them
    with column sums S; covariances have the divisor n. ``whitened`` is x - S / n on a unit eigenvector of x's covariance, over
    the root of its eigenvalue e; ``explained`` is e over the trace; ``deviation`` is the sum of (n x - S)^2, null if it is beyond a
    long; ``identity_error`` is the largest entry of the whitened fit's covariance less the identity, worked out from the whitened vectors.

    Components number at most ``components``, by falling e; one whose e is no more than rounding (as when all vectors are
    equal) can't be whitened and has no rows. Vectors of different lengths are fitted and whitened apart from each other;
    empty ones have no component. Equal rows and ids are rows of their own. Other columns aren't read.
    """
    rows = df.select(*(F.col(c).alias(f"id_{k}") for k, c in enumerate(id_cols)), whole_numbers(F.col(vector_col), scale).alias("x")).where("x IS NOT NULL")
    fit = cut(rows.select("x").distinct())
    models = {}
    for dim, (m, sums) in moments(fit, exact=True).items():
        values, vectors = symmetric_qr(m.covariance())
        trace = float(values.sum())
        good = int((values[:components] > max(values[0], 0) * dim * np.finfo(np.float64).eps * 8).sum())
        models[dim] = m.n, sums, values[:good], vectors[:good], trace

    def project(x: np.ndarray, model: tuple) -> tuple[np.ndarray, list[int | None]]:
        """The whitened rows, and the sum of squares of each."""
        n, sums, values, vectors, _ = model
        most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums), default=0)
        if most and len(sums) * most**2 <= LONG.max:
            off = n * x - np.array(sums, np.int64)
            deviation = (off**2).sum(1).tolist()
        else:
            off = n * x.astype(object) - np.array(sums, object)
            deviation = [s if s <= LONG.max else None for s in (off**2).sum(1).tolist()]
        return (off / n).astype(np.float64) @ vectors.T / np.sqrt(values), deviation

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in by_length(batch.column(0), np.int64):
                white, _ = project(x, models[dim])
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(x), pa.int32()), pa.array(list(white), pa.list_(pa.float64()))], names=["dim", "white"])

    white = fit.mapInArrow(fitted, "dim int, white array<double>")
    errors = {}
    for dim in models:  # one, unless vectors differ in length
        for k, (m, _) in moments(white.where(F.col("dim") == dim), "white").items():
            errors[dim] = float(np.abs(m.covariance() - np.eye(k)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in by_length(batch.column(batch.num_columns - 1), np.int64):
                n, _, values, _, trace = models[dim]
                white, deviation = project(x, models[dim])
                k = len(values)
                again = np.repeat(at, k)
                ids = [batch.column(i).take(pa.array(again)) for i in range(batch.num_columns - 1)]
                told = [
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array(np.full(len(again), n), pa.int64()),
                    pa.array([v for v in deviation for _ in range(k)], pa.int64()),
                    pa.array(white.ravel(), pa.float64()),
                    pa.array(np.tile(values / trace, len(x)) if k else [], pa.float64()),
                    pa.array(np.full(len(again), errors.get(dim, 0.0)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(ids + told, names=[f"id_{i}" for i in range(len(ids))] + ["component", "n", "deviation", "whitened", "explained", "identity_error"])

    types = ", ".join(f"id_{k} {df.select(c).schema[0].dataType.simpleString()}" for k, c in enumerate(id_cols))
    told = rows.mapInArrow(out, f"{types}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return told.withColumnsRenamed({f"id_{k}": c for k, c in enumerate(id_cols)})
