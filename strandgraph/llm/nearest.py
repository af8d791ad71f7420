"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by three rounds of random signs and a fast Hadamard transform; its hash is the nearest signed axis.
``hashes`` of these make a bucket of a table. A query looks into its own bucket and those of the next nearest axes in every
table; what it finds there is ranked by exact distance. Equal vectors are one entry of the index with the smallest ids,
and a bucket with many entries is dealt to several tasks, each of which ranks its part. Queries that find fewer than are
due are ranked against all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix

TABLES, PROBES = 16, 8
#: Entries a bucket should have on average, which sets how many hashes make a bucket; entries of a bucket for one task.
OCCUPANCY, SHARD = 1024, 4096
#: Bytes of vectors of queries that are ranked against all vectors at a time.
EXACT_BYTES = 4 << 20


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, step = x.shape[1], 1
    x = x.copy()
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random rotation of the rows, padded to a power of two."""
    n = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for turn in range(3):
        signs = (mix(np.arange(n, dtype=np.uint64) + np.uint64((seed * 3 + turn + 1) << 32)) >> np.uint64(63)).astype(np.float64) * 2 - 1
        x = _hadamard(x * signs)
    return x


def buckets(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """For each row the numbers of its ``probes`` likeliest buckets in a table, the likeliest first."""
    unit = x / np.abs(x).max(1, keepdims=True)  # neither overflows nor vanishes when squared
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    axes, losses, n = [], [], 0
    for h in range(hashes):
        r = rotate(unit, table * hashes + h)
        both = np.concatenate([r, -r], 1)
        n = both.shape[1]
        few = min(n, probes)
        top = np.argsort(-both, axis=1, kind="stable")[:, :few]
        value = np.take_along_axis(both, top, 1)
        axes.append(top)
        losses.append((value[:, :1] - value) ** 2)
    if hashes == 1:
        return axes[0]
    few = [min(a.shape[1], max(2, round((4 * probes) ** (1 / hashes)))) for a in axes]
    combos = list(product(*map(range, few)))
    loss = np.stack([sum(losses[h][:, c[h]] for h in range(hashes)) for c in combos], 1)
    number = np.stack([sum(axes[h][:, c[h]].astype(np.int64) * n**h for h in range(hashes)) for c in combos], 1)
    best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(number, best, 1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _likely(y: np.ndarray, square: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of ``y`` that may be among the k nearest to ``x``, all ties included.

    |y|^2 - 2 xy orders rows as the distance does but for rounding; what can't be told apart by it from the k-th is kept.
    """
    if len(y) <= k:
        return np.arange(len(y))
    rough = square - 2 * (y @ x)
    blur = 4 * (len(x) + 4) * np.finfo(float).eps * (square.max() + x @ x)
    return np.flatnonzero(rough <= np.partition(rough, k - 1)[k - 1] + 2 * blur)


def distances(y: np.ndarray, rows: np.ndarray, x: np.ndarray, chunk: int = 1 << 16) -> np.ndarray:
    """Euclidean distances of rows of ``y`` from ``x`` by their differences, in chunks of bounded size."""
    step = max(1, chunk // max(1, len(x)))
    return np.concatenate([np.sqrt(((y[rows[a : a + step]] - x) ** 2).sum(1)) for a in range(0, len(rows), step)] or [np.empty(0)])


def nearest(df: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, tables: int = TABLES, probes: int = PROBES, occupancy: int = OCCUPANCY, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``queries`` holds for, its k nearest rows found.

    The score is the Euclidean distance in double precision, smallest first, ties to the smaller id; the row itself is
    left out. Null and zero vectors, and those with null or non-finite components, take no part, nor do rows with a null
    id; a query only meets vectors of its own length. Repeated rows count once. Fewer than k rows are returned only
    where there are fewer candidates: a query that finds fewer is ranked exactly against all. An empty table gives no rows.
    """
    wanted = F.coalesce(queries, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), wanted.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    same = Window.partitionBy("v").orderBy("vec_id")
    index = rows.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    index = cut(index.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = cut(rows.where("asks").select("vec_id", "v").distinct())
    distinct = asked.groupBy("v").agg(F.min("vec_id").alias("query"))
    n = index.count()
    dims = index.agg(F.max(F.size("v"))).first()[0] or 1
    axes = 2 << max(0, (dims - 1).bit_length())
    hashes = 1
    while n / axes**hashes > occupancy:
        hashes += 1
    entries = cut(_dealt(index, "ids array<long>", tables, hashes, 1))
    looks = _dealt(distinct, "query long", tables, hashes, probes * (2 * probes) ** (hashes - 1))
    at = ["dims", "table", "bucket"]
    hot = cut(entries.groupBy(*at).count().where(F.col("count") > shard).select(*at, F.ceil(F.col("count") / shard).cast("int").alias("shards")))
    shards = F.coalesce("shards", F.lit(1))
    entries = entries.join(hot, at, "left").withColumn("part", F.pmod(F.xxhash64("ids"), shards).cast("int"))
    looks = looks.join(hot, at, "left").withColumn("part", F.explode(F.sequence(F.lit(0), shards - 1)))

    def rank(key: tuple, asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(have):
            y = np.stack([np.frombuffer(b) for b in have["body"]])
            sizes = np.array([len(i) for i in have["ids"]])
            ids = np.concatenate(list(have["ids"]))
            square = (y * y).sum(1)
            for query, body in zip(asks["query"], asks["body"], strict=True):
                x = np.frombuffer(body)
                few = _likely(y, square, x, k + 1)
                exact = np.full(len(y), np.inf)
                exact[few] = distances(y, few, x)
                chosen = np.flatnonzero(np.repeat(np.isfinite(exact), sizes))
                score = np.repeat(exact, sizes)[chosen]
                best = np.lexsort((ids[chosen], score))[: k + 1]
                out += [(query, int(ids[chosen[b]]), float(score[b])) for b in best]
        return pd.DataFrame(out, columns=["query", "vec_id", "score"])

    by = [*at, "part"]
    found = looks.groupBy(*by).cogroup(entries.groupBy(*by)).applyInPandas(rank, "query long, vec_id long, score double").distinct()
    best = Window.partitionBy("query").orderBy("score", "vec_id")
    found = cut(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))
    # The query itself is among what is found and among the entries.
    due = index.groupBy(F.size("v").alias("dims")).agg(F.least(F.lit(k + 1), F.sum(F.size("ids"))).alias("due"))
    due = F.broadcast(cut(due))  # one row for each length of a vector
    got = found.groupBy("query").agg(F.count(F.lit(1)).alias("got"))
    short = distinct.withColumn("dims", F.size("v")).join(due, "dims").join(got, "query", "left").where(F.coalesce("got", F.lit(0)) < F.col("due"))
    short = cut(short.select("query", "v"))
    turns = -(-short.count() * dims * 8 // EXACT_BYTES)
    short = short.withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(max(1, turns))))
    found = found.join(short.select("query"), "query", "left_anti") if turns else found
    for turn in range(turns):
        asks = short.where(F.col("turn") == turn).select("query", "v").collect()  # about EXACT_BYTES
        found = cut(found.unionByName(index.select("ids", "v").mapInArrow(_ranked_all([(r["query"], np.array(r["v"])) for r in asks], k), "query long, vec_id long, score double")))
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    mine = asked.withColumnRenamed("vec_id", "query_id").join(distinct, "v").select("query_id", "query").join(found, "query").where("query_id <> vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranked_all(asks: list[tuple[int, np.ndarray]], k: int):
    """Ranks all entries of a task for each of the queries; the k + 1 best are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {q: (np.empty(0), np.empty(0, np.int64)) for q, _ in asks}
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(1)])
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                y = np.array(batch.column(1).take(pa.array(own)).to_pylist(), np.float64)
                held = batch.column(0).take(pa.array(own)).to_pylist()
                sizes, ids = np.array([len(i) for i in held]), np.concatenate([np.array(i, np.int64) for i in held])
                for q, x in asks:
                    if len(x) == d:
                        score = np.r_[best[q][0], np.repeat(distances(y, np.arange(len(y)), x), sizes)]
                        every = np.r_[best[q][1], ids]
                        top = np.lexsort((every, score))[: k + 1]
                        best[q] = score[top], every[top]
        for q, (score, ids) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["query", "vec_id", "score"])

    return run


def _dealt(df: DataFrame, carried: str, tables: int, hashes: int, probes: int) -> DataFrame:
    """A row for each table and bucket of each vector."""
    name, kind = carried.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1)
            lengths = np.array([len(v) for v in values])
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                x = np.array(values.take(pa.array(own)).to_pylist(), np.float64)
                carry = batch.column(0).take(pa.array(own))
                bodies = pa.array([r.tobytes() for r in x], pa.binary())
                for t in range(tables):
                    got = buckets(x, t, hashes, probes)
                    for p in range(got.shape[1]):
                        n = len(own)
                        yield pa.RecordBatch.from_arrays([carry, pa.array(np.full(n, d), pa.int32()), pa.array(np.full(n, t), pa.int32()), pa.array(got[:, p].astype(np.int64), pa.int64()), bodies], names=[name, "dims", "table", "bucket", "body"])

    return df.select(name, "v").mapInArrow(run, f"{name} {kind}, dims int, table int, bucket long, body binary")
