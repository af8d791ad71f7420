"""Helpers shared by the corpus operators: lineage cuts, text blocks, repeated-value search, components."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandgraph.operators.lineage import shared_folder

#: Words are runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


_released = 0.0


def release(spark: SparkSession, least_s: float = 4) -> None:
    """Let Spark delete the shuffle and checkpoint files of plans that are done with.

    Spark deletes them when the driver's JVM collects the plan; a short driver may never do so by itself while its
    executors' disks fill. The JVM hears of plans that Python has let go of from a queue that is emptied about once a
    second, so wait for that before its collection; and its event threads hold on to the last plan until the next one ends,
    so a plan of one row is run first. Nothing is done within ``least_s`` seconds of the last time.
    """
    global _released
    if time.monotonic() - _released > least_s:
        spark.range(0, 1, 1, 1).collect()
        gc.collect()
        queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
        until = time.monotonic() + 2
        while queue and time.monotonic() < until:
            time.sleep(0.05)
        time.sleep(0.05)
        spark.sparkContext._jvm.System.gc()
        _released = time.monotonic()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is ``spark.checkpoint.dir``. Where that is unset, a session in one JVM (tests) gets a folder of its own; on a
    cluster, whose executors wouldn't see it, that is an error.
    """
    release(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def pack_steps(a: np.ndarray) -> bytes:
    """Whole numbers as differences, their bytes grouped by significance, compressed: small where steps are small."""
    return pack(np.diff(a.astype(np.int64), prepend=0).view(np.uint8).reshape(-1, 8).T)


def unpack_steps(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpack(b, "uint8").reshape(8, -1).T).view(np.int64).ravel())


# --- hashing -----------------------------------------------------------------------------------------------------

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), elementwise."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def power(n: int) -> np.uint64:
    return _U(pow(_BASE, n, 1 << 64))


_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64, at least n; those for a usual block are kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, _U(base))
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 1 << 22:
        _powers[:] = made
    return made[0], made[1]


def running(values: np.ndarray) -> np.ndarray:
    """Sums of the values, each times a power for its place, up to and with each place: the difference of two of them, times
    the inverse power of the first place, is the hash of what lies between, wherever that is. ``values`` is overwritten."""
    values *= powers(len(values))[0][: len(values)]
    return np.cumsum(values, out=values)


def window_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """Polynomial fingerprint of buf[i:i+width] for each i; shorter than ``width``: empty."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = running(_BYTE[buf])
    out = total[width - 1 :].copy()
    out[1:] -= total[: n - 1]
    out *= powers(n)[1][:n]
    return out


# --- blocks of texts -----------------------------------------------------------------------------------------------

BLOCK_SCHEMA = "block long, ids array<long>, lens binary, body binary, n_bytes long"


def text_blocks(df: DataFrame, id_col: str, text_col: str, block_bytes: int = 1 << 21, carry: tuple[str, ...] = (), derive: Callable[[list[bytes]], list] | None = None, derived: str = "") -> DataFrame:
    """Pack whole documents into blocks of about ``block_bytes`` of UTF-8, written to the shared folder.

    The columns named in ``carry`` go along as an array of structs, ``rest``. ``derive`` gives further columns, ``derived``, of
    a block's texts, so that what is costly is worked out once.

    A document is never split. Null texts are empty, null ids stay null. As the blocks are a written table, a block
    holds the same documents however often it is read, so other tables can refer to (block, position in block).
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, texts, rest, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            lens = np.fromiter(map(len, texts), np.int64, len(texts))
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            more = [pa.array([x], f.type) for x, f in zip(derive(texts), more_fields, strict=True)] if derive else []
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | seq], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(lens)], pa.binary()), pa.array([body], pa.binary()), pa.array([size], pa.int64())]
                + more
                + [pa.array([rest], pa.list_(kept_type)) for _ in carry[:1]],
                names=["block", "ids", "lens", "body", "n_bytes", *(f.name for f in more_fields), *["rest"] * bool(carry)],
            )

        for batch in batches:
            others = batch.column(2) if carry else [None] * batch.num_rows
            kept_type = others.type if carry else None
            for i, t, other in zip(batch.column(0).to_pylist(), batch.column(1), others, strict=True):
                t = (t.as_py() or "").encode()
                ids.append(i)
                if carry:
                    rest.append(other.as_py())
                texts.append(t)
                size += len(t)
                if size >= block_bytes:
                    yield row()
                    seq, ids, texts, rest, size = seq + 1, [], [], [], 0
        if ids:
            yield row()

    others = [F.struct(*carry).alias("rest")] if carry else []
    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *others)
    schema = T.StructType.fromDDL(BLOCK_SCHEMA + (f", {derived}" if derived else ""))
    more_fields = list(to_arrow_schema(T.StructType.fromDDL(derived))) if derived else []
    if carry:
        schema = schema.add("rest", T.ArrayType(picked.schema["rest"].dataType))
    return cut(picked.mapInArrow(build, schema))


def open_block(lens: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's bytes, and the start and length of each of its documents."""
    size = unpack(lens, "int64")
    data = zstandard.ZstdDecompressor().decompress(body) if len(body) else b""
    return np.frombuffer(data, np.uint8), np.cumsum(size) - size, size


# --- values that several blocks have -------------------------------------------------------------------------------


def planes(a: np.ndarray) -> bytes:
    """Sorted integers as differences, their bytes grouped by significance, compressed."""
    d = np.diff(a, prepend=_U(0)).view(np.uint8).reshape(-1, 8)
    return pack(d.T)


def unplanes(b: bytes) -> np.ndarray:
    d = unpack(b, "uint8").reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(d).view(np.uint64).ravel(), dtype=np.uint64)


def bucket_slices(values: np.ndarray, n_buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) over sorted 64-bit values dealt by range; only buckets that have values."""
    width = (1 << 64) // n_buckets + 1
    edges = np.searchsorted(values, np.array([b * width for b in range(n_buckets)], np.uint64))
    ends = np.append(edges[1:], len(values))
    for b in np.flatnonzero(ends > edges):
        yield int(b), int(edges[b]), int(ends[b])


def shared_values(blocks: DataFrame, sorted_values: Callable[[dict], np.ndarray], n_values: int, bucket_values: int = 1 << 20) -> DataFrame:
    """Which of each block's values another block has too: (block, marks), marks an array of (bucket, bits).

    ``sorted_values(row)`` gives a block's distinct 64-bit values in order. The values are cut to as many bits as keep
    chance meetings near one in a thousand (so a mark may be wrong that often: it may only be used to leave out
    values that are *not* marked), dealt by range to buckets of about ``bucket_values``, and each bucket is sorted by
    itself. A block sends a value once, so a value that any number of documents share is one row item a block.
    """
    n_buckets = max(16, -(-n_values // bucket_values))
    bits = min(64, max(1, int(n_values).bit_length()) + 10)
    shift = _U(64 - bits)
    names = [f.name for f in blocks.schema.fields]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i].as_py() for j, k in enumerate(names)}
                values = sorted_values(row)
                out = [(b, row["block"], planes(values[s:e] >> shift)) for b, s, e in bucket_slices(values, n_buckets)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "body"])

    def meet(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        parts = [unplanes(b) for b in got["body"]]
        sizes = np.array([len(p) for p in parts])
        every = np.concatenate(parts)
        order = np.argsort(every)
        owner = np.repeat(np.arange(len(parts)), sizes)[order]
        ordered = every[order]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        several = np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)
        marked = np.empty(len(every), bool)
        marked[order] = np.repeat(several, np.diff(np.r_[start, len(every)]))
        cuts = np.cumsum(sizes)
        rows = [(int(k), int(key[0]), pack(np.packbits(m))) for k, m in zip(got["block"], np.split(marked, cuts[:-1]), strict=True)]
        return pd.DataFrame(rows, columns=["block", "bucket", "bits"])

    sent = blocks.mapInArrow(send, "bucket int, block long, body binary")
    met = sent.groupBy("bucket").applyInPandas(meet, "block long, bucket int, bits binary")
    return met.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))


def read_marks(values: np.ndarray, marks: list[dict] | None, n_values: int, bucket_values: int = 1 << 20) -> np.ndarray:
    """The marks of ``shared_values`` as one boolean for each of the block's sorted values."""
    n_buckets = max(16, -(-n_values // bucket_values))
    got = {m["bucket"]: m["bits"] for m in marks or []}
    out = np.zeros(len(values), bool)
    for b, s, e in bucket_slices(values, n_buckets):
        out[s:e] = np.unpackbits(unpack(got[b], "uint8"), count=e - s)
    return out


# --- connected components ------------------------------------------------------------------------------------------


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node of ``links`` with the smallest node reachable from it.

    Each round contracts the graph: of its closed neighbourhood a node takes the node that is least by the round's hash,
    then the least of what it and its neighbours took, and links go on between what their ends took. As the order is
    another one in every round, the nodes left are expected to shrink by a constant factor, whatever the shape, so
    rounds grow with the logarithm of the nodes. It ends when no link is left, never before. Every round is cut from its
    lineage.
    """
    edges = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    edges = edges.union(edges.select("other", "node")).distinct()
    # A node that is only linked to itself is a component, too.
    edges = cut(edges)
    taken = [edges.where("node = other").select("node", F.col("node").alias("to"))]
    edges = edges.where("node <> other")
    while not edges.isEmpty():
        order = lambda x: F.struct(F.xxhash64(x, F.lit(len(taken))).alias("key"), F.col(x).alias("id"))  # noqa: B023, E731
        near = edges.groupBy("node").agg(F.min(order("other")).alias("near")).select("node", F.least("near", order("node")).alias("near"))
        beside = near.withColumnsRenamed({"node": "other", "near": "beside"})
        far = edges.join(beside, "other").groupBy("node").agg(F.min("beside").alias("far"))
        step = cut(near.join(far, "node").select("node", F.least("near", "far")["id"].alias("to")))
        taken.append(step)
        one, two = step.withColumnRenamed("to", "x"), step.withColumnsRenamed({"node": "other", "to": "y"})
        edges = cut(edges.join(one, "node").join(two, "other").where("x <> y").select(F.col("x").alias("node"), F.col("y").alias("other")).distinct())
    # Back from the last round: what a node took stands for what that took later.
    found = None
    for k in range(len(taken) - 1, 0, -1):
        if found is None:
            found = taken[k].withColumnRenamed("to", "root")
            continue
        later = found.withColumnsRenamed({"node": "to", "root": "later"})
        found = cut(taken[k].join(later, "to", "left").select("node", F.coalesce("later", "to").alias("root")))
    alone = taken[0].withColumnRenamed("to", "root")
    found = alone if found is None else found.union(alone.join(found, "node", "left_anti"))
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return cut(found.join(least, "root").select("node", F.col("least").alias("root")))


# --- the first owner of a value ------------------------------------------------------------------------------------

NO_OWNER = np.iinfo(np.int64).max


def first_per_value(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, each with its least owner."""
    if not len(values):
        return values, owners
    order = np.argsort(values)
    v = values[order]
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    return v[start], np.minimum.reduceat(owners[order], start)


def _gathered(got: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many values each part of a bucket has, and the values and owners of all parts in turn."""
    parts = [unplanes(b) for b in got["body"]]
    owners = np.concatenate([np.ascontiguousarray(unpack(o, "uint8").reshape(8, -1).T).view(np.int64).ravel() for o in got["owners"]])
    return np.array([len(p) for p in parts]), np.concatenate(parts), owners


def least_owners(blocks: DataFrame, candidates: Callable[[dict], tuple[np.ndarray, np.ndarray]], n_values: int, bucket_values: int = 1 << 20, passes: int = 1, beaten_only: bool = False) -> DataFrame:
    """(block, least): for each value that a block offers, its least owner anywhere and whether this block has it.

    ``candidates(row)`` gives distinct sorted 64-bit values and an owner for each; ties between blocks go to the
    lower block. ``least`` is an array of (bucket, owners, here), to be read by ``read_least``. A block offers a value
    once, so hot values cost one item a block. With several ``passes`` the buckets are dealt to as many rounds, each
    written before the next begins, so that only one round's share of the values is on the disks at a time.

    With ``beaten_only`` the answer is one bit a value, whether another block has a smaller owner, and the result is
    (block, marks) for ``read_marks``: enough for a block that knows its own owners.
    """
    n_buckets = max(16, -(-n_values // bucket_values))
    names = [f.name for f in blocks.schema.fields]

    def send(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i].as_py() for j, k in enumerate(names)}
                values, owners = candidates(row)
                out = [(b, row["block"], planes(values[s:e]), pack(owners[s:e].view(np.uint8).reshape(-1, 8).T)) for b, s, e in bucket_slices(values, n_buckets) if b % passes == turn]
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "block", "body", "owners"])

    def meet(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        got = got.sort_values("block")
        sizes, every, owners = _gathered(got)
        part = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(every)
        ordered, owned, origin = every[order], owners[order], part[order]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        count = np.diff(np.r_[start, len(every)])
        smallest = np.repeat(np.minimum.reduceat(owned, start), count)
        origin = np.where(owned == smallest, origin, len(sizes))
        least, here = np.empty(len(every), np.int64), np.empty(len(every), bool)
        least[order] = smallest
        here[order] = (origin < len(sizes)) & (origin == np.repeat(np.minimum.reduceat(origin, start), count))
        cuts = np.cumsum(sizes)[:-1]
        rows = [(int(k), int(key[0]), pack(m.view(np.uint8).reshape(-1, 8).T), pack(np.packbits(h))) for k, m, h in zip(got["block"], np.split(least, cuts), np.split(here, cuts), strict=True)]
        return pd.DataFrame(rows, columns=["block", "bucket", "owners", "here"])

    def beat(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        sizes, every, owners = _gathered(got)
        order = np.argsort(every)
        ordered, owned = every[order], owners[order]
        start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        smallest = np.repeat(np.minimum.reduceat(owned, start), np.diff(np.r_[start, len(every)]))
        beaten = np.empty(len(every), bool)
        beaten[order] = smallest < owned
        rows = [(int(k), int(key[0]), pack(np.packbits(m))) for k, m in zip(got["block"], np.split(beaten, np.cumsum(sizes)[:-1]), strict=True)]
        return pd.DataFrame(rows, columns=["block", "bucket", "bits"])

    done = None
    for turn in range(passes):
        sent = blocks.mapInArrow(partial(send, turn=turn), "bucket int, block long, body binary, owners binary")
        by_bucket = sent.groupBy("bucket")
        met = by_bucket.applyInPandas(beat, "block long, bucket int, bits binary") if beaten_only else by_bucket.applyInPandas(meet, "block long, bucket int, owners binary, here binary")
        met = cut(met) if passes > 1 else met
        done = met if done is None else done.union(met)
    if beaten_only:
        return done.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))
    return done.groupBy("block").agg(F.collect_list(F.struct("bucket", "owners", "here")).alias("least"))


def read_least(values: np.ndarray, least: list[dict] | None, n_values: int, bucket_values: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(owners, here) for each of the values that the block offered to ``least_owners``."""
    n_buckets = max(16, -(-n_values // bucket_values))
    got = {m["bucket"]: m for m in least or []}
    owners, here = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    for b, s, e in bucket_slices(values, n_buckets):
        owners[s:e] = np.ascontiguousarray(unpack(got[b]["owners"], "uint8").reshape(8, -1).T).view(np.int64).ravel()
        here[s:e] = np.unpackbits(unpack(got[b]["here"], "uint8"), count=e - s)
    return owners, here


def block_rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(j)[i].as_py() for j, k in enumerate(names)}


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_bytes")).first()[0] or 0


def owner_ids(ids: list) -> np.ndarray:
    """Document ids as owners; null ids come after all others."""
    return np.array([NO_OWNER if i is None else i for i in ids], np.int64)
