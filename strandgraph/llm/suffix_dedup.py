"""Exact substring removal over the suffixes of all documents, one bucket at a time.

The suffixes are those that start at any byte, compared to a fixed depth. Positions whose place in their document is in a difference
cover modulo 31 are sampled: for any two positions there is a shift below 31 that puts both in the cover. So two equal
50-byte strings have a pair of equal sampled 20-byte strings at the same shift, and a suffix without a sample that
another document shares within its first 31 bytes can't tie with one of another document to depth 50. Sampled strings are
ranked first, bucket by bucket (here a rank only says whether another document has the string); only the suffixes
that the ranks leave open are then dealt to buckets and sorted there, one bucket in memory at a time, to depth 50.
Buckets are ranges of 64-bit fingerprints rather than of leading bytes, so that common prefixes can't make a bucket
large, and long ties are resolved by one comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_rows, cut, distinct, first_per_value, least_owners, mix, open_block, owner_ids, read_marks, release, shared_values, text_blocks, total_bytes, window_hashes

#: A perfect difference set: every residue modulo 31 is a difference of two members. Fixed values.
COVER, MODULUS = (1, 5, 11, 24, 25, 27), 31
#: Rounds that the open suffixes' buckets are dealt to, one after the other.
PASSES = 3


class Block:
    """The suffixes of one block's documents."""

    def __init__(self, row: dict, depth: int) -> None:
        self.buf, self.start, self.size = open_block(row["lens"], row["body"])
        self.owner = owner_ids(row["ids"])
        self.filled = np.flatnonzero(self.size > 0)
        self.depth, self.reach = depth, depth - MODULUS + 1

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        """The document that each position is in."""
        return self.filled[np.searchsorted(self.start[self.filled], at, "right") - 1]

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions, their documents, and the fingerprints of the bytes there that any match of full depth has."""
        cover = np.array(COVER)
        # How many samples each document has for each member of the cover.
        counts = np.maximum((self.size[:, None] - self.reach - cover) // MODULUS + 1, 0)
        total = int(counts.sum())
        if not total:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        flat = counts.ravel()
        turn = np.arange(total) - np.repeat(np.cumsum(flat) - flat, flat)
        at = np.repeat((self.start[:, None] + cover).ravel(), flat) + turn * MODULUS
        doc = np.repeat(np.repeat(np.arange(len(self.size)), len(cover)), flat)
        return at, doc, mix(window_hashes(self.buf, self.reach)[at])

    def open_suffixes(self, marks: list[dict] | None, n_samples: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and fingerprints of the suffixes that may tie with one of another document."""
        at, doc, prints = self.samples()
        if not len(at):
            return at, prints
        order = np.argsort(prints)
        ordered, docs = prints[order], doc[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        several = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
        marked = read_marks(ordered[first], marks, n_samples) | several
        n = len(self.buf)
        hit = np.zeros(n + MODULUS + 1, np.int32)
        hit[at[order[np.repeat(marked, np.diff(np.r_[first, len(ordered)]))]] + 1] = 1
        total = np.cumsum(hit, dtype=np.int32)
        near = np.flatnonzero(total[MODULUS : n + MODULUS] > total[:n])
        doc = self.doc_of(near)
        near = near[(self.start + self.size)[doc] - near >= self.depth]
        return near, mix(window_hashes(self.buf, self.depth)[near]) if len(near) else np.empty(0, np.uint64)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50, with_text: bool = False, block_bytes: int = 1 << 21) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (binary).

    A byte is removed if a string of ``depth`` bytes that covers it also starts in a document with a smaller id.
    Strings are those of the input and stay within a document; matches may overlap. A null text is empty (nothing to
    remove, the hash of no bytes); texts shorter than ``depth`` stay whole. Rows with equal ids don't remove from each
    other, a null id counts as larger than any. Strings are compared by 64-bit fingerprints. Other columns aren't
    read.
    """
    if depth < MODULUS + 8:
        raise ValueError(f"depth must be at least {MODULUS + 8}")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text")).withColumn("key2", F.xxhash64(F.lit(1), "text"))
    # A text that several documents are is looked at once, for the smallest id: the others lose all they have.
    first = docs.groupBy("key", "key2").agg(F.min("doc_id").alias("least_id"), F.first("text").alias("text"))
    blocks = text_blocks(first, "least_id", "text", block_bytes, ("key", "key2"))
    n_bytes = total_bytes(blocks)
    n_samples, n_open = n_bytes * len(COVER) // MODULUS, n_bytes // 4
    bodies = blocks.select("block", "ids", "lens", "body")
    marks = shared_values(bodies, lambda row: distinct(Block(row, depth).samples()[2]), n_samples)
    # Written with its marks, a block isn't dealt anew in each round.
    marked = cut(blocks.drop("n_bytes").join(marks, "block", "left"))
    del blocks, bodies, marks

    def offered(row: dict) -> tuple[np.ndarray, np.ndarray]:
        b = Block(row, depth)
        at, prints = b.open_suffixes(row["marks"], n_samples)
        return first_per_value(prints, b.owner[b.doc_of(at)])

    beaten = least_owners(marked.drop("rest"), offered, n_open, passes=PASSES, beaten_only=True).withColumnRenamed("marks", "beaten")
    release(df.sparkSession, 0)
    whole = marked.join(beaten, "block", "left")
    names = whole.columns

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches, names):
            b = Block(row, depth)
            at, prints = b.open_suffixes(row["marks"], n_samples)
            owner = b.owner[b.doc_of(at)]
            values, first = first_per_value(prints, owner)
            back = np.searchsorted(values, prints)
            # What another block has for a smaller id goes; of the rest, what isn't the smallest id's here.
            gone = at[read_marks(values, row["beaten"], n_open)[back] | (first[back] < owner)]
            # Distinct positions: a byte is covered if one of the last ``depth`` positions goes.
            begins = np.zeros(len(b.buf) + 1, np.int32)
            begins[gone + 1] = 1
            total = np.cumsum(begins)
            covered = total[1:] > np.r_[np.zeros(min(depth, len(b.buf)), np.int32), total[1 : max(1, len(b.buf) - depth + 1)]]
            n_removed, n_spans, digests, kept = [], [], [], []
            for s, n in zip(b.start, b.size, strict=True):
                c = covered[s : s + n]
                n_removed.append(int(c.sum()))
                n_spans.append(int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()))
                rest = b.buf[s : s + n][~c].tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            keys = [pa.array([r[k] for r in row["rest"]], pa.int64()) for k in ("key", "key2")]
            out = [*keys, pa.array(row["ids"], pa.int64()), pa.array(b.size, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * with_text, names=["key", "key2", "least_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    struck = whole.mapInArrow(strike, "key long, key2 long, least_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    out = docs.select("doc_id", "key", "key2").join(struck, ["key", "key2"])
    copy = ~F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("n_bytes") >= depth)
    gone = [
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    kept = [F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] * with_text
    return out.select("doc_id", "n_bytes", *gone, *kept)
