"""Near copies by HyperMinHash: bands of compressed registers, an estimate with its collisions taken out, exact sets at last.

1. A shingle's hash is dealt to one of ``REGISTERS`` buckets by its first bits. Of the least hash of a bucket the register
   keeps how many zeros lead it and the ``MANTISSA`` bits after its first one: 16 bits.
2. Equal sets become one. Each band of ``ROWS`` registers is a signature; for an empty register stands the first filled one
   in an order that is fixed for its bucket, so sets of few shingles have as telling bands as others: a register agrees with
   the chance of the similarity. Sets at the threshold of 85 % agree in a band of five with a chance of 0.44, so 51 bands miss
   one such link in 1e13. Equal hashes give equal registers, so compressing them never loses a candidate.
3. Candidates of a signature are met in three rounds, each of which leaves out what earlier links have joined: a set and the
   set that is the first of most of its signatures; a set and the first of each of its signatures in some orders; and all
   that are still apart. So a large group of near copies is joined without its pairs. In the last round each set has a parity sketch: its
   shingles are dealt to bits, a bit says whether their number is odd. Two sets differ in at least as many shingles as their
   sketches differ in bits, so the join condition itself leaves out most pairs below the threshold and never one above.
4. A candidate's similarity is estimated from the registers, less those that agree by chance; what is six standard deviations
   below the threshold goes. The rest is compared by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_rows, components, cut, mix, text_blocks
from .jaccard_join import _verified, block_shingles

_U = np.uint64
#: Registers of a set, a power of two; bits kept after a hash's first one; registers of a band.
REGISTERS, MANTISSA, ROWS = 256, 10, 5
BANDS = REGISTERS // ROWS
#: Numbers whose exclusive or with a set's gives an order of the sets of a signature. Fixed values.
ORDERS = (0, -1, 0x5555555555555555, 0x3333333333333333)
#: Bits of a parity sketch. Standard deviations that an estimate may be off.
PARITY, SLACK = 1024, 6
_INDEX_BITS = REGISTERS.bit_length() - 1


def registers(docs: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """(document, bucket): the registers of documents' hashes, which are ordered by both. 0 is an empty bucket, else one more
    than the leading zeros (53 at most) and the mantissa."""
    out = np.zeros((n_docs, REGISTERS), np.uint16)
    if not len(docs):
        return out
    bucket = (hashes >> _U(64 - _INDEX_BITS)).astype(np.int64)
    key = docs * REGISTERS + bucket
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])  # in order, so the least of its bucket
    rest = (hashes[first] << _U(_INDEX_BITS)) >> _U(11)
    part, power = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest > 0, 53 - power, 53)
    mantissa = np.where(rest > 0, ((part - 0.5) * 2 ** (MANTISSA + 1)).astype(np.int64), 0)
    out[docs[first], bucket[first]] = (zeros << MANTISSA) + mantissa + 1
    return out


def probes(turn: int) -> np.ndarray:
    """For each bucket the one to look into at a turn, if all before it are empty."""
    place = np.arange(REGISTERS, dtype=np.uint64)
    return (mix(place + _U(1) + _U(turn * REGISTERS)) >> _U(64 - _INDEX_BITS)).astype(np.int64)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers of sets that aren't empty, where for each empty one stands the first filled one that its bucket looks into."""
    out, turn = regs.copy(), 0
    left = np.flatnonzero((regs == 0).any(1))
    while len(left):
        turn += 1
        some = out[left]
        out[left] = some = np.where(some == 0, regs[left][:, probes(turn)], some)
        left = left[(some == 0).any(1)]
    return out


def band_signatures(regs: np.ndarray) -> np.ndarray:
    """(set, band): the signature of each band."""
    some = filled(regs)[:, : BANDS * ROWS].astype(np.uint64)
    place = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
    return mix((mix(some + place) * (_U(2) * place + _U(1))).reshape(len(regs), BANDS, ROWS).sum(2, dtype=np.uint64)).view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely a register of two sets of n and m agrees though their least hashes differ. A cell that ``MANTISSA`` bits tell
    apart is as wide as a power of two below its place, on average 1 / (2 ln 2) of the place times 2^-MANTISSA; the two least
    hashes fall into one cell with the integral of both densities over these widths, n m / (n + m)^2 times that."""
    return 2.0**-MANTISSA / (2 * np.log(2)) * n * m / (n + m) ** 2.0


def estimated(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Jaccard similarity of sets of n and m, by their registers, and how many registers tell of it."""
    told = ((x > 0) | (y > 0)).sum(1)
    agree = ((x == y) & (x > 0)).sum(1) / np.maximum(told, 1)
    p = chance(n, m)
    return (agree - p) / (1 - p), told


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 85, block_bytes: int = 1 << 21) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Documents link when 100 x intersection >= percent x union of their sets of word shingles; ``component_id`` is the smallest
    id reachable by links, the document's own included, and ``kept`` says whether that is its own. Null and empty texts and
    texts without words have no set (size 0), are linked with nothing and kept. Rows with equal ids are documents of their
    own with one id, kept together; a null id takes part and is smaller than none. Other columns aren't read. Sets are
    compared by 64-bit hashes of their shingles. Candidates come from bands, so a link at 85 % is missed by a chance of 1e-13, a
    more alike one less often; beyond ``CROWD`` sets of a signature, 4e-12.
    """
    blocks = text_blocks(df, id_col, text_col, block_bytes)
    names = blocks.columns
    least_size = percent / (100 - percent) if percent < 100 else float("inf")  # the smallest set that links with another one

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches, names):
            docs, hashes, sizes = block_shingles(row, words)
            regs = registers(docs, hashes, len(sizes))
            total = np.r_[_U(0), np.cumsum(mix(hashes + _U(91)), dtype=np.uint64)]
            ends = np.cumsum(sizes)
            set_id = mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
            here = np.zeros(len(sizes), bool)
            here[np.unique(set_id, return_index=True)[1]] = True
            here &= sizes >= least_size
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(set_id, pa.int64(), mask=sizes == 0), pa.array(np.full(n, row["block"]), pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array([r.tobytes() if h else None for r, h in zip(regs, here, strict=True)], pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "block", "place", "registers"],
            )

    docs = cut(blocks.mapInArrow(sketch, "doc_id long, n_shingles long, set_id long, block long, place int, registers binary"))
    owned = docs.where("set_id IS NOT NULL")
    firsts = cut(owned.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("block").alias("block")))
    sets = cut(owned.where("registers IS NOT NULL").join(firsts, ["set_id", "block"]).select("set_id", F.col("n_shingles").alias("n"), "block", "place", "registers"))
    links = _links(sets, blocks, words, percent)
    roots = components(links).select(F.col("node").alias("set_id"), "root")
    labelled = firsts.select("set_id", "least").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    component = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = labelled.join(component, "root").select("set_id", "component_id")
    found = owned.select("doc_id", "n_shingles", "set_id").join(labelled, "set_id").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    found = found.union(docs.where("set_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _links(sets: DataFrame, blocks: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between distinct sets, enough to join whatever links would join."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sigs = band_signatures(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(sigs.ravel())], names=["set_id", "sig"])

    rows = sets.select("set_id", "registers").mapInArrow(sign, "set_id long, sig long").withColumn("root", F.col("set_id"))
    pair = (F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b"))
    links = roots = None
    for step in ("closest", "firsts", "all"):
        apart = rows.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), *(F.min(F.col("set_id").bitwiseXOR(F.lit(o))).alias(f"first_{k}") for k, o in enumerate(ORDERS))).where("low <> high")
        firsts = F.array(*(F.col(f"first_{k}").bitwiseXOR(F.lit(o)) for k, o in enumerate(ORDERS))).alias("firsts")
        rows = cut(rows.join(apart.select("sig", firsts), "sig"))
        if links is not None and rows.isEmpty():
            break
        met = rows.select("set_id", "root", (F.array(F.col("firsts")[0]) if step == "closest" else F.col("firsts")).alias("firsts"))
        met = met.select("set_id", "root", F.explode("firsts").alias("other")).where("set_id <> other")
        if step == "closest":
            met = met.groupBy("set_id", "other").agg(F.count("*").alias("shared")).groupBy("set_id").agg(F.max_by("other", F.struct("shared", "other")).alias("other"))
        elif step == "firsts":
            theirs = roots.select(F.col("node").alias("other"), F.col("root").alias("other_root"))
            met = met.select("set_id", "other", "root").distinct().join(theirs, "other", "left").where(F.col("root") != F.coalesce("other_root", "other"))
        whole = _elements(rows.select("set_id").distinct(), sets, blocks, words) if step == "all" else None
        if step == "all":
            met = _all_apart(rows, whole, percent)
        likely = cut(_likely(met.select(*pair).distinct(), sets, percent))
        whole = whole or _elements(likely.select(F.col("a").alias("set_id")).union(likely.select("b")).distinct(), sets, blocks, words)
        new = cut(_verified(likely, whole, percent))
        links = new if links is None else links.union(new)
        if step == "all":
            break
        roots = components(links)
        named = rows.select("set_id", "sig").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
        rows = cut(named.select("set_id", "sig", F.coalesce("root", "set_id").alias("root")))
    return links


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _all_apart(rows: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(set_id, other): sets of a signature that no link has joined so far, but for those too unlike in size or in bits."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for set_id, e in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                e = np.frombuffer(e.as_py(), np.uint64)
                odd = np.bincount((mix(e ^ _U(0x2545F491)) % _U(PARITY)).astype(np.int64), minlength=PARITY) % 2
                yield pa.RecordBatch.from_arrays([pa.array([set_id]), pa.array([len(e)]), pa.array([np.packbits(odd.astype(bool)).view(np.int64)], pa.list_(pa.int64()))], names=["set_id", "n", "bits"])

    told = whole.mapInArrow(sketch, "set_id long, n long, bits array<long>")
    told = told.select("set_id", "n", *(F.col("bits")[k].alias(f"b{k}") for k in range(PARITY // 64)))
    keys = cut(rows.select("sig", "set_id", "root").join(told, "set_id"))
    other = keys.select("sig", *(F.col(c).alias(f"other_{c}") for c in keys.columns if c != "sig"))
    differ = reduce(add, (F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"other_b{k}"))) for k in range(PARITY // 64)))
    close = (100 * F.least("n", "other_n") >= percent * F.greatest("n", "other_n")) & ((100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("other_n")))
    return keys.join(other, (keys["sig"] == other["sig"]) & (F.col("root") < F.col("other_root")) & close).select("set_id", F.col("other_set_id").alias("other"))


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and estimated similarity leave it possible that they are within the threshold."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(k).to_numpy().astype(np.float64) for k in (2, 3))
                similar, told = estimated(_matrix(batch.column(4)), _matrix(batch.column(5)), n, m)
                t = percent / 100
                good = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (similar >= t - SLACK * np.sqrt(t * (1 - t) / np.maximum(told, 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    one = lambda name, n, regs: sets.select(F.col("set_id").alias(name), F.col("n").alias(n), F.col("registers").alias(regs))
    both = pairs.join(one("a", "n", "x"), "a").join(one("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    return both.mapInArrow(estimate, "a long, b long")


def _elements(wanted: DataFrame, sets: DataFrame, blocks: DataFrame, words: int) -> DataFrame:
    """(set_id, elements): the whole sets of ``wanted`` (set_id), each out of the block of one of its documents."""
    chosen = sets.select("set_id", "block", "place").join(wanted, "set_id").groupBy("block").agg(F.collect_list(F.struct("place", "set_id")).alias("sets"))
    bodies = blocks.select("block", "lens", "body").join(chosen, "block")
    names = bodies.columns

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches, names):
            _, hashes, sizes = block_shingles(row, words)
            ends = np.cumsum(sizes)
            at = [s["place"] for s in row["sets"]]
            yield pa.RecordBatch.from_arrays([pa.array([s["set_id"] for s in row["sets"]], pa.int64()), pa.array([hashes[ends[p] - sizes[p] : ends[p]].tobytes() for p in at], pa.binary())], names=["set_id", "elements"])

    return cut(bodies.mapInArrow(contents, "set_id long, elements binary"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i+2], ' ') FOR i IN range(1, len(ws) - 1)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n, sh FROM g),
e AS (SELECT doc_id, n, md5(unnest(sh)) AS s FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a WHERE r.root < l.b)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(root) FROM r WHERE r.node = n.doc_id) AS component_id,
  n.doc_id = (SELECT min(root) FROM r WHERE r.node = n.doc_id) AS kept FROM n
"""
