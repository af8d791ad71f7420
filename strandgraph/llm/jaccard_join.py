"""Exact Jaccard joins of n-gram sets by PartEnum signatures.

1. A shingle that one set alone has can't be common to two. Sets whose shared shingles can't reach the threshold have
   no partner and are done (``shared_values``; the marks only ever leave out what is certainly unshared).
2. Equal sets become one. Of each distinct set of the rest, the domain is dealt to first-level parts, and each of these to
   three second-level parts; a signature is what a set has in two of the three, so each first-level part gives the three
   subsets of two. Two sets within the threshold differ in at most k elements, so there are first-level parts in which they
   differ in one element at most, and there one subset at least is the same (``agreeing``). A set's signatures are those
   for the band of its size and, where a larger partner may be in the next band, for that too.
3. If two sets must agree in A of S signatures, the rarest that they share is among the S - A + 1 rarest of both, and
   only these are kept. Signatures that no other set has count towards these, so most sets keep none.
4. Sets that keep a signature in common are candidates and compared exactly, in three rounds; each leaves out what the
   links before it have joined. First a set meets a few sets of its two most common signatures, then a few of every
   signature, and last all that remain. So large groups of near copies are linked without all their pairs, and no
   link between components is missed.
5. In the last round the sets of a signature are dealt by how many elements no other set has: two sets differ in the
   sum of these at least, so sets with too many of their own, as those that only share a passage, never meet.
6. There each set also has a parity sketch: its elements are dealt to bits, a bit says whether their number is odd. Two
   sets differ in at least as many elements as their sketches differ in bits, so the join condition itself, on the JVM's
   side, leaves out nearly all pairs beyond the threshold before a row is made of them, and never one within it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import block_rows, components, cut, distinct, mix, open_block, power, powers, read_marks, release, running, shared_values, text_blocks, total_bytes, unpack

_U = np.uint64
#: Sizes of a band are within this ratio; first-level parts for each of the k elements that sets of a band may differ in
#: (more than a half are needed; the more, the more signatures must agree); second-level parts of each.
BAND, FIRST_PARTS, SECOND_PARTS = 1.25, 0.6, 3
HUBS = 4
#: Bits of a parity sketch for each element that two sets of a band may differ in, and at most.
SKETCH, SKETCH_BITS = 6, 4096
#: A hash for each byte, A-Z as a-z; whether a byte belongs to a word.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))
_BYTE[65:91] = _BYTE[97:123]
_INSIDE = np.ones(256, bool)
_INSIDE[[32, *range(9, 14)]] = False


def block_words(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of each word of a block in turn, and the words of each document.

    A-Z are lower-cased; words are runs of bytes other than space and 9 to 13. A word's hash is the difference of two sums
    over the block, brought back to the block's beginning.
    """
    buf, start, size = open_block(row["lens"], row["body"])
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(size), np.int64)
    if not len(buf):
        return none
    inside = _INSIDE[buf]
    first, last = start[size > 0], (start + size - 1)[size > 0]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[first] = inside[first]
    ends[:-1] &= ~inside[1:]
    ends[last] = inside[last]
    at, end = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(at):
        return none
    total = running(_BYTE[buf])
    h = total[end] - np.where(at > 0, total[at - 1], _U(0))
    filled = np.flatnonzero(size > 0)
    doc = filled[np.searchsorted(start[filled], at, "right") - 1]
    return doc, mix(h * powers(len(buf))[1][at]), np.bincount(doc, minlength=len(size))


def block_runs(row: dict, words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(document, hash) of each shingle of a block's documents, repeated ones too, in the order of the documents, and how
    many documents there are. A text with fewer words has the sequence of all of them as its only shingle; one without words has none."""
    d, h, n_words = block_words(row)
    n = len(h) - words + 1
    out_doc, out = d[:0], h[:0]
    if n > 0:
        run = np.zeros(n, np.uint64)
        for i in range(words):
            run *= power(1)
            run += h[i : i + n]
        whole = d[:n] == d[words - 1 :]
        out_doc, out = d[:n][whole], mix(run[whole])
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        first = np.cumsum(n_words) - n_words
        some = []
        for s in short:
            run = 1
            for x in h[first[s] : first[s] + n_words[s]]:
                run = (run * int(power(1)) + int(x)) & 0xFFFFFFFFFFFFFFFF
            some.append(run ^ int(n_words[s]))
        out_doc, out = np.concatenate([out_doc, short]), np.concatenate([out, mix(np.array(some, np.uint64))])
        order = np.argsort(out_doc, kind="stable")
        out_doc, out = out_doc[order], out[order]
    return out_doc, out, len(n_words)


def block_shingles(row: dict, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct shingles, ordered by both, and the documents' set sizes."""
    docs, hashes, n_docs = block_runs(row, words)
    count = np.bincount(docs, minlength=n_docs)
    if n_docs * 64 > len(docs):  # many short documents: one sort of all
        order = np.lexsort((hashes, docs))
        docs, hashes = docs[order], hashes[order]
    else:
        hashes = hashes.copy()
        end = 0
        for n in count.tolist():
            hashes[end : end + n].sort()
            end += n
    keep = np.r_[True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])] if len(docs) else np.empty(0, bool)
    docs, hashes = docs[keep], hashes[keep]
    return docs, hashes, np.bincount(docs, minlength=n_docs)


def need(total: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of two sets whose sizes add up to ``total``: 100 i >= percent (total - i)."""
    return -(-percent * total // (100 + percent))


def most_differing(n: np.ndarray, percent: int) -> np.ndarray:
    """The most elements in which a set of n differs from a partner, whatever the partner's size."""
    largest = n * 100 // percent
    total = n + largest
    return np.maximum(total - 2 * need(total, percent), 0)


def band_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(BAND) + 1e-9).astype(np.int64)


def first_parts(band: int, percent: int) -> int:
    """First-level parts of the domain for sets of a band and partners from the band below."""
    top = int(np.floor(BAND ** (band + 1))) + 1
    k = int(most_differing(np.array([top]), percent)[0])
    return int(np.ceil(FIRST_PARTS * k)) + 1


def agreeing(n_first: int, k: int) -> int:
    """The fewest signatures that two sets share which differ in at most k elements: a first difference in a first-level
    part takes two of its three subsets, a second one the third."""
    return max(0, 3 * n_first - 2 * min(k, n_first) - max(0, min(k - n_first, n_first)))


def signatures(elements: np.ndarray, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(band, signatures to keep, signatures) of a set, for its band and the next.

    A signature is the sum of the hashes of the elements in all but one second-level part of a first-level part, and which
    parts these are. Where these have no element it is one that many sets have, and so the last to be kept.
    """
    n = len(elements)
    k = int(most_differing(np.array([n]), percent)[0])
    own = int(band_of(np.array([n]))[0])
    found = []
    for band in (own, own + 1):
        if band > own and n * 100 // percent < int(np.ceil(BAND**band - 1e-9)):
            continue  # no partner is that large
        n_first = first_parts(band, percent)
        parts = n_first * SECOND_PARTS
        part = (mix(elements ^ _U(band)) % _U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        p, e = part[order], mix(elements[order] + _U(0x51ED270B))
        start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        sums = np.zeros(parts, np.uint64)
        sums[p[start]] = np.add.reduceat(e, start)
        whole = np.repeat(sums.reshape(n_first, SECOND_PARTS).sum(1, dtype=np.uint64), SECOND_PARTS)
        sigs = mix((whole - sums) + mix(np.arange(parts, dtype=np.uint64) * _U(4096) + _U(band)))
        found.append((band, parts - agreeing(n_first, k) + 1, sigs))
    return found


def parity_sketch(elements: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Of a power of two of bits, as many for all sets of a band, each the parity of the elements dealt to it."""
    top = int(np.floor(BAND ** (band + 1))) + 1
    wanted = SKETCH * int(most_differing(np.array([top]), percent)[0])
    n_bits = min(SKETCH_BITS, max(64, 1 << max(0, wanted - 1).bit_length()))
    odd = np.bincount((mix(elements ^ _U(0x2545F491)) % _U(n_bits)).astype(np.int64), minlength=n_bits) % 2
    return np.packbits(odd.astype(bool)).view(np.int64)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block_bytes: int = 1 << 21, key_col: str | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id``; with ``key_col``, also this column and ``linked``, a name
    that exactly the rows of one component have (null for rows that certainly have no partner).

    Documents link when 100 x intersection >= percent x union of their sets of word shingles; ``component_id`` is the
    smallest id reachable by links, the document's own included. Null and empty texts and texts without words have no
    set (size 0) and are linked with nothing: their component is their own id. Rows with equal ids are documents of their
    own with one id; a null id takes part and is smaller than none. Other columns aren't read. Sets are compared by
    64-bit hashes of their shingles.
    """
    blocks = text_blocks(df, id_col, text_col, block_bytes, (key_col,) if key_col else ())
    key_type = f", key {df.schema[key_col].dataType.simpleString()}" if key_col else ""
    arrow_type = to_arrow_type(df.schema[key_col].dataType) if key_col else None
    n_values = max(1, total_bytes(blocks) // 6)
    marks = cut(shared_values(blocks, lambda row: distinct(block_runs(row, words)[1]), n_values))
    marked = blocks.join(marks, "block", "left")
    names = marked.columns

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each document's size and place; and for those that may have a partner, what stands for the set."""
        for row in block_rows(batches, names):
            docs, hashes, sizes = block_shingles(row, words)
            values, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
            shared = read_marks(values, row["marks"], n_values) | (count > 1)
            common = np.bincount(docs, weights=shared[back], minlength=len(sizes)).astype(np.int64)
            may = (sizes > 0) & (100 * common >= percent * sizes)
            ends = np.cumsum(sizes)
            set_id = [None] * len(sizes)
            for d in np.flatnonzero(may):
                e = hashes[ends[d] - sizes[d] : ends[d]]
                set_id[d] = int(mix(np.array([np.add.reduce(mix(e + _U(77))) + _U(len(e))], np.uint64)).view(np.int64)[0])
            keys = [pa.array([r[key_col] for r in row["rest"]], arrow_type)] if key_col else []
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(set_id, pa.int64()), pa.array(sizes - common, pa.int64()), pa.array(np.full(n, row["block"]), pa.int64()), pa.array(np.arange(n), pa.int32()), *keys], names=["doc_id", "n_shingles", "set_id", "own", "block", "place", *["key"] * len(keys)])

    docs = cut(marked.mapInArrow(survivors, "doc_id long, n_shingles long, set_id long, own long, block long, place int" + key_type))
    # The elements of a set are written once, from one of its documents, right out of that document's block.
    first = docs.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.min("own").alias("own"), F.min_by("place", "block").alias("place"), F.min("block").alias("block"))
    chosen = first.groupBy("block").agg(F.collect_list(F.struct("place", "set_id", "least", "own")).alias("sets"))
    bodies = blocks.select("block", "lens", "body").join(chosen, "block")
    body_names = bodies.columns

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches, body_names):
            _, hashes, sizes = block_shingles(row, words)
            ends = np.cumsum(sizes)
            held = row["sets"]
            elements = [hashes[ends[s["place"]] - sizes[s["place"]] : ends[s["place"]]].tobytes() for s in held]
            yield pa.RecordBatch.from_arrays([pa.array([s["set_id"] for s in held], pa.int64()), pa.array(elements, pa.binary()), pa.array([s["least"] for s in held], pa.int64()), pa.array([s["own"] for s in held], pa.int64())], names=["set_id", "elements", "least", "own"])

    sets = cut(bodies.mapInArrow(contents, "set_id long, elements binary, least long, own long"))
    del blocks, marks, marked, first, chosen, bodies  # what they wrote isn't needed any more
    docs = docs.drop("own", "block", "place")
    found = cut(_linked_sets(sets, percent))
    roots = components(found).select(F.col("node").alias("set_id"), "root")
    labelled = sets.select("set_id", "least").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    labelled = labelled.join(least, "root").select("set_id", "component", "root")
    # A set has one row; documents that share a set may be many, so that side stays where it is or is split.
    joined = docs.join(labelled, "set_id", "left")
    release(df.sparkSession)
    keyed = [F.col("key").alias(key_col), F.col("root").alias("linked")] if key_col else []
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *keyed)


def _linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between distinct sets, enough to join whatever links would join."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for set_id, e in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for band, keep, sigs in signatures(np.frombuffer(e.as_py(), np.uint64), percent):
                    n = len(sigs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, set_id), pa.int64()), pa.array(np.full(n, band), pa.int32()), pa.array(np.full(n, keep - n), pa.int32()), pa.array(sigs.view(np.int64), pa.int64())], names=["set_id", "band", "spare", "sig"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for set_id, e in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                e = np.frombuffer(e.as_py(), np.uint64)
                own = int(band_of(np.array([len(e)]))[0])
                found = [parity_sketch(e, band, percent).tolist() for band in (own, own + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id] * 2, pa.int64()), pa.array([own, own + 1], pa.int32()), pa.array(found, pa.list_(pa.int64()))], names=["set_id", "band", "sketch"])

    signed = sets.select("set_id", "elements").mapInArrow(sign, "set_id long, band int, spare int, sig long")
    often = signed.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mine = signed.join(often, "sig").groupBy("set_id", "band", "spare").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("sigs"))
    # spare + size of the list: how many of the signatures that others have are among the rarest that must be kept.
    quota = F.col("spare") + F.size("sigs")
    # The rarest that must be kept; the last two of them are the most common.
    listed = mine.where(quota > 0).withColumn("sigs", F.slice("sigs", F.lit(1), quota))
    kept = listed.select("set_id", "band", F.posexplode("sigs").alias("at", "s"), F.size("sigs").alias("size"))
    sized = sets.select("set_id", "own", (F.octet_length("elements") / 8).cast("long").alias("n"))
    kept = cut(kept.select("set_id", "band", F.col("s.sig").alias("sig"), (F.col("at") >= F.col("size") - 2).alias("common")).join(sized, "set_id"))
    # Sets with the fewest elements of their own are likeliest to be within the threshold of others.
    order = Window.partitionBy("sig").orderBy("own", F.xxhash64("set_id"), "set_id")
    hubs = cut(kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS).select("sig", F.col("set_id").alias("hub"), F.col("own").alias("hub_own"), F.col("n").alias("hub_n")))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = kept.where("common").join(hubs, "sig").where((F.col("set_id") != F.col("hub")) & _may_link("own", "n", "hub_own", "hub_n", percent)).select(*pair("set_id", "hub")).distinct()
    links = cut(_verified(first, sets, percent))
    named, roots = _named(kept, links)
    hub_roots = hubs.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").withColumn("hub_root", F.coalesce("hub_root", "hub"))
    second = named.join(hub_roots, "sig").where((F.col("root") != F.col("hub_root")) & _may_link("own", "n", "hub_own", "hub_n", percent)).select(*pair("set_id", "hub")).distinct()
    links = cut(links.union(_verified(second, sets, percent)))
    named, _ = _named(kept, links)
    apart = named.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sig")
    # Room for elements of one's own in a band, in up to 8 steps.
    top = F.floor(F.pow(F.lit(BAND), F.col("band") + 1)) + 1
    room = F.floor(2 * top * (100 - percent) / (100 + percent))
    step = F.greatest(F.lit(1), F.ceil((room + 1) / 8))
    left = named.join(apart, "sig").withColumn("level", F.floor(F.col("own") / step).cast("int")).withColumn("most", F.floor(room / step).cast("int") - F.col("level"))
    left = cut(left.where("most >= 0"))
    sketches = sets.select("set_id", "elements").join(left.select("set_id").distinct(), "set_id", "left_semi").mapInArrow(sketch, "set_id long, band int, sketch array<long>")
    left = left.join(sketches, ["set_id", "band"])
    asks = left.select("sig", "set_id", "own", "n", "root", "sketch", F.explode(F.sequence(F.lit(0), "most")).alias("level"))
    other = left.select("sig", "level", F.col("set_id").alias("other"), F.col("root").alias("other_root"), F.col("own").alias("other_own"), F.col("n").alias("other_n"), F.col("sketch").alias("other_sketch"))
    met = (asks["sig"] == other["sig"]) & (asks["level"] == other["level"]) & (F.col("root") < F.col("other_root")) & _may_link("own", "n", "other_own", "other_n", percent)
    unlike = F.aggregate(F.zip_with("sketch", "other_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    met &= (100 + percent) * unlike <= (100 - percent) * (F.col("n") + F.col("other_n"))
    last = asks.join(other, met).select(*pair("set_id", "other")).distinct()
    return links.union(_verified(last, sets, percent))


def _may_link(own: str, n: str, other_own: str, other_n: str, percent: int) -> Column:
    """Whether sizes and unshared elements leave it possible that two sets are within the threshold."""
    sizes = 100 * F.least(n, other_n) >= percent * F.greatest(n, other_n)
    return sizes & ((100 + percent) * (F.col(own) + F.col(other_own)) <= (100 - percent) * (F.col(n) + F.col(other_n)))


def _named(kept: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept signatures with their sets' components so far, and these components."""
    roots = cut(components(links))
    return cut(kept.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))), roots


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are within the threshold, compared element by element."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    good.append(False)
                    continue
                common = len(x) + len(y) - len(distinct(np.concatenate([x, y])))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            chosen = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=["a", "b"])

    x = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("xs"))
    y = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("ys"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "xs", "ys").mapInArrow(compare, "a long, b long")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct([array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n, sh FROM g),
e AS (SELECT doc_id, n, md5(unnest(sh)) AS s FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a WHERE r.root < l.b)
SELECT n.doc_id, n.n AS n_shingles, (SELECT min(root) FROM r WHERE r.node = n.doc_id) AS component_id FROM n
"""
