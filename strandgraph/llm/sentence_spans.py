"""Substring dedup by sliding spans of sentences.

A text is cut into sentences. Only those of more than LONG words are cut further, into clauses and, where these are long,
after the word of the least hash of every few, so that a passage is cut alike in whatever text it stands; such a piece then
counts as a sentence. Scripts without spaces are measured by characters. From every sentence on, the shortest run of at
least ``min_sentences`` sentences and ``min_words`` words is hashed. A run that stands anywhere before, in the order of ids, places
and texts, is a repeat; a sentence that some repeated run covers is removed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import block_rows, cut, distinct, least_owners, mix, open_block, owner_ids, pack, pack_steps, read_least, read_marks, release, shared_values, text_blocks, unpack, unpack_steps

MIN_SENTENCES, MIN_WORDS = 3, 20
#: A sentence of more words is cut further, into clauses, and a clause of more words after the word of the least crc32 in each window of WINDOW words. Wherever a
#: passage begins and ends, at most its first 2 WINDOW - 1 words are cut otherwise, then cuts are at most WINDOW words apart;
#: so with WINDOW 7 and whole sentences of up to LONG words, each passage of 50 words has a whole run.
LONG, WINDOW = 12, 7
#: Ends of sentences and of clauses, also those of other scripts.
_ENDS, _BREAKS = ".!?\n。！？．｡…।॥؟۔։።፧༎။។៕", ",;:、，；：､،؛፣፤፥፦།၊"
_SENTENCES = re.compile(rf"[^{_ENDS}]*[{_ENDS}]+\s*|[^{_ENDS}]+")
_CLAUSES = re.compile(rf"[^{_BREAKS}]*[{_BREAKS}]+\s*|[^{_BREAKS}]+")
_WORDS = re.compile(r"\S+\s*")
#: Scripts without spaces: two Chinese or Japanese characters, or four of Thai, Lao, Tibetan, Burmese or Khmer, are a word.
_PAIRED, _FOURS = "\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff", "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff"
_UNSPACED = re.compile(f"[{_PAIRED}{_FOURS}]")
_UNITS = re.compile(rf"([{_PAIRED}])\s*|([{_FOURS}])\s*|[^\s{_PAIRED}{_FOURS}]+\s*")


def units(piece: str, spaced: bool) -> tuple[list[str], list[float]]:
    """What a piece can be cut after, with the white space behind, and how many words each is."""
    if spaced:
        found = _WORDS.findall(piece)
        return found, [1] * len(found)
    found = list(_UNITS.finditer(piece))
    return [m.group() for m in found], [0.5 if m.group(1) else 0.25 if m.group(2) else 1 for m in found]


def chosen(keys: list[int], sizes: list[float]) -> list[int]:
    """The places of the least key of each window of WINDOW words, of equal ones the last."""
    found, at, low, held = [], -1, 0, 0
    whole = False
    for i, key in enumerate(keys):
        held += sizes[i]
        while held > WINDOW:
            held -= sizes[low]
            low += 1
        whole = whole or low > 0 or held == WINDOW
        if at < low:
            at = low
            for j in range(low + 1, i + 1):
                if keys[j] <= keys[at]:
                    at = j
        elif key <= keys[at]:
            at = i
        if whole and (not found or found[-1] != at):
            found.append(at)
    return found


def sentences(text: str) -> tuple[list[str], list[float]]:
    """The pieces of a text, which joined give the text, and their words (quarters of words in scripts without spaces)."""
    pieces, words = [], []
    spaced = text.isascii() or not _UNSPACED.search(text)
    size = lambda p: len(p.split()) if spaced else sum(units(p, False)[1])
    clauses: list[str] = []
    for p in _SENTENCES.findall(text):
        if size(p) <= LONG:
            clauses.append(p)
        else:
            clauses += _CLAUSES.findall(p)
    for p in clauses:
        n = size(p)
        if n <= LONG:
            pieces.append(p)
            words.append(n)
            continue
        lead = len(p) - len(p.lstrip())
        each, sizes = units(p[lead:], spaced)
        begin, head = 0, p[:lead]
        for end in [*(c + 1 for c in chosen([zlib.crc32(w.strip().lower().encode()) for w in each], sizes)), len(each)]:
            if end > begin:
                pieces.append(head + "".join(each[begin:end]))
                words.append(sum(sizes[begin:end]))
                begin, head = end, ""
    return pieces, words


def spans(pieces: list[str], words: list[float], min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and end sentence of the shortest sufficient run from each sentence on. Case and the white space
    around sentences don't matter; sentences without words are passed over."""
    full = np.flatnonzero(np.array(words, np.float64) > 0)
    n = len(full)
    if n < min_sentences:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.fromiter((xxhash.xxh64_intdigest(pieces[i].strip().lower().encode()) for i in full), np.uint64, n)
    total = np.r_[0, np.cumsum(np.array(words, np.float64)[full])]
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words), np.arange(n) + min_sentences)
    at = np.flatnonzero(end <= n)
    end = end[at]
    # A run's hash: the sum of its sentences' hashes, each multiplied by a power for its place.
    powers = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))
    inverse = np.cumprod(np.full(n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
    run = np.r_[np.uint64(0), np.cumsum(mix(h) * powers, dtype=np.uint64)]
    prints = mix((run[end] - run[at]) * inverse[at] + (end - at).astype(np.uint64))
    return prints, full[at], full[end - 1] + 1


def taken_apart(texts: list[bytes], min_sentences: int, min_words: int) -> list:
    """A block's runs and pieces, packed: see DERIVED."""
    counts, sizes, all_words, found = [], [], [], []
    for d, text in enumerate(texts):
        pieces, words = sentences(text.decode())
        counts.append(len(pieces))
        sizes += map(len, pieces) if text.isascii() else [len(p.encode()) for p in pieces]
        all_words += words
        prints, first, end = spans(pieces, words, min_sentences, min_words)
        found.append((prints, np.full(len(prints), d), first, end))
    prints, doc, first, end = (np.concatenate([f[i] for f in found]) for i in range(4))
    quarters = np.rint(np.array(all_words, np.float64) * 4)
    return [len(prints), pack(prints.astype(np.uint64)), *(pack_steps(np.array(x)) for x in (counts, sizes, doc, first, end - first, quarters))]


#: Runs of a block and their hashes; pieces of each document and their bytes; documents, first pieces and lengths of the runs;
#: quarters of words of the pieces.
DERIVED = "n_runs long, prints binary, counts binary, sizes binary, run_doc binary, run_first binary, run_length binary, words binary"


class Block:
    """A block's runs: their hashes, documents, first and end pieces."""

    def __init__(self, row: dict) -> None:
        self.prints = unpack(row["prints"], "uint64")
        self.doc, self.first, length = (unpack_steps(row[k]) for k in ("run_doc", "run_first", "run_length"))
        self.end = self.first + length
        self.owner = owner_ids(row["ids"])
        # The order of rows with equal ids within a block is that of their places.
        self.place = np.empty(len(self.owner), np.int64)
        self.place[np.argsort(self.owner, kind="stable")] = np.arange(len(self.owner))

    def firsts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct values; for each run its value's number; for each value the run of the block that is first."""
        values, back = np.unique(self.prints, return_inverse=True)
        order = np.lexsort((self.first, self.place[self.doc], back)) if len(back) else np.empty(0, np.int64)
        lead = order[np.r_[True, back[order][1:] != back[order][:-1]]] if len(back) else order
        return values, back, lead


def remove_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, block_bytes: int = 1 << 21, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``doc_id, n_sentences, n_removed, n_words_removed, kept`` (the text without the removed sentences),
    and a struct ``rest`` of the columns named in ``carry``, if any.

    A null text counts as empty; texts with fewer than ``min_sentences`` sentences or ``min_words`` words
    stay whole. The first of several equal runs is that of the smallest id (null ids last), then of the earlier row
    in the written blocks, then of the earlier sentence; runs may repeat within one document and overlap. Repeated
    rows lose everything that a run covers but in their first. Other columns aren't read.
    """
    derive = lambda texts: taken_apart(texts, min_sentences, min_words)
    blocks = text_blocks(df, id_col, text_col, block_bytes, carry, derive, DERIVED)
    n_values = max(1, blocks.agg(F.sum("n_runs")).first()[0] or 0)
    marks = cut(shared_values(blocks.select("block", "prints"), lambda row: distinct(unpack(row["prints"], "uint64")), n_values))

    def offered(row: dict) -> tuple[np.ndarray, np.ndarray]:
        b = Block(row)
        values, _, lead = b.firsts()
        shared = read_marks(values, row["marks"], n_values)
        return values[shared], b.owner[b.doc[lead]][shared]

    runs = blocks.select("block", "ids", "prints", "run_doc", "run_first", "run_length")
    least = cut(least_owners(runs.join(marks, "block", "left"), offered, n_values))
    told = blocks.drop("n_bytes", "n_runs", "lens", "body", "rest").join(marks.join(least, "block", "left"), "block", "left")
    told_names = told.columns

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each block the bytes that go, as places where this changes, and the figures of its documents."""
        for row in block_rows(batches, told_names):
            b = Block(row)
            values, back, lead = b.firsts()
            shared = read_marks(values, row["marks"], n_values)
            here = np.ones(len(values), bool)
            here[shared] = read_least(values[shared], row["least"], n_values)[1]
            repeat = np.ones(len(back), bool)
            repeat[lead[here]] = False
            counts, sizes, words = unpack_steps(row["counts"]), unpack_steps(row["sizes"]), unpack_steps(row["words"]) / 4
            # All pieces of the block in turn; a run covers those from its first to its end.
            base = np.cumsum(counts) - counts
            step = np.bincount((base[b.doc] + b.first)[repeat], minlength=len(sizes) + 1) - np.bincount((base[b.doc] + b.end)[repeat], minlength=len(sizes) + 1)
            gone = np.cumsum(step)[:-1] > 0
            per_doc = np.repeat(np.arange(len(counts)), counts)
            n_removed = np.bincount(per_doc, weights=gone, minlength=len(counts)).astype(np.int64)
            n_words = np.bincount(per_doc, weights=np.where(gone, words, 0), minlength=len(counts)).astype(np.int64)
            left = np.bincount(per_doc, weights=np.where(gone, 0, sizes), minlength=len(counts)).astype(np.int64)
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False]))
            places = np.r_[0, np.cumsum(sizes)][turns]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *(pa.array([pack_steps(x)], pa.binary()) for x in (counts, n_removed, n_words, left, places))], names=["block", "counts", "n_removed", "n_words", "left", "places"])

    # Small: the texts go through one shuffle only, beside these.
    decided = cut(told.mapInArrow(decide, "block long, counts binary, n_removed binary, n_words binary, left binary, places binary"))
    del marks, least, told, runs
    whole = blocks.select("block", "ids", "lens", "body", *["rest"] * bool(carry)).join(decided, "block")
    release(df.sparkSession)
    names = whole.columns
    rest_type = to_arrow_type(whole.schema["rest"].dataType.elementType) if carry else None

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches, names):
            buf, _, _ = open_block(row["lens"], row["body"])
            data, kept, at = memoryview(buf.tobytes()), [], 0
            places = unpack_steps(row["places"]).tolist()
            stays = zip([0, *places[1::2]], [*places[::2], len(data)], strict=True)
            text = b"".join(data[a:b] for a, b in stays)
            for n in unpack_steps(row["left"]).tolist():
                kept.append(text[at : at + n].decode())
                at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), *(pa.array(unpack_steps(row[k]), pa.int64()) for k in ("counts", "n_removed", "n_words")), pa.array(kept, pa.string())] + [pa.array(row["rest"], rest_type) for _ in carry[:1]],
                names=["doc_id", "n_sentences", "n_removed", "n_words_removed", "kept", *["rest"] * bool(carry)],
            )

    schema = T.StructType.fromDDL("doc_id long, n_sentences long, n_removed long, n_words_removed long, kept string")
    return whole.mapInArrow(strike, schema.add("rest", whole.schema["rest"].dataType.elementType) if carry else schema)
