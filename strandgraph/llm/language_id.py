"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its three letters'
vectors, rotated by place, by elementwise product; a document bundles the vectors of its trigrams by their counts;
a language's prototype bundles the documents that are labelled with it. A document takes the language whose
prototype has the largest cosine with it, after the mean of all prototypes is taken off each (what all languages
share says nothing).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

DIMENSIONS = 512
#: Sums are kept as whole numbers of this fraction, so that they don't depend on the order of adding.
UNIT = 1 << 20
_ASCII, _LETTERS = re.compile("[a-z]+"), regex.compile(r"\p{L}+")
_vectors: dict[int, np.ndarray] = {}


def letter_vectors(codes: np.ndarray, dims: int) -> np.ndarray:
    """Random signs for each code point, drawn by hashing (code point, dimension)."""
    grid = codes.astype(np.uint64)[:, None] * np.uint64(0x10001) + (np.arange(dims, dtype=np.uint64)[None, :] << np.uint64(40))
    return ((mix(mix(grid)) >> np.uint64(63)).astype(np.int8) * 2 - 1).astype(np.float32)


class Bundler:
    """Trigram counts of texts, and their bundled vectors."""

    def __init__(self, dims: int) -> None:
        self.dims = dims

    def trigrams(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (places in ``self.bound``, counts); texts without letters give empty arrays."""
        plain = [" " + " ".join((_ASCII if t.isascii() else _LETTERS).findall(t.lower())) + " " for t in texts]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = np.zeros(int(codes.max()) + 1, bool)
        table[codes] = True
        letters = np.flatnonzero(table)
        place = np.zeros(len(table), np.int64)
        place[letters] = np.arange(len(letters))
        c, n = place[codes], len(letters)
        key = (c[:-2] * n + c[1:-1]) * n + c[2:]
        ends = np.cumsum(sizes)
        found = []
        for size, end in zip(sizes, ends, strict=True):
            found.append(np.unique(key[end - size : end - 2], return_counts=True) if size > 2 else (np.empty(0, np.int64), np.empty(0, np.int64)))
        keys = np.unique(np.concatenate([k for k, _ in found]))
        v = letter_vectors(letters, self.dims)
        self.bound = np.roll(v, 2, 1)[keys // (n * n)] * np.roll(v, 1, 1)[keys // n % n] * v[keys % n]
        return [(np.searchsorted(keys, k), counts) for k, counts in found]

    def bundles(self, texts: list[str]) -> Iterator[np.ndarray | None]:
        for places, counts in self.trigrams(texts):
            yield counts.astype(np.float32) @ self.bound[places] if len(places) else None


def _groups(batch: pa.RecordBatch, column: int, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    first, texts, held = 0, [], 0
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= chars:
            yield first, texts
            first, texts, held = i + 1, [], 0
    if texts:
        yield first, texts


def fit_languages(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A prototype for each language, from all rows whose text and language are not null.

    A document adds its bundle at length one, so long documents don't outweigh others. Partial sums are made on the
    executors; the driver gets ``dims`` numbers a language, however many documents there are.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dims), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts in _groups(batch, 0):
                held: dict[str, np.ndarray] = {}
                for i, (places, counts) in enumerate(bundler.trigrams(texts)):
                    if len(places):
                        w = held.setdefault(langs[first + i], np.zeros(len(bundler.bound)))
                        w[places] += counts / np.sqrt(float(counts @ counts))
                for lang, w in held.items():
                    sums[lang] = sums.get(lang, 0) + w @ bundler.bound
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([np.rint(s * UNIT).astype(np.int64).tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["lang", "sums"])

    known = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    parts = known.mapInArrow(partial, "lang string, sums array<long>")
    rows = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["lang"], np.zeros(dims))[r["pos"]] = r["s"] / UNIT
    return dict(sorted(out.items()))


def predict_languages(df: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row: one row a document, whole texts, ids carried as they are.

    A null text, one without a letter, or any text where no language was learned gives ``und`` with score 0. Equal
    cosines go to the language that sorts first. The score is (1 + cosine) / 2.
    """
    names = list(prototypes)
    dims = len(next(iter(prototypes.values()))) if names else DIMENSIONS
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]).reshape(len(names), dims)
    shared = matrix.mean(axis=0) if len(names) > 1 else np.zeros(dims)
    centred = matrix - shared
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    direction = shared / max(np.linalg.norm(shared), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dims)
        for batch in batches:
            langs, scores = [], []
            for _, texts in _groups(batch, 1):
                for v in bundler.bundles(texts):
                    if v is None or not names:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    v = v.astype(np.float64)
                    v = v - (v @ direction) * direction if len(names) > 1 else v
                    cosine = centred @ v / max(float(np.linalg.norm(v)), 1e-12)
                    best = int(np.argmax(np.round(cosine, 9)))
                    langs.append(names[best])
                    scores.append(float(min(1.0, max(0.0, (1 + cosine[best]) / 2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")
