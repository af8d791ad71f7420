"""Toxicity by a lexicon that tolerates misspellings, with the context of each match.

A lexicon of words and stems is learned from labelled texts. Its trie is intersected with Levenshtein automata of distance
one into a single automaton, built as words walk through it; most words leave it after a few letters. Matches are counted by how
they match (exact, stem, misspelt) and by whether the words around show a quotation; a logistic model weighs these.

Learning runs on the executors: they count the terms of the labelled texts and judge them, and they find the features.
What reaches the driver is the lexicon and a row of numbers for each labelled row of the bounded sample, never a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Labelled rows that are learned from, of each label, taken in the order of a hash of their ids; documented bound.
MAX_TOXIC, MAX_CLEAN = 3000, 6000
#: A term must be in this many toxic texts and have this share of its texts toxic.
MIN_TEXTS, MIN_SHARE = 4, 0.9
STEMS = range(4, 9)
#: Words a scorer remembers before it forgets all of them.
REMEMBERED = 150_000
#: Words of reporting that mark a quotation within WINDOW words before a match. Fixed values.
REPORTING = frozenset("said says called calls quote quoted quotes quoting wrote writes term word phrase described reported".split())
WINDOW = 6
_WORD = re.compile(r"[\w@$]+")
_QUOTES = re.compile("[\"“”«»„]")
KINDS = ("exact", "stem", "misspelt")


class Automaton:
    """The lexicon's trie with up to one edit, determinised on demand.

    A state is the set of (trie node, edits left, letter due) that a read prefix can be at; a letter is due where two
    neighbours were swapped and the second was read first. An edit is a letter more, less or other, or such a swap. A stem
    accepts with any letters after it and without edits; whole words of five letters or more accept at distance one.
    """

    def __init__(self, words: set[str], stems: set[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[set[str]] = [set()]
        for term, kind in [*((w, "long" if len(w) >= 5 else "short") for w in sorted(words)), *((s, "stem") for s in sorted(stems))]:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(set())
                node = self.children[node][c]
            self.ends[node].add(kind)
        self.step: list[dict[str, int]] = []
        self.accept: list[int] = []
        self.stem: list[bool] = []
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.dead = self._number(frozenset())
        self.root = self._number(self._closed({(0, 1, "")}))

    def _closed(self, state: set[tuple[int, int, str]]) -> frozenset:
        for node, left, _ in list(state):
            if left:
                state.update((kid, 0, "") for kid in self.children[node].values())  # a letter of the term is left out
        return frozenset(s for s in state if s[1] or s[2] or (s[0], 1, "") not in state)

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.step.append({})
            exact = any(left and self.ends[node] & {"long", "short"} for node, left, _ in state)
            near = any(not due and "long" in self.ends[node] for node, _, due in state)
            near = near or any(left and any("long" in self.ends[k] for k in self.children[node].values()) for node, left, _ in state)
            self.accept.append(1 if exact else 3 if near else 0)
            self.stem.append(any(left and "stem" in self.ends[node] for node, left, _ in state))
        return self.numbers[state]

    def _move(self, at: int, c: str) -> int:
        to: set[tuple[int, int, str]] = set()
        for node, left, due in self.states[at]:
            if due:
                if c == due:
                    to.add((node, 0, ""))
                continue
            kids = self.children[node]
            if c in kids:
                to.add((kids[c], left, ""))
            if left:
                to.add((node, 0, ""))  # a letter too many
                to.update((kid, 0, "") for kid in kids.values())  # another letter
                to.update((self.children[kid][c], 0, a) for a, kid in kids.items() if a != c and c in self.children[kid])  # the next letter first
        return self._number(self._closed(to))

    def match(self, word: str) -> int:
        """0: none; 1: a term; 2: a stem with more letters; 3: within one edit of a term."""
        at, stem, step = self.root, False, self.step
        for c in word:
            to = step[at].get(c)
            if to is None:
                to = self._move(at, c)
                if len(step[at]) < 2000:
                    step[at][c] = to
            at = to
            if at == self.dead:
                return 2 if stem else 0
            stem = stem or self.stem[at]
        return self.accept[at] if self.accept[at] == 1 else 2 if stem else self.accept[at]


def forms(words: set[str]) -> set[str]:
    """What may be learned of a text's words: those of three letters or more, and their beginnings, marked with a star."""
    return {w for w in words if len(w) >= 3} | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def choose_terms(good: dict[str, int]) -> tuple[set[str], set[str]]:
    """Words, and stems whose single words are too rare to be learned, of the forms that mark toxic texts.

    ``good`` has the forms and how many toxic texts they are in. A word under a stem stays a word, so that its
    misspellings are found, too.
    """
    words = {f for f in good if not f.endswith("*")}
    stems: set[str] = set()
    for stem in sorted((f[:-1] for f in good if f.endswith("*")), key=lambda f: (len(f), f)):
        under = [w for w in words if w.startswith(stem)]
        if not any(stem.startswith(s) for s in stems) and not any(good[w] * 2 >= good[stem + "*"] for w in under):
            stems.add(stem)
    return words, stems


class Scorer:
    """Features of a text: for each kind of match, how much stands quoted and how much not."""

    def __init__(self, words: set[str], stems: set[str]) -> None:
        self.automaton = Automaton(words, stems)
        self.known: dict[str, int] = {}

    def features(self, text: str) -> np.ndarray:
        low = text.lower()
        out = np.zeros(2 * len(KINDS))
        known, match = self.known, self.automaton.match
        if len(known) > REMEMBERED:
            known.clear()
        hits = set()
        for w in set(_WORD.findall(low)):
            kind = known.get(w)
            if kind is None:
                kind = known[w] = match(w)
            if kind:
                hits.add(w)
        if hits:
            quotes = np.array([m.start() for m in _QUOTES.finditer(low)])
            before: list[str] = []
            for m in _WORD.finditer(low):
                w = m.group()
                if w in hits:
                    inside = int(np.searchsorted(quotes, m.start())) % 2 == 1 and len(quotes) > int(np.searchsorted(quotes, m.start()))
                    quoted = inside or any(b in REPORTING for b in before)
                    out[2 * (known[w] - 1) + quoted] += 1
                before = [*before[-WINDOW + 1 :], w]
        return np.log1p(out)


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method, of rows that count ``n`` times each."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * (p * (1 - p) + 1e-9))[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(h, x.T @ (n * (p - y)) + penalty * w)
    return w


def fit_toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> dict:
    """A model from labelled rows: at most ``max_toxic`` toxic and ``max_clean`` other ones, by the hash of their ids.

    Rows with a null id, text or label are passed over; texts of the same words in the same order say what one of them
    says. Without labelled rows the model has no term and holds everything clean.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").distinct()
    order = (F.xxhash64("id"), F.col("id"))
    chosen = known.where("y = 1").orderBy(*order).limit(max_toxic).union(known.where("y = 0").orderBy(*order).limit(max_clean))
    chosen = F.broadcast(cut(chosen))  # at most max_toxic + max_clean rows of two numbers
    texts = cut(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("y", "text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0), batch.column(1), strict=True):
                words = _WORD.findall(text.as_py().lower())
                yield pa.RecordBatch.from_arrays([pa.array([y.as_py()], pa.int32()), pa.array([hashlib.sha256(" ".join(words).encode()).digest()], pa.binary()), pa.array([sorted(forms(set(words)))], pa.list_(pa.string()))], names=["y", "words", "forms"])

    apart = texts.mapInArrow(terms, "y int, words binary, forms array<string>").groupBy("y", "words").agg(F.first("forms").alias("forms"))
    apart = cut(apart)
    sizes = dict(apart.groupBy("y").count().collect())  # two rows
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    scale, least = n_toxic / max(1, n_clean), max(MIN_TEXTS, n_toxic // 500)
    counted = apart.select("y", F.explode("forms").alias("form")).groupBy("form").agg(F.count_if(F.col("y") == 1).alias("n"), F.count_if(F.col("y") == 0).alias("other"))
    judged = counted.where((F.col("n") >= least) & (F.col("n") >= MIN_SHARE * (F.col("n") + F.col("other") * scale)) & (F.col("n") >= 5 * scale * F.col("other") + least))
    words, stems = choose_terms(dict(judged.select("form", "n").collect()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(words, stems)
        for batch in batches:
            found = [scorer.features(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    # A row of seven numbers for each of at most max_toxic + max_clean labelled rows (more only where ids repeat, so summed up).
    rows = texts.mapInArrow(features, "y int, x array<double>").groupBy("y", "x").count().collect()
    if not rows:
        return {"words": [], "stems": [], "weights": [0.0] * (2 * len(KINDS)) + [-1.0]}
    rows.sort()
    x, y, n = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), np.array([r["count"] for r in rows], float)
    weights = fit_logistic(x, y, n)
    # What the sample has no case of: a misspelt term counts half as much as an exact one, a quoted one a quarter.
    for k in range(len(KINDS)):
        if n @ x[:, 2 * k] < MIN_TEXTS:
            weights[2 * k] = weights[0] / 2
        if n @ x[:, 2 * k + 1] < MIN_TEXTS:
            weights[2 * k + 1] = weights[2 * k] / 4
    return {"words": sorted(words), "stems": sorted(stems), "weights": weights.tolist()}


def _scores(texts: Iterator[str | None], scorer: Scorer, weights: np.ndarray) -> np.ndarray:
    z = np.array([scorer.features(t or "") @ weights[:-1] + weights[-1] for t in texts])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_toxicity(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` for each row. A null or empty text has the score of a text without any match; ids
    are carried as they are; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, weights = Scorer(set(model["words"]), set(model["stems"])), np.array(model["weights"])
        for batch in batches:
            score = _scores((t.as_py() for t in batch.column(1)), scorer, weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that aren't predicted toxic, each judged by its own text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer, weights = Scorer(set(model["words"]), set(model["stems"])), np.array(model["weights"])
        for batch in texts:
            yield pd.Series(_scores(iter(batch), scorer, weights) >= 0.5)

    return df.where(~toxic(F.col(text_col).cast("string")))
