"""Token counts of whole texts, with a shortcut for words that are one token.

Which vocabulary strings encode alone as exactly one token is proved once, by encoding every one of them. Texts are
then split into pre-tokens; those in the proved set count one without any merging, and only the distinct rest of a
batch goes through the tokenizer's merges.

Texts of any script are split here, by the file's own pattern. A character beyond Latin is proved when it is first met:
the library must normalise and split it, alone and beside marks, letters and signs, as this module does. Only a text with a
character that isn't so proved (one that the library's and Python's Unicode versions see differently) goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens a worker remembers before it forgets all but the proved ones.
REMEMBERED = 400_000
#: Texts up to this code point are split by the faster of two patterns.
LAST_LATIN = "ɏ"
#: Marks of several combining classes, beside which a character is proved.
_MARKS = "\u0301\u0327\u0345\u0334\u05b0\u0e38"
_BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_counters: dict[str, WordCounter] = {}


class WordCounter:
    """Counts tokens as the tokenizer in ``path`` does, without added special tokens, truncation or padding."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        specials = [t["content"] for t in said["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        pattern = next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.latin = self._latin(pattern)
        self.proved = self._prove(said["model"]["vocab"], said["model"]["end_of_word_suffix"])
        self.known = dict.fromkeys(self.proved, 1)
        self.beyond = re.compile(f"[^\0-{LAST_LATIN}]")
        import regex

        self.every = regex.compile(pattern.replace(r"[^\s", f"[^{_BLANKS}"))
        self.sure: dict[str, bool] = {}

    @staticmethod
    def _latin(pattern: str) -> re.Pattern:
        """The splitting pattern with its classes written out for code points up to LAST_LATIN."""
        import regex

        def members(cls: str) -> str:
            return "".join(re.escape(c) for c in map(chr, range(ord(LAST_LATIN) + 1)) if regex.fullmatch(cls, c))

        letters, numbers = members(r"\p{L}"), members(r"\p{N}")
        blanks = re.escape("\t\n\v\f\r \x85\xa0")
        written = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]")
        return re.compile(written.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]"))

    def _prove(self, vocab: dict[str, int], suffix: str) -> set[str]:
        """The strings that, as a text by themselves, are split into themselves and encode as one token."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        words = []
        for entry in vocab:
            if entry.endswith(suffix) and all(c in byte for c in entry[: -len(suffix)]):
                try:
                    words.append(bytes(byte[c] for c in entry[: -len(suffix)]).decode())
                except UnicodeDecodeError:
                    continue
        words = [w for w in words if w and self.tokenizer.normalizer.normalize_str(w) == w]
        return {w for w, e in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1}

    @staticmethod
    def normal(text: str) -> str:
        """As the file's normaliser has it, but for white space, which splits words anyway. Letters are lower-cased one by
        one, so a sigma at a word's end is none of its own."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _same(self, text: str) -> bool:
        library = self.tokenizer.normalizer.normalize_str(text)
        return " ".join(library.split(" ")) == re.sub(f"[{_BLANKS}]+", " ", self.normal(text)) and self._library_split(library) == self.every.findall(self.normal(text))

    def _library_split(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def is_sure(self, c: str) -> bool:
        """Whether the library treats this character as this module does; looked up once a character."""
        if c not in self.sure:
            beside = [c, f"{c}{c}", f"a{c}1{c}!{c} {c}", *(f"a{m}{c}" for m in _MARKS), *(f"a{c}{m}" for m in _MARKS)]
            self.sure[c] = unicodedata.category(c) != "Cn" and all(map(self._same, beside))
        return self.sure[c]

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens of a text without special strings; None: only the library splits it."""
        if text.isascii():
            return self.latin.findall(text.lower())
        plain = unicodedata.normalize("NFC", text).lower()
        if not self.beyond.search(text) and not self.beyond.search(plain):
            return self.latin.findall(plain)
        plain = self.normal(text)
        if not unicodedata.is_normalized("NFC", plain):  # a lower-cased letter has come apart; its pieces would be put in order again
            return None
        if all(map(self.is_sure, set(self.beyond.findall(text)) | set(self.beyond.findall(plain)))):
            return self.every.findall(plain)
        return None

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = dict.fromkeys(self.proved, 1)
        out, pending, whole = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if self.special is not None and "<|" in text:
                pieces = self.special.split(text)
                out[i] = len(pieces) - 1
            for piece in pieces:
                words = self.split(piece)
                if words is None:
                    whole.append((i, piece))
                else:
                    pending.append((i, words))
        new = list(set().union(*(w for _, w in pending)) - self.known.keys())
        for a in range(0, len(new), 4096):
            some = new[a : a + 4096]
            self.known.update(zip(some, map(len, self.tokenizer.encode_batch(some, add_special_tokens=False)), strict=True))
        value = self.known.__getitem__
        for i, words in pending:
            out[i] += sum(map(value, words))
        for i, piece in whole:
            out[i] += len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        return out


def _counter(path: str) -> WordCounter:
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def count_tokens(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, group_chars: int = 1 << 20) -> DataFrame:
    """One row a document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Null texts count as empty (0 bytes, 0 tokens, not over the limit); null and repeated ids are carried along, one
    row each; other columns of ``df`` are not read. Texts are counted whole, in groups of about ``group_chars``
    characters, so memory is bounded by the group, the longest text and REMEMBERED. The tokenizer file must be
    readable at ``tokenizer_path`` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            texts, n_bytes, n_tokens, held = [], [], [], 0
            for t in batch.column(1):
                t = t.as_py() or ""
                texts.append(t)
                held += len(t)
                n_bytes.append(len(t.encode()))
                if held >= group_chars:
                    n_tokens += counter.counts(texts)
                    texts, held = [], 0
            n_tokens += counter.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
