"""License scans by conditional compression.

Around every word that license texts are known by, a block of the text is taken. It is compressed by itself and with each
template as zstandard raw dictionary; templates are ranked by the bytes that they save. Templates that save a good part of what
they themselves take are then compared word by word with the block, wherever it may hold them. Of occurrences that overlap the
one with the fewest differences for its length is reported, with these differences.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: License notices as they are commonly worded. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal.",
    "Proprietary": "All rights reserved.",
}
_ANCHOR = re.compile(r"licen[sc]e|copyright|permission is|redistribut|free software|public domain|creative commons|\bcc0|\bcc by|spdx|rights reserved", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: Characters of a block before and after its anchor, at least; more where a template is longer (``reach``).
BEFORE, AFTER = 160, 400
#: Anchors so near behind the one that a block is for start no block of their own.
NEAR = 40
#: A template must save this part of its own size, and this part of its words must be in the block in order.
MIN_SAVED, MIN_ALIKE = 0.35, 0.8


def reach(templates: dict[str, str]) -> tuple[int, int, bool]:
    """Characters before and after an anchor that a block needs so that each template fits in with half as much white space
    again, and whether templates go on behind empty lines. A template without an anchor word could never be found."""
    before, after = BEFORE, AFTER
    for name, t in templates.items():
        first = _ANCHOR.search(t)
        if first is None:
            raise ValueError(f"template {name!r} has none of the words that blocks are taken around")
        before = max(before, first.start() * 3 // 2)
        after = max(after, (len(t) - first.start()) * 3 // 2 + NEAR)
    return before, after, any("\n\n" in t for t in templates.values())


def blocks(text: str, before: int = BEFORE, after: int = AFTER, across: bool = False) -> Iterator[tuple[int, int, str]]:
    """(place of the anchor, start, block) around each anchor that the block before isn't for. A block ends at empty lines,
    unless templates go on behind them (``across``)."""
    done = -1
    for m in _ANCHOR.finditer(text):
        if m.start() < done:
            continue
        start, end = max(0, m.start() - before), min(len(text), m.end() + after)
        if not across:
            start = max(start, text.rfind("\n\n", start, m.start()) + 2) if "\n\n" in text[start : m.start()] else start
            stop = text.find("\n\n", m.end(), end)
            end = stop if stop >= 0 else end
        done = min(m.end() + NEAR, end)
        yield m.start(), start, text[start:end]


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        self.templates, self.reach = templates, reach(templates)
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.with_dict = {
            name: zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for name, t in templates.items()
        }
        self.size = {name: len(t.encode()) for name, t in templates.items()}
        self.words = {name: _WORD.findall(t.lower()) for name, t in templates.items()}
        self.judge = lru_cache(maxsize=50_000)(self._judge)

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """(saved bytes as part of the template, name) of the templates that save enough, the most saving first."""
        data = block.encode()
        alone = len(self.plain.compress(data))
        saved = [((alone - len(c.compress(data))) / self.size[name], name) for name, c in self.with_dict.items()]
        return sorted((s for s in saved if s[0] >= MIN_SAVED), key=lambda s: (-s[0] * self.size[s[1]], s[1]))

    def _judge(self, block: str) -> list[tuple[tuple, str, float, int, str, int, int]]:
        """(rank, name, saved, differing words, differences, start, end) of each place where the block holds a template."""
        places = list(_WORD.finditer(block))
        words = [m.group().lower() for m in places]
        found = []
        for saved, name in self.ranked(block):
            for wrong, said, low, high in occurrences(self.words[name], words):
                rank = (wrong / len(self.words[name]), -len(self.words[name]), name)
                found.append((rank, name, round(saved, 4), wrong, said, places[low].start(), places[high - 1].end()))
        return found


def occurrences(own: list[str], words: list[str]) -> Iterator[tuple[int, str, int, int]]:
    """(differing words, differences, first word, end) of the places of ``words`` that hold the template ``own``; they don't
    overlap. Each is looked for around a run of equal words, the longest first, and is compared with the words there."""
    most = int((1 - MIN_ALIKE) * len(own) + 1e-9)
    # With so many differences at most, one of the equal runs between them has this many words.
    least = max(1, -(-(len(own) - most) // (most + 1)))
    seek, words = list(words), list(words)
    while True:
        m = SequenceMatcher(None, own, seek, autojunk=False).find_longest_match()
        if m.size < least:
            return
        start = max(0, m.b - m.a - most)
        here = words[start : m.b - m.a + len(own) + most]
        parts = [p for p in SequenceMatcher(None, own, here, autojunk=False).get_matching_blocks() if p.size]
        seek[m.b : m.b + m.size] = [None] * m.size
        if not parts or sum(p.size for p in parts) < MIN_ALIKE * len(own):
            continue
        # From the first to the last word they share: what stands beyond is no part of the notice, what the template has beyond is missing.
        low, high = parts[0].b, parts[-1].b + parts[-1].size
        changes = [(own[a:b], [w or "" for w in here[low:high][c:d]]) for tag, a, b, c, d in SequenceMatcher(None, own, here[low:high], autojunk=False).get_opcodes() if tag != "equal"]
        said = [f"-{' '.join(x)}+{' '.join(y)}" for x, y in changes]
        wrong = sum(len(x) + len(y) for x, y in changes)
        if wrong > (1 - MIN_ALIKE) * len(own) + 1e-9:
            continue
        first, end = start + parts[0].b, start + parts[-1].b + parts[-1].size
        yield wrong, "; ".join(said), first, end
        seek[first:end] = words[first:end] = [None] * (end - first)


def licenses_of(text: str, scanner: Scanner) -> dict[str, list]:
    """For each license (differing words, place of the anchor, saved, differences) of each of its occurrences."""
    held = []
    for at, start, block in blocks(text, *scanner.reach):
        held += [(rank, start + low, start + high, at, name, saved, wrong, said) for rank, name, saved, wrong, said, low, high in scanner.judge(block)]
    found: dict[str, list] = {}
    taken: list[tuple[int, int]] = []
    for _, low, high, at, name, saved, wrong, said in sorted(held):
        k = bisect(taken, (low, high))
        if (k == 0 or taken[k - 1][1] <= low) and (k == len(taken) or high <= taken[k][0]):
            taken.insert(k, (low, high))
            own = _ANCHOR.search(text, low, high)
            found.setdefault(name, []).append((wrong, own.start() if own else at, saved, said))
    return found


def scan_licenses(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, n_found, first_at, saved, n_differences, differences``: a row for each license of a document.

    ``n_found`` counts the places that hold it. ``first_at`` is the character where its first anchor stands; the other figures
    are those of the occurrence with the fewest differing words, then the first. Templates may be of any length, but need an
    anchor word. Null and empty texts, and those without an anchor, give no row; rows with equal or null ids
    give rows of their own. Texts are scanned whole. Other columns aren't read.
    """
    known = dict(templates or TEMPLATES)
    reach(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = licenses_of(text or "", scanner)
                for name, each in sorted(found.items()):
                    wrong, _, saved, differences = min(each)
                    out.append((doc_id, name, len(each), min(e[1] for e in each), saved, wrong, differences))
            if out:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string())
                names = ["doc_id", "license", "n_found", "first_at", "saved", "n_differences", "differences"]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    picked = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, license string, n_found long, first_at long, saved double, n_differences long, differences string")
