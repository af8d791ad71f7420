"""Statements of functions in the order they are written, with where control goes: what ``operators.flow`` makes blocks of.

Structured statements become branches and jumps: ``if`` and loops branch past what they guard, loops jump back, ``do`` branches
back, a ``switch`` branches from case to case, ``try`` may go to its ``catch`` at once, ``break`` and ``continue`` jump,
``return`` and ``throw`` end the function. Functions inside a function are statements of their own function only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vue
from .javascript import Reader, SyntaxProblem

SCHEMA = "fn string, pos int, kind string, target int, line int, text string"


class Steps:
    """Statements of one function body, collected with targets that are filled in once they are known."""

    def __init__(self, reader: Reader) -> None:
        self.r, self.out = reader, []
        self.loops: list[tuple[list[int], list[int]]] = []  # places of breaks and of continues

    def add(self, kind: str, k: int, end: int, target: int | None = None) -> int:
        t = self.r.t[k]
        self.out.append([kind, target, self.r.line(t.start), self.r.text[t.start : self.r.t[max(k, end - 1)].end][:80]])
        return len(self.out) - 1

    def here(self) -> int:
        return len(self.out)

    def aim(self, places: list[int], at: int) -> None:
        for p in places:
            self.out[p][1] = at

    def block(self, k: int, end: int) -> None:
        while k < end:
            k = self.statement(k, end)

    def body(self, k: int, end: int) -> int:
        """A braced block or a single statement; the token after it."""
        if self.r.at(k) == "{":
            self.block(k + 1, self.r.match[k])
            return self.r.match[k] + 1
        return self.statement(k, end)

    def simple_end(self, k: int, end: int) -> int:
        j = k
        while j < end:
            c = self.r.at(j)
            if c in ("(", "[", "{") and self.r.t[j].kind == "punct":
                j = self.r.match[j]
            elif c == ";":
                return j + 1
            elif j > k and self.r.line(self.r.t[j].start) > self.r.line(self.r.t[j - 1].end - 1) and self.r.at(j - 1) not in ("=", "+", "-", "*", "/", ",", "(", "&&", "||", "??", "?", ":", "=>", ".", "<", ">", "!", "return") and c not in (".", "?.", "+", "-", "*", "/", "&&", "||", "??", "?", ":", ",", ")", "=", "=>"):
                return j
            j += 1
        return end

    def statement(self, k: int, end: int) -> int:
        r, word = self.r, self.r.at(k)
        if word in (";", "}"):
            return k + 1
        if word == "{":
            self.block(k + 1, r.match[k])
            return r.match[k] + 1
        if word == "if" and r.at(k + 1) == "(":
            return self.choice(k, end)
        if word in ("while", "for"):
            open_ = k + 1 + (r.at(k + 1) == "await")
            if r.at(open_) == "(":
                return self.loop(k, open_, end)
        if word == "do":
            return self.do(k, end)
        if word == "switch" and r.at(k + 1) == "(":
            return self.switch(k, end)
        if word == "try" and r.at(k + 1) == "{":
            return self.attempt(k, end)
        stop = self.simple_end(k, end)
        if word in ("return", "throw"):
            self.add("return", k, stop)
        elif word in ("break", "continue") and self.loops:
            self.loops[-1][word == "continue"].append(self.add("jump", k, stop))
        else:
            self.add("plain", k, stop)
        return max(stop, k + 1)

    def choice(self, k: int, end: int) -> int:
        r = self.r
        close = r.match[k + 1] + 1
        test = self.add("branch", k, close)
        after = self.body(close, end)
        if r.at(after) == "else" and after < end:
            over = self.add("jump", after, after + 1)
            self.aim([test], self.here())
            after = self.body(after + 1, end)
            self.aim([over], self.here())
        else:
            self.aim([test], self.here())
        return after

    def loop(self, k: int, open_: int, end: int) -> int:
        close = self.r.match[open_] + 1
        test = self.add("branch", k, close)
        self.loops.append(([], []))
        after = self.body(close, end)
        breaks, continues = self.loops.pop()
        self.add("jump", k, k + 1, test)
        self.aim([test, *breaks], self.here())
        self.aim(continues, test)
        return after

    def do(self, k: int, end: int) -> int:
        first = self.here()
        self.loops.append(([], []))
        after = self.body(k + 1, end)
        breaks, continues = self.loops.pop()
        close = self.r.match[after + 1] + 1 if self.r.at(after) == "while" else after
        self.aim(continues, self.here())
        self.add("branch", min(after, len(self.r.t) - 1), close, first)
        self.aim(breaks, self.here())
        return close

    def switch(self, k: int, end: int) -> int:
        r = self.r
        open_ = r.match[k + 1] + 1
        self.add("plain", k, open_)
        stop = r.match[open_]
        self.loops.append(([], self.loops[-1][1] if self.loops else []))
        j, missed, fell = open_ + 1, [], []
        while j < stop:
            if r.at(j) in ("case", "default"):
                colon = j + 1
                while colon < stop and r.at(colon) != ":":
                    colon = r.match[colon] + 1 if r.at(colon) in ("(", "[", "{") else colon + 1
                if r.at(j) == "case":
                    over = [self.add("jump", j, j + 1)] if self.out and self.out[-1][0] == "plain" and fell else []
                    self.aim(missed, self.here())
                    missed = [self.add("branch", j, colon)]
                    self.aim(over, self.here())
                else:
                    self.aim(missed, self.here())
                    missed = []
                j, fell = colon + 1, [1]
            else:
                j = self.statement(j, stop)
        breaks, _ = self.loops.pop()
        self.aim([*missed, *breaks], self.here())
        return stop + 1

    def attempt(self, k: int, end: int) -> int:
        r = self.r
        may = self.add("branch", k, k + 1)
        after = self.body(k + 1, end)
        if r.at(after) == "catch":
            over = self.add("jump", after, after + 1)
            self.aim([may], self.here())
            open_ = r.match[after + 1] + 1 if r.at(after + 1) == "(" else after + 1
            after = self.body(open_, end)
            self.aim([over], self.here())
        else:
            self.aim([may], self.here())
        return self.body(after + 1, end) if r.at(after) == "finally" else after


def of_text(text: str, path: str) -> Iterator[tuple]:
    """(function, place, kind, target, line, text) of each function of a text; one that can't be read has none."""
    try:
        reader = Reader(text, path)
        nodes = reader.run()
    except SyntaxProblem:
        return
    starts = [t.start for t in reader.t]
    for n in nodes:
        if n["kind"] not in ("function", "arrow", "method"):
            continue
        a, b = bisect_left(starts, int(n["attrs"]["body_start"])), bisect_left(starts, int(n["attrs"]["body_end"]))
        steps = Steps(reader)
        if n["attrs"]["block"] == "true":
            steps.block(a + 1, b - 1)
        elif a < b:
            steps.add("return", a, b)
        for k, (kind, target, line, said) in enumerate(steps.out):
            yield f"{path}#{n['name']}", k, kind, target, line, said


def statements(files: DataFrame) -> DataFrame:
    """``fn, pos, kind, target, line, text`` of all functions of files (path, content); ``fn`` is the function's id, a target past
    the last statement is the end of the function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"], strict=True):
                path, content = path or "", content or ""
                out += of_text(vue.script_only(content) if path.endswith(".vue") else content, path)
            frame = pd.DataFrame(out, columns=["fn", "pos", "kind", "target", "line", "text"])
            yield frame.astype({"target": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA).withColumn("target", F.col("target").cast("int"))
