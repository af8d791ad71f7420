"""Minified sources: bodies of functions and values that aren't settings give way to a note; and what that saves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import paths
from strandgraph.sources import vue
from strandgraph.sources.javascript import read

#: What stands for a body and for a value. Fixed values.
BODY, VALUE = " /* реализация скрыта */ ", "/* значение скрыто */"
_NAMED = re.compile(r"^[A-Z][A-Z_]+$|(PATTERNS|SELECTORS|CONFIG|SETTINGS|OPTIONS)$|^(pageContext|lastPageState|syncScheduled)$")
_TELLING = re.compile(r"^[#.\[]|selector|pattern")


def keeps(name: str, literal: str, value: str) -> bool:
    """Whether a variable keeps its value; the same rule as ``rules.keeps_value`` has for columns."""
    return bool(_NAMED.search(name)) or literal in ("literal", "regex") or (literal == "array" and any(_TELLING.search(e) for e in value.split("\x1f")))


def minified(text: str, path: str = "") -> str:
    """The text without bodies and hidden values; one that can't be read stays as it is.

    Of spans inside each other the outer one counts: what is in it is gone with it.
    """
    if path.endswith(".vue"):
        return _minified_component(text, path)
    nodes = read(text, path)
    if any(n["kind"] == "error" for n in nodes):
        return text
    cuts = []
    for n in nodes:
        a = n["attrs"]
        if n["kind"] in ("function", "arrow", "method") and a.get("block") == "true" and int(a["body_end"]) - int(a["body_start"]) > 2:
            cuts.append((int(a["body_start"]) + 1, int(a["body_end"]) - 1, BODY))
        elif n["kind"] == "variable" and "value_start" in a and not keeps(a["short"], a["literal"], a["value"]):
            cuts.append((int(a["value_start"]), int(a["value_end"]), VALUE))
    out, at = [], 0
    for start, end, instead in sorted(set(cuts), key=lambda c: (c[0], -c[1])):
        if start >= at:
            out += [text[at:start], instead]
            at = end
    return squeezed("".join([*out, text[at:]]))


def _minified_component(text: str, path: str) -> str:
    def script(m: re.Match) -> str:
        return m.group(0) if m.group(1) != "script" else m.group(0).replace(m.group(3), minified(m.group(3), path.removesuffix(".vue") + ".tsx"))

    return vue._BLOCK.sub(script, text)


def squeezed(text: str) -> str:
    """Empty lines become one at most."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^\s*[\r\n]", "\n", text))


def minify(files: DataFrame) -> DataFrame:
    """``path, ext, size, minified, minified_size`` of files (path, ext, content); sizes are bytes of UTF-8."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [minified(c or "", p or "") for p, c in zip(b["path"], b["content"], strict=True)]
            sizes = [len((c or "").encode()) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "ext": b["ext"], "size": sizes, "minified": out, "minified_size": [len(o.encode()) for o in out]})

    return files.select("path", "ext", "content").mapInPandas(run, "path string, ext string, size long, minified string, minified_size long")


def savings(minified_files: DataFrame) -> DataFrame:
    """One row: ``files, size, minified_size, saved_kb, saved_percent`` (null for an empty project)."""
    size, small = F.sum("size"), F.sum("minified_size")
    return minified_files.agg(F.count("*").alias("files"), F.coalesce(size, F.lit(0)).alias("size"), F.coalesce(small, F.lit(0)).alias("minified_size"), F.round((size - small) / 1024, 2).alias("saved_kb"), F.when(size > 0, F.round((size - small) * 100 / size, 1)).alias("saved_percent"))


def by_extension(files: DataFrame) -> DataFrame:
    """``ext, files, size``."""
    return files.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


def in_order(files: DataFrame) -> DataFrame:
    """By extension, then path, both by code point."""
    return files.orderBy("ext", "path")


def prompt_pack(target: str, closure: DataFrame, files: DataFrame) -> DataFrame:
    """``place, path, language, text``: the target file whole, then the minified files of its closure (node, distance), the
    nearest first. Files that aren't the project's own are left out."""
    wanted = closure.where(F.col("node") != target).select(F.col("node").alias("path"), "distance")
    own = files.where(F.col("path") == target).select("path", F.lit(0).alias("distance"), F.col("content").alias("text"))
    others = minify(files.join(wanted.select("path"), "path", "left_semi")).select("path", F.col("minified").alias("text")).join(wanted, "path").select("path", "distance", "text")
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("distance", "path")) - 1  # of the closure, which is bounded by its depth
    shown = F.when(F.col("path").rlike(r"\.(tsx?|vue)$"), "typescript").otherwise("javascript")
    return own.union(others).select(place.alias("place"), "path", shown.alias("language"), "text")


def languages(files: DataFrame) -> DataFrame:
    return files.select("path", paths.language(F.col("path")).alias("language"))
