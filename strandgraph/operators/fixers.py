"""Mending source text: each fixer takes text to text. Those on lines are column expressions, those that need syntax are
functions of one text, run on files by ``apply``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.sources.javascript import KEYWORDS, Lexer, Reader, SyntaxProblem, read


def _by_line(text: Column, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), change), "\n")


def trailing_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def end_of_file(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def empty_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def semicolons(text: Column, lines: Column | None = None) -> Column:
    """A semicolon on each line that doesn't end in a bracket, comma, operator or one of its own; with ``lines`` only on these
    (numbered from 1)."""
    needs = lambda x: ~x.rlike(r"(^\s*$)|[{}(\[;,:&|+*=?<>.-]\s*$|^\s*(//|\*|/\*)")
    parts = F.split(text, "\n", -1)
    asked = lambda i: F.lit(True) if lines is None else F.array_contains(lines, (i + 1).cast("int"))
    return F.array_join(F.transform(parts, lambda x, i: F.when(needs(x) & asked(i), F.concat(F.rtrim(x), F.lit(";"))).otherwise(x)), "\n")


def trailing_comma(text: Column, line: Column, add: Column) -> Column:
    """A comma at the end of a line, put there or taken away."""
    parts = F.split(text, "\n", -1)
    change = lambda x: F.when(add, F.concat(F.regexp_replace(x, r",?\s*$", ""), F.lit(","))).otherwise(F.regexp_replace(x, r",\s*$", ""))
    return F.array_join(F.transform(parts, lambda x, i: F.when(i + 1 == line, change(x)).otherwise(x)), "\n")


def bare_expressions(text: Column) -> Column:
    """Without lines that are one name or literal and nothing else."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(r"^\s*([A-Za-z_$][A-Za-z0-9_$.]*|[0-9]+|'[^']*'|\"[^\"]*\");\s*$") | x.rlike(r"^\s*(return|break|continue|debugger);\s*$")), "\n")


def define_missing(text: Column, name: Column) -> Column:
    return F.concat(F.lit("const "), name, F.lit(" = undefined;\n"), text)


# --- by syntax ---


def _replaced(text: str, cuts: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, instead in sorted(set(cuts)):
        if start >= at:
            out += [text[at:start], instead]
            at = end
    return "".join([*out, text[at:]])


def _tokens(text: str) -> list:
    return Lexer(text, True).run()


def quotes(text: str) -> str:
    """Single quotes around strings that have none inside."""
    return _replaced(text, [(t.start, t.end, "'" + t.text[1:-1].replace('\\"', '"') + "'") for t in _tokens(text) if t.kind == "string" and t.text[0] == '"' and "'" not in t.text])


def strict_equality(text: str) -> str:
    return _replaced(text, [(t.start, t.end, t.text + "=") for t in _tokens(text) if t.kind == "punct" and t.text in ("==", "!=")])


def _assigned(tokens: list) -> set[str]:
    """Names that are assigned to after their declaration."""
    found = set()
    for k, t in enumerate(tokens[:-1]):
        after = tokens[k + 1].text
        if t.kind == "name" and (after in ("+=", "-=", "*=", "/=", "%=", "++", "--", "**=", "&&=", "||=", "??=") or (after == "=" and not (k and tokens[k - 1].text in ("const", "let", "var", ".", ",")))):
            found.add(t.text)
        if t.text in ("++", "--") and tokens[k + 1].kind == "name":
            found.add(tokens[k + 1].text)
    return found


def _declared(text: str, words: tuple[str, ...], instead: Callable[[bool], str]) -> str:
    tokens = _tokens(text)
    assigned = _assigned(tokens)
    cuts = []
    for k, t in enumerate(tokens[:-1]):
        if t.kind == "name" and t.text in words and tokens[k + 1].kind == "name":
            looped = k >= 2 and tokens[k - 1].text == "(" and tokens[k - 2].text == "for" and (k + 2 >= len(tokens) or tokens[k + 2].text not in ("of", "in"))
            valued = k + 2 < len(tokens) and tokens[k + 2].text in ("=", ":", "of", "in")
            cuts.append((t.start, t.end, instead(valued and not looped and tokens[k + 1].text not in assigned)))
    return _replaced(text, cuts)


def prefer_const(text: str) -> str:
    """``let`` that is never assigned again becomes ``const``; declarations without a value stay."""
    return _declared(text, ("let",), lambda constant: "const" if constant else "let")


def no_var(text: str) -> str:
    return _declared(text, ("var",), lambda constant: "const" if constant else "let")


def shorthand(text: str) -> str:
    """``{a: a}`` becomes ``{a}``."""
    t = _tokens(text)
    return _replaced(text, [(t[k].start, t[k + 2].end, t[k].text) for k in range(1, len(t) - 3) if t[k].kind == t[k + 2].kind == "name" and t[k].text == t[k + 2].text and t[k + 1].text == ":" and t[k - 1].text in ("{", ",") and t[k + 3].text in ("}", ",")])


def arrow_bodies(text: str) -> str:
    """``() => { return e; }`` becomes ``() => e``; objects get brackets."""
    r = Reader(text)
    cuts = []
    for k, t in enumerate(r.t[:-2]):
        if t.text == "=>" and r.at(k + 1) == "{" and r.at(k + 2) == "return":
            end = r.match[k + 1]
            stop = r.expression_end(k + 3)
            last = stop + (r.at(stop) == ";")
            if last == end and stop > k + 3:
                body = r.slice(k + 3, stop)
                cuts.append((r.t[k + 1].start, r.t[end].end, f"({body})" if body.startswith("{") else body))
    return _replaced(text, cuts)


def _renamed(text: str, old: str, new: str) -> str:
    t = _tokens(text)
    return _replaced(text, [(x.start, x.end, new) for k, x in enumerate(t) if x.kind == "name" and x.text == old and not (k and t[k - 1].text in (".", "?."))])


def unused_names(text: str) -> str:
    """Variables and parameters that stand once, at their declaration, get an underscore before them."""
    count: dict[str, int] = {}
    for t in _tokens(text):
        if t.kind == "name":
            count[t.text] = count.get(t.text, 0) + 1
    for n in read(text):
        names = [n["attrs"]["short"]] if n["kind"] == "variable" and n["attrs"].get("is_exported") != "true" else n["attrs"].get("params", "").split("\x1f") if n["kind"] in ("function", "arrow", "method") else []
        for name in names:
            if count.get(name) == 1 and not name.startswith("_") and name not in KEYWORDS:
                text = _renamed(text, name, f"_{name}")
    return text


def unused_imports(text: str, path: str = "") -> str:
    """Without named imports that nothing else names; an import of which nothing is left goes. Files under ``modules/`` stay."""
    if "/modules/" in path:
        return text
    count: dict[str, int] = {}
    for t in _tokens(text):
        if t.kind == "name":
            count[t.text] = count.get(t.text, 0) + 1

    def one(m: re.Match) -> str:
        kept = [s.strip() for s in m.group(2).split(",") if s.strip() and count.get(re.split(r"\s+", s.strip())[-1], 0) > 1]
        return f"import {m.group(1)}{{ {', '.join(kept)} }} from {m.group(3)}" if kept else f"import {m.group(1).rstrip(', ')} from {m.group(3)}" if m.group(1).strip(", ") not in ("", "type") else ""

    return re.sub(r"import\s+((?:type\s+|[A-Za-z_$][\w$]*\s*,\s*)?)\{([^}]*)\}\s*from\s*(['\"][^'\"]+['\"];?)", one, text)


def react_import(text: str) -> str:
    return text if re.search(r"from\s+['\"]react['\"]", text) else "import React from 'react';\n" + text


def _attribute_fixer(tag: str, attribute: str, value: str) -> Callable[[str], str]:
    def fix(text: str) -> str:
        return _replaced(text, [(n["start"] + 1 + len(tag), n["start"] + 1 + len(tag), f' {attribute}="{value}"') for n in read(text, "x.jsx") if n["kind"] == "jsx" and n["name"] == tag and attribute not in (given := n["attrs"].get("attrs", "").split("\x1f")) and "..." not in given])

    return fix


def self_closing(text: str) -> str:
    """``<a></a>`` becomes ``<a />``."""
    return re.sub(r"<([A-Za-z][\w.]*)([^<>]*?)\s*></\1>", r"<\1\2 />", text)


def boolean_attributes(text: str) -> str:
    return re.sub(r"(\s[A-Za-z-]+)=\{true\}", r"\1", text)


def curly_strings(text: str) -> str:
    """``a={'b'}`` becomes ``a="b"``."""
    return re.sub(r"=\{'([^'\"{}]*)'\}", r'="\1"', text)


def class_name(text: str) -> str:
    return re.sub(r"(<[A-Za-z][^<>]*\s)class=", r"\1className=", text)


def html_for(text: str) -> str:
    return re.sub(r"(<label\b[^<>]*\s)for=", r"\1htmlFor=", text)


def target_blank(text: str) -> str:
    return re.sub(r"(<a\b(?![^<>]*\brel=)[^<>]*target=\"_blank\")", r'\1 rel="noreferrer"', text)


def fragments(text: str) -> str:
    return text.replace("<React.Fragment>", "<>").replace("</React.Fragment>", "</>")


def entities(text: str) -> str:
    """Lone quotes in the text of elements become entities."""
    return re.sub(r">([^<>{}]*)<", lambda m: ">" + m.group(1).replace("'", "&apos;") + "<" if m.group(1).strip() else m.group(0), text)


def duplicate_props(text: str) -> str:
    """The last of equal attributes of a tag stays."""

    def one(m: re.Match) -> str:
        found = list(re.finditer(r"\s+([A-Za-z-]+)=(\"[^\"]*\"|\{[^{}]*\})", m.group(0)))
        last = {a.group(1): a.start() for a in found}
        return _replaced(m.group(0), [(a.start(), a.end(), "") for a in found if last[a.group(1)] != a.start()])

    return re.sub(r"<[A-Za-z][\w.]*(?:\s+[A-Za-z-]+=(?:\"[^\"]*\"|\{[^{}]*\}))+", one, text)


def extension_imports(text: str) -> str:
    """Relative imports without an extension get ``.js``."""
    return re.sub(r"(from\s+|import\s+|import\()(['\"])(\.{1,2}/[^'\"]*?)(?<!\.js)(?<!\.ts)(?<!\.json)(?<!\.vue)(?<!\.css)\2", r"\1\2\3.js\2", text)


def any_parameters(text: str) -> str:
    """Parameters of functions without a type get ``any``."""
    r = Reader(text)
    cuts = []
    for n in r.nodes if r.run() else []:
        if n["kind"] in ("function", "arrow", "method") and n["attrs"].get("params"):
            open_ = next((k for k, t in enumerate(r.t) if t.start >= n["start"] and t.text == "("), None)
            for a, b in r.split(open_ + 1, r.match[open_]) if open_ is not None else []:
                a += r.at(a) == "..."
                end = r.match[a] if r.at(a) in ("{", "[") else a
                if r.at(end + 1) not in (":", "?") and a < b:
                    cuts.append((r.t[end].end, r.t[end].end, ": any"))
    return _replaced(text, cuts)


LINE_FIXERS = {"no-trailing-spaces": trailing_spaces, "eol-last": end_of_file, "no-multiple-empty-lines": empty_lines, "semi": semicolons, "no-unused-expressions": bare_expressions}
SYNTAX_FIXERS: dict[str, Callable[[str], str]] = {
    "quotes": quotes, "eqeqeq": strict_equality, "prefer-const": prefer_const, "no-var": no_var, "object-shorthand": shorthand, "arrow-body-style": arrow_bodies, "no-unused-vars": unused_names, "unused-imports": unused_imports,
    "6133": unused_names, "2835": extension_imports, "7006": any_parameters,
    "react/react-in-jsx-scope": react_import, "react/self-closing-comp": self_closing, "react/jsx-boolean-value": boolean_attributes, "react/jsx-curly-brace-presence": curly_strings, "react/no-unknown-property": lambda t: html_for(class_name(t)),
    "react/jsx-no-target-blank": target_blank, "react/jsx-fragments": fragments, "react/no-unescaped-entities": entities, "react/jsx-no-duplicate-props": duplicate_props,
    "react/button-has-type": _attribute_fixer("button", "type", "button"), "react/alt-text": _attribute_fixer("img", "alt", ""), "react/anchor-is-valid": _attribute_fixer("a", "href", "#"),
    "react/iframe-missing-title": _attribute_fixer("iframe", "title", ""), "react/jsx-key": lambda t: re.sub(r"\.map\((\(?)([A-Za-z_$]\w*)(\)?)\s*=>\s*(\(?)\s*<([A-Za-z][\w.]*)(?![^<>]*\bkey=)", r".map(\1\2\3 => \4<\5 key={\2}", t),
}


def fixed(text: str, rules: list[str]) -> str:
    """The text after each rule's fixer in turn; a fixer that can't read it leaves it."""
    for rule in rules:
        try:
            text = SYNTAX_FIXERS[rule](text)
        except (SyntaxProblem, KeyError, IndexError):
            continue
    return text


def apply(files: DataFrame, rules: list[str], rounds: int = 5) -> DataFrame:
    """``path, content, rounds``: files after the fixers of these rules, again until nothing changes, ``rounds`` times at most.

    Rules on lines are column expressions before the others; unknown rules are left out.
    """
    content = F.col("content")
    for rule in rules:
        content = LINE_FIXERS[rule](content) if rule in LINE_FIXERS else content
    known = [r for r in rules if r in SYNTAX_FIXERS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, took = [], []
            for text in b["content"]:
                text, n = text or "", 0
                while n < rounds and (new := fixed(text, known)) != text:
                    text, n = new, n + 1
                out.append(text)
                took.append(n)
            yield pd.DataFrame({"path": b["path"], "content": out, "rounds": took})

    return files.select("path", content.alias("content")).mapInPandas(run, "path string, content string, rounds int")


def component_imports(files: DataFrame, moved: DataFrame) -> DataFrame:
    """``path, content``: files whose imports of ``old`` specifiers (moved: old, new) name the new ones.

    The moved specifiers of a file are found by a join on those it has, then replaced one after the other.
    """
    specs = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"from\s+['\"]([^'\"]+)['\"]"), F.lit(1)))).alias("old"))
    changes = specs.join(moved, "old").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("c"))
    step = lambda text, c: F.replace(F.replace(text, F.concat(F.lit("'"), c["old"], F.lit("'")), F.concat(F.lit("'"), c["new"], F.lit("'"))), F.concat(F.lit('"'), c["old"], F.lit('"')), F.concat(F.lit('"'), c["new"], F.lit('"')))
    return files.join(changes, "path", "left").select("path", F.when(F.col("c").isNull(), F.col("content")).otherwise(F.aggregate("c", F.col("content"), step)).alias("content"))


def re_export_lines(exports: DataFrame) -> DataFrame:
    """``module, line``: a line that exports again what was moved into a module (module, name); names are sorted."""
    names = exports.groupBy("module").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("n"))
    return names.select("module", F.format_string("export { %s } from './%s';", "n", "module").alias("line"))


def extracted_modules(files: DataFrame, functions: DataFrame, clusters: DataFrame) -> DataFrame:
    """``module, cluster, content``: the sources of each cluster's functions as the text of a file of its own, in the order they
    had; ``functions`` (module, name, start, end) of ``files`` (path, content), ``clusters`` (module, cluster, name)."""
    own = clusters.join(functions, ["module", "name"]).join(files.select(F.col("path").alias("module"), "content"), "module")
    source = F.substring("content", F.col("start") + 1, F.col("end") - F.col("start"))
    parts = own.select("module", "cluster", F.struct("start", F.when(source.startswith("export"), source).otherwise(F.concat(F.lit("export "), source)).alias("s")).alias("p"))
    return parts.groupBy("module", "cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "\n\n").alias("content"))
