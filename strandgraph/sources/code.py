"""Syntax of files as DataFrames: one pass of the reader gives rows of nodes, everything else is a projection of these."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions import paths, rules, text
from strandgraph.operators import resolve

from . import vue
from .javascript import read

NODES = "file string, node_id int, parent_id int, ord int, kind string, name string, start int, end int, line int, end_line int, attrs map<string, string>"
FUNCTIONS = ("function", "arrow", "method")
BRANCHES = ("if", "ternary", "switch", "for", "while", "do", "and", "or", "catch")


def parse(files: DataFrame) -> DataFrame:
    """Nodes of all files (path, content): each file is read by itself, in the batch it comes in. Of a single-file component
    the scripts are read, at the places they have in the file. A null content is empty; what can't be read has an ``error``
    node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "node_id", "parent_id", "ord", "kind", "name", "start", "end", "line", "end_line", "attrs"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                path, content = path or "", content or ""
                content = vue.script_only(content) if path.endswith(".vue") else content
                nodes = read(content, path.removesuffix(".vue") + ".tsx" if path.endswith(".vue") else path)
                rows = [(path, n["node_id"], -1 if n["parent_id"] is None else n["parent_id"], k, n["kind"], path if n["kind"] == "program" else n["name"], n["start"], n["end"], n["line"], n["end_line"], n["attrs"]) for k, n in enumerate(nodes)]
                yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, NODES)


def attr(name: str) -> Column:
    return F.get(F.array(F.try_element_at("attrs", F.lit(name))), F.lit(0))


def flag(name: str) -> Column:
    return F.coalesce(attr(name) == "true", F.lit(False))


def listed(name: str, by: str = "\x1f") -> Column:
    said = F.coalesce(attr(name), F.lit(""))
    return F.when(said == "", F.array().cast("array<string>")).otherwise(F.split(said, by))


def errors(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'error'").select("file", "line", F.col("name").alias("problem"))


def imports(nodes: DataFrame) -> DataFrame:
    """``file, specifier, imported, local, how, is_type_only, line``: a row a name; imports of a module alone, dynamic ones and
    ``require`` have a null name, re-exports import what they name under no local name."""
    whole = nodes.where("kind = 'import'").select("file", F.col("node_id").alias("parent_id"), F.col("name").alias("specifier"), attr("how").alias("how"), flag("is_type_only").alias("type_only"), "line")
    names = nodes.where("kind = 'import_name'").select("file", "parent_id", attr("imported").alias("imported"), F.col("name").alias("local"))
    static = whole.join(names, ["file", "parent_id"], "left").select("file", "specifier", "imported", "local", "how", F.col("type_only").alias("is_type_only"), "line")
    again = nodes.where("kind = 'export_from'").select("file", F.col("name").alias("specifier"), F.explode(listed("names", ",")).alias("imported"), F.lit(None).cast("string").alias("local"), F.lit("re-export").alias("how"), F.lit(False), "line")
    return static.union(again)


def re_exports(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'export_from'").select("file", F.col("name").alias("specifier"), attr("names").alias("names"))


def exports(nodes: DataFrame) -> DataFrame:
    """``file, name, type, is_default, line``."""
    return nodes.where("kind = 'export'").select("file", "name", attr("type").alias("type"), flag("is_default").alias("is_default"), "line")


def functions(nodes: DataFrame) -> DataFrame:
    """``id, file, name, short, kind, class_name, parent_function, depth, ...`` of named and anonymous functions, arrow
    functions in variables, and methods; nested ones have dotted names. Exported by a list of names counts as exported."""
    f = nodes.where(F.col("kind").isin(*FUNCTIONS))
    parent = nodes.where(F.col("kind").isin(*FUNCTIONS)).select("file", F.col("node_id").alias("parent_id"), F.col("name").alias("parent_function"))
    listed_names = nodes.where("kind = 'export' AND attrs['type'] = 'name'").select("file", attr("local").alias("name"), F.lit(True).alias("named")).distinct()
    f = f.join(parent, ["file", "parent_id"], "left").join(listed_names, ["file", "name"], "left")
    return f.select(
        F.concat_ws("#", "file", "name").alias("id"), "file", "node_id", "name", attr("short").alias("short"), "kind", attr("class_name").alias("class_name"), "parent_function", attr("depth").cast("int").alias("depth"),
        listed("params").alias("params"), listed("param_types").alias("param_types"), attr("return_type").alias("return_type"), listed("type_params").alias("type_params"),
        flag("is_async").alias("is_async"), flag("is_generator").alias("is_generator"), flag("has_rest").alias("has_rest"), (flag("is_exported") | F.coalesce("named", F.lit(False))).alias("is_exported"),
        "start", "end", "line", "end_line", attr("body_start").cast("int").alias("body_start"), attr("body_end").cast("int").alias("body_end"), flag("block").alias("block"),
    )


def entities(nodes: DataFrame) -> DataFrame:
    """``id, file, name, type, line, is_exported``: functions, classes, interfaces, types, enums; variables at the top that
    are ``const`` are constants, others variables."""
    top = F.col("kind") == "variable"
    kind = F.when(F.col("kind").isin(*FUNCTIONS), "function").when(top & (attr("declared") == "const"), "constant").otherwise(F.col("kind"))
    named = nodes.where("kind = 'export' AND attrs['type'] = 'name'").select("file", attr("local").alias("name"), F.lit(True).alias("named")).distinct()
    rows = nodes.where(F.col("kind").isin(*FUNCTIONS, "class", "interface", "type", "enum") | (top & (F.col("parent_id") == 0)))
    rows = rows.join(named, ["file", "name"], "left")
    return rows.select(F.concat_ws("#", "file", "name").alias("id"), "file", "name", kind.alias("type"), "line", (flag("is_exported") | F.coalesce("named", F.lit(False))).alias("is_exported"))


def classes(nodes: DataFrame) -> DataFrame:
    """``file, name, extends, implements, methods, properties, is_exported``; the names of members are sorted."""
    inside = nodes.where("kind IN ('method', 'property')").select("file", F.col("parent_id").alias("node_id"), "kind", F.substring_index("name", ".", -1).alias("member"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("member"))))
    members = inside.groupBy("file", "node_id").agg(of("method").alias("methods"), of("property").alias("properties"))
    none = F.array().cast("array<string>")
    own = nodes.where("kind = 'class'").select("file", "node_id", "name", attr("extends").alias("extends"), listed("implements", ",").alias("implements"), flag("is_exported").alias("is_exported"))
    return own.join(members, ["file", "node_id"], "left").select("file", "name", "extends", "implements", F.coalesce("methods", none).alias("methods"), F.coalesce("properties", none).alias("properties"), "is_exported")


def shapes(nodes: DataFrame) -> DataFrame:
    """``file, name, kind, extends, members`` of interfaces and enums, and ``value`` of type aliases."""
    return nodes.where("kind IN ('interface', 'enum', 'type')").select("file", "name", "kind", listed("extends", ",").alias("extends"), listed("members", ",").alias("members"), attr("value").alias("value"))


def constants(nodes: DataFrame) -> DataFrame:
    """``file, name, literal, value, line``: constants at the top of a file with what is written as their value."""
    return nodes.where("kind = 'variable' AND parent_id = 0 AND attrs['declared'] = 'const'").select("file", "name", attr("literal").alias("literal"), attr("value").alias("value"), "line")


def variables(nodes: DataFrame) -> DataFrame:
    """``scope, name, pos, is_const``: declarations, scoped by file and enclosing function, for the operators of ``flow``."""
    scope = F.concat_ws("#", "file", F.when(F.col("name").contains("."), F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)))
    return nodes.where("kind = 'variable'").select(scope.alias("scope"), attr("short").alias("name"), F.col("start").alias("pos"), (attr("declared") == "const").alias("is_const"))


def identifiers(nodes: DataFrame) -> DataFrame:
    """``file, name, pos, line, parent_id``: names that are read; parent is the function or file around them."""
    return nodes.where("kind = 'identifier'").select("file", "name", F.col("start").alias("pos"), "line", "parent_id")


def _owner(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind").isin(*FUNCTIONS)).select("file", F.col("node_id").alias("parent_id"), F.col("name").alias("caller"))


def calls(nodes: DataFrame) -> DataFrame:
    """``file, caller, callee, chain, member, line``: a row a call; the caller is null at the top of a file."""
    c = nodes.where("kind = 'call'").select("file", "parent_id", F.col("name").alias("callee"), attr("chain").alias("chain"), flag("member").alias("member"), attr("first_argument").alias("first_argument"), "line")
    return c.join(_owner(nodes), ["file", "parent_id"], "left").select("file", "caller", "callee", "chain", "member", "first_argument", "line")


def call_graph(nodes: DataFrame) -> DataFrame:
    """``src, dst, type``: edges between functions' ids. A name is taken for a function of the same file, first one that the
    caller holds; ``this.x()`` for a method of the caller's class; ``direct``, ``method``, and ``import`` where the file
    imports the name. A function that holds another one calls it (``nested``)."""
    f = functions(nodes).select("id", "file", "name", "short", "class_name", "parent_function")
    c = calls(nodes).where("caller IS NOT NULL")
    inner = f.select("file", F.col("parent_function").alias("caller"), F.col("short").alias("callee"), F.col("id").alias("inner"))
    top = f.where("parent_function IS NULL AND class_name IS NULL").groupBy("file", F.col("short").alias("callee")).agg(F.min("id").alias("top"))
    method = f.where("class_name IS NOT NULL").select("file", F.col("class_name").alias("cls"), F.col("short").alias("callee"), F.col("id").alias("method"))
    brought = imports(nodes).where("local IS NOT NULL").select("file", F.col("local").alias("callee"), F.concat_ws("#", "specifier", "imported").alias("import")).distinct()
    c = c.withColumn("cls", F.when(F.col("chain") == F.concat(F.lit("this."), F.col("callee")), F.substring_index("caller", ".", 1)))
    c = c.join(inner, ["file", "caller", "callee"], "left").join(top, ["file", "callee"], "left").join(method, ["file", "cls", "callee"], "left").join(brought, ["file", "callee"], "left")
    own = F.when(~F.col("member"), F.coalesce("inner", "top"))
    dst = F.coalesce("method", own, F.when(~F.col("member"), F.col("import")))
    kind = F.when(F.col("method").isNotNull(), "method").when(own.isNotNull(), "direct").otherwise("import")
    found = c.select(F.concat_ws("#", "file", "caller").alias("src"), dst.alias("dst"), kind.alias("type")).where("dst IS NOT NULL")
    nested = f.where("parent_function IS NOT NULL").select(F.concat_ws("#", "file", "parent_function"), "id", F.lit("nested"))
    return found.union(nested).distinct()


def file_graph(nodes: DataFrame) -> DataFrame:
    """``file, src, dst``: which declarations of a file name which others: functions, classes and variables at the top."""
    own = nodes.where("parent_id = 0 AND kind IN ('function', 'arrow', 'class', 'variable', 'interface', 'type', 'enum')").select("file", F.col("name").alias("span"), "start", "end")
    uses = identifiers(nodes).select("file", F.col("name").alias("dst"), "pos")
    inside = resolve.enclosing(uses, own).where("span IS NOT NULL")
    known = own.select("file", F.col("span").alias("dst")).distinct()
    return inside.join(known, ["file", "dst"], "left_semi").where("span <> dst").select("file", F.col("span").alias("src"), "dst").distinct()


def complexity(nodes: DataFrame) -> DataFrame:
    """``id, complexity``: one more than the decision points in a function; those of functions inside it count there."""
    own = functions(nodes).select("file", F.col("node_id").alias("parent_id"), "id")
    points = nodes.where(F.col("kind").isin(*BRANCHES)).groupBy("file", "parent_id").agg(F.count("*").alias("n"))
    return own.join(points, ["file", "parent_id"], "left").select("id", (1 + F.coalesce("n", F.lit(0))).alias("complexity"))


def body_flags(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id`` and the security flags of the source of each function's body."""
    f = functions(nodes).join(files.select(F.col("path").alias("file"), "content"), "file")
    body = F.substring("content", F.col("body_start") + 1, F.col("body_end") - F.col("body_start"))
    return f.select("id", *(c.alias(k) for k, c in rules.security_flags(body).items()))


def unused_names(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """``file, name, kind, line``: functions, variables and parameters whose name stands nowhere else in their file; exported
    ones are used."""
    f = functions(nodes)
    declared = f.where("NOT is_exported AND class_name IS NULL").select("file", F.col("short").alias("name"), F.lit("function").alias("kind"), "line")
    declared = declared.union(nodes.where("kind = 'variable'").where(~flag("is_exported")).select("file", attr("short"), F.lit("variable"), "line"))
    declared = declared.union(f.select("file", F.explode("params"), F.lit("parameter"), "line")).where("name RLIKE '^[A-Za-z_$][A-Za-z0-9_$]*$' AND NOT name LIKE '\\_%'")
    words = files.select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit("([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))).alias("name")).groupBy("file", "name").agg(F.count("*").alias("n"))
    return declared.distinct().join(words.where("n = 1"), ["file", "name"], "left_semi")


def duplicate_exports(nodes: DataFrame) -> DataFrame:
    """``file, name, times``: names that a file exports more than once."""
    return exports(nodes).groupBy("file", "name").agg(F.count("*").alias("times")).where("times > 1")


def signatures(nodes: DataFrame) -> DataFrame:
    """Signatures of functions, arrow functions and methods, as ``operators.signatures`` compares them; repeated names are
    numbered in the order of the file."""
    from strandgraph.operators import signatures as compare

    f = functions(nodes).select("file", "node_id", F.col("name"), "params", "param_types", "return_type", "is_async", "is_exported", "type_params", "is_generator", "has_rest", "class_name")
    return compare.numbered(f, ["file", "node_id"]).drop("node_id")


def elements(nodes: DataFrame) -> DataFrame:
    """``file, parent, tag, props, is_component, line``: elements; components begin in upper case."""
    e = nodes.where("kind = 'jsx'").select("file", "parent_id", "node_id", F.col("name").alias("tag"), listed("attrs").alias("props"), "line")
    return e.join(_owner(nodes), ["file", "parent_id"], "left").select("file", F.col("caller").alias("parent"), "tag", "props", F.col("tag").rlike("^[A-Z]").alias("is_component"), "line")


def component_props(nodes: DataFrame) -> DataFrame:
    """``tag, props``: what each component is given anywhere."""
    given = elements(nodes).where("is_component").select("tag", F.explode_outer("props").alias("prop"))
    return given.groupBy("tag").agg(F.array_sort(F.collect_set("prop")).alias("props"))


def element_issues(nodes: DataFrame) -> DataFrame:
    """``file, rule, tag, line``: elements in a file that doesn't import React, links without href, images without alt, buttons
    without type, handlers without ``on``."""
    e = elements(nodes)
    has = lambda p: F.array_contains("props", p) | F.array_contains("props", "...")
    react = imports(nodes).where("specifier = 'react'").select("file").distinct()
    missing = e.select("file").distinct().join(react, "file", "left_anti").select("file", F.lit("React isn't imported").alias("rule"), F.lit(None).cast("string").alias("tag"), F.lit(1).alias("line"))
    rules_ = [("a", "href", "link without href"), ("img", "alt", "image without alt"), ("button", "type", "button without type")]
    out = missing
    for tag, prop, rule in rules_:
        out = out.union(e.where((F.col("tag") == tag) & ~has(prop)).select("file", F.lit(rule), "tag", "line"))
    return out


def event_handlers(nodes: DataFrame) -> DataFrame:
    """``file, name, event``: calls that bind or raise events, and attributes that begin with ``on``."""
    attribute = elements(nodes).select("file", F.explode("props").alias("name"), F.lit(None).cast("string").alias("argument"), F.lit(True).alias("attribute"))
    called = calls(nodes).select("file", F.col("callee").alias("name"), F.regexp_replace("first_argument", "^['\"]|['\"]$", "").alias("argument"), F.lit(False).alias("attribute"))
    every = attribute.union(called)
    n, a = F.col("name"), F.col("attribute")
    return every.where(text.is_event_handler(n, a)).select("file", "name", text.event_type(n, F.col("argument"), a).alias("event"))


# --- by patterns only: what large files get, and a check on the reader ---


def by_patterns(files: DataFrame) -> DataFrame:
    """``path, type, imports, exports, functions, components, composables`` of each file, by regular expressions alone."""
    c, p = F.col("content"), F.col("path")
    every = lambda pattern, group=1: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)))
    none = F.array().cast("array<string>")
    kind = F.coalesce(*(F.when(p.endswith("." + e), e) for e in ("vue", "tsx", "jsx", "ts")), F.lit("js"))
    declared = every(r"(?:^|[^A-Za-z0-9_$])function\s+([A-Za-z0-9_$]+)\s*\(")
    arrows = every(r"(?:const|let)\s+([A-Za-z0-9_$]+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")
    used = F.when(p.endswith(".vue"), every(r"import\s+([A-Za-z0-9_$]+)\s+from\s+['\"][^'\"]+\.vue['\"]")).when(p.rlike(r"\.[jt]sx$"), every("<([A-Z][a-zA-Z0-9]*)")).otherwise(none)
    composables = F.when(p.endswith(".vue"), every(r"(?:^|[^A-Za-z0-9_$])(use[A-Za-z0-9_]+)\s*\(")).otherwise(none)
    return files.select("path", kind.alias("type"), every(r"import\s[^;'\"]*?from\s+['\"]([^'\"]+)['\"]").alias("imports"), every(r"export\s+(?:default\s+)?(?:async\s+)?(?:function|const|let|var|class)\s+([A-Za-z0-9_$]+)").alias("exports"), F.array_distinct(F.concat(declared, arrows)).alias("functions"), used.alias("components"), composables.alias("composables"))


def parse_or_patterns(files: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes of files up to ``limit`` characters, facets by patterns of the larger ones)."""
    from .files import LARGE

    large = F.coalesce(F.length("content"), F.lit(0)) > (LARGE if limit is None else limit)
    return parse(files.where(~large)), by_patterns(files.where(large))


def project_edges(files: DataFrame, nodes: DataFrame, aliases: list[tuple[str, str]] | None = None, root: str = "") -> DataFrame:
    """``src, dst, type``: module edges: ``import``, ``re-export``, or ``external`` to what no file of the project is."""
    found = imports(nodes).select("file", "specifier", "how").distinct()
    resolved = resolve.resolve_imports(found.select("file", "specifier"), files, aliases, root)
    kind = F.when(F.col("resolved").isNull(), "external").when(F.col("how") == "re-export", "re-export").otherwise("import")
    return found.join(resolved, ["file", "specifier"]).select(F.col("file").alias("src"), F.coalesce("resolved", "specifier").alias("dst"), kind.alias("type")).distinct()


def folder_expansion(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``edges`` where one that leads to an index file is joined by those to what the index re-exports."""
    again = re_exports(nodes).select("file", "specifier").distinct()
    more = resolve.resolve_imports(again, files).where("resolved IS NOT NULL")
    through = edges.join(more.select(F.col("file").alias("dst"), "resolved"), "dst").where(F.col("dst").rlike(r"(^|/)index\.[a-z]+$"))
    return edges.union(through.select("src", F.col("resolved").alias("dst"), F.lit("re-export").alias("type"))).distinct()


def ranked_languages(files: DataFrame) -> DataFrame:
    return files.groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("size").alias("size")).orderBy(F.desc("files"), "language")


def repeated_names(nodes: DataFrame) -> DataFrame:
    """Functions with how many of the same name came before them in the project."""
    n = F.row_number().over(Window.partitionBy("name").orderBy("file", "node_id")) - 1
    return functions(nodes).select("id", "name", n.alias("before"))
