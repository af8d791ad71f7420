"""Joins that resolve names: import specifiers to files, calls to functions, identifiers to enclosing functions and imports.

"First hit wins" is a row number over the candidates' order. Candidates are made as rows, so each lookup is a hash join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions import paths

from .lineage import cut

#: What is tried after a path, in this order. Fixed values.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "")
ALIAS_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".vue", ".mjs", ".cjs", "")


def _candidates(base: Column) -> Column:
    """Paths a base path may stand for, in the order they are tried."""
    swapped = F.when(base.endswith(".js"), F.regexp_replace(base, r"\.js$", ".ts")).when(base.endswith(".ts"), F.regexp_replace(base, r"\.ts$", ".js"))
    tried = [base, swapped, *(F.concat(base, F.lit(e)) for e in EXTENSIONS if e), *(F.concat(base, F.lit(f"/index{e}")) for e in EXTENSIONS)]
    return F.array_compact(F.array(*tried))


def expand_aliases(imports: DataFrame, aliases: list[tuple[str, str]], key: list[str], base_url: str = "") -> DataFrame:
    """``imports`` (key, specifier) with ``alias_base``: the path of the first alias pattern that fits, its ``*`` filled in;
    null where none fits. The patterns are a project's settings, a handful, so they become one expression."""
    base = F.lit(None).cast("string")
    for pattern, target in reversed(aliases):
        shape = "^" + "(.*)".join(re.escape(p).replace("/", "\\/") for p in pattern.split("*")) + "$"
        path = F.lit(f"{base_url}/{target}" if base_url else target)
        filled = path
        for i in range(1, pattern.count("*") + 1):
            before, after = F.substring_index(filled, "*", 1), F.expr("''")
            after = F.substring(filled, F.length(before) + 2, F.length(filled))
            filled = F.when(filled.contains("*"), F.concat(before, F.regexp_extract("specifier", shape, i), after)).otherwise(filled)
        base = F.when(F.col("specifier").rlike(shape), paths.collapsed(filled)).otherwise(base)
    return imports.select(*key, "specifier", base.alias("alias_base"))


def resolve_imports(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, str]] | None = None, root: str = "") -> DataFrame:
    """``file, specifier, resolved``: the file each import means, null where there is none.

    ``imports`` (file, specifier), ``files`` (path). A path itself comes first, then .js for .ts and the other way, then the
    extensions, then a folder's index; aliases come before all of that, the same from the project's root after it.
    Packages aren't files of the project and stay null. Repeated imports are one row.
    """
    key = imports.select("file", "specifier").where("file IS NOT NULL AND specifier IS NOT NULL").distinct()
    key = expand_aliases(key, aliases or [], ["file"])
    spec = F.col("specifier")
    own = F.when(spec.startswith("/"), spec).otherwise(F.concat(paths.directory(F.col("file")), F.lit("/"), spec))
    from_root = F.concat(F.lit(f"{root}/" if root else ""), spec)
    alias = F.col("alias_base")
    by_alias = F.when(alias.isNotNull(), F.array_compact(F.array(*(c for e in ALIAS_EXTENSIONS for c in ([F.concat(alias, F.lit(e))] + [F.concat(alias, F.lit(f"/index{e}"))] * bool(e))))))
    empty = F.array().cast("array<string>")
    tried = F.concat(F.coalesce(by_alias, empty), _candidates(paths.collapsed(own)), _candidates(paths.collapsed(from_root)))
    rows = key.select("file", "specifier", F.posexplode(tried).alias("at", "path"))
    hits = rows.join(files.select("path").distinct(), "path").groupBy("file", "specifier").agg(F.min_by("path", "at").alias("resolved"))
    return key.select("file", "specifier").join(hits, ["file", "specifier"], "left")


def unresolved_imports(resolved: DataFrame) -> DataFrame:
    """Imports of the project's own files that mean none."""
    return resolved.where(F.col("resolved").isNull() & F.col("specifier").rlike(r"^\."))


def missing_exports(imports: DataFrame, resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """``file, specifier, imported``: named imports of a resolved file that doesn't export the name. ``imports`` (file,
    specifier, imported); ``default`` and ``*`` are taken as there."""
    named = imports.where(~F.col("imported").isin("default", "*")).select("file", "specifier", "imported").distinct()
    meant = named.join(resolved.where("resolved IS NOT NULL"), ["file", "specifier"])
    return meant.join(exports.select(F.col("file").alias("resolved"), F.col("name").alias("imported")), ["resolved", "imported"], "left_anti").select("file", "specifier", "imported")


def dead_exports(exports: DataFrame, imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """``file, name``: exports no other file imports; ``* as`` and re-exports of everything use all names of a file."""
    used = imports.join(resolved.where("resolved IS NOT NULL"), ["file", "specifier"]).where("file <> resolved").select(F.col("resolved").alias("file"), F.col("imported").alias("name"))
    whole = used.where("name = '*'").select("file").distinct()
    return exports.select("file", "name").distinct().join(whole, "file", "left_anti").join(used, ["file", "name"], "left_anti")


def resolve_calls(calls: DataFrame, functions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``module, caller, callee, target, target_module``: of the functions of a call's name the one in its own module, else
    the first by module and id; null where there is none.

    ``calls`` (module, caller, callee), ``functions`` (id, module, name). Functions are first cut down to the one of each
    (module, name) and the first of each name, so a name that thousands share isn't joined to all of them.
    """
    first = lambda *key: functions.groupBy(*key).agg(F.min(F.struct("module", "id")).alias("best"))
    inside = first("module", "name").select("module", F.col("name").alias("callee"), F.col("best.id").alias("own"))
    outside = first("name").select(F.col("name").alias("callee"), F.col("best.id").alias("other"), F.col("best.module").alias("other_module"))
    found = calls.join(inside, ["module", "callee"], "left").join(outside, "callee", "left")
    target = F.coalesce("own", "other")
    return found.select("module", "caller", "callee", target.alias("target"), F.when(F.col("own").isNotNull(), F.col("module")).otherwise(F.col("other_module")).alias("target_module"))


def resolve_by_any_key(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """``caller, callee, target``: the entity whose name, id or id after its last ``#`` is the callee, the first by id."""
    keys = entities.select("id", F.explode(F.array_distinct(F.array(F.col("name"), F.col("id"), F.substring_index("id", "#", -1)))).alias("callee"))
    return calls.join(keys.groupBy("callee").agg(F.min("id").alias("target")), "callee", "left").select("caller", "callee", "target")


def enclosing(points: DataFrame, spans: DataFrame, file: str = "file", pos: str = "pos", cell: int = 1024) -> DataFrame:
    """Each point with ``span``, the innermost span (file, span, start, end) with start <= pos < end; null outside of all.

    Spans are dealt to cells of ``cell`` positions by which points find them, so the join is a hash join on (file, cell)
    and no file is compared whole with itself; spans of equal starts go to the shorter, then the smaller name.
    """
    near = spans.select(F.col(file), "span", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / cell), F.greatest(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)))).alias("cell"))
    keyed = points.withColumn("cell", F.floor(F.col(pos) / cell))
    columns = points.columns
    inside = keyed.select(file, pos, "cell").distinct().join(near, [file, "cell"]).where((F.col("start") <= F.col(pos)) & (F.col(pos) < F.col("end")))
    best = inside.groupBy(file, pos).agg(F.min_by("span", F.struct(-F.col("start"), "end", "span")).alias("span"))
    return points.join(best, [file, pos], "left").select(*columns, "span")


def impact(target_file: str, entity: str, imports: DataFrame, resolved: DataFrame, uses: DataFrame, spans: DataFrame) -> DataFrame:
    """``file, local, pos, span``: where files that import an entity use it under the name they gave it, and in which
    function (null: at the top). ``imports`` (file, specifier, imported, local), ``uses`` (file, name, pos)."""
    by = imports.join(resolved.where(F.col("resolved") == target_file), ["file", "specifier"]).where(F.col("imported").isin(entity, "*")).select("file", "local").distinct()
    found = uses.join(by, (uses["file"] == by["file"]) & (uses["name"] == by["local"])).select(uses["file"], "local", "pos")
    return enclosing(found, spans)


def handed_on(exports: DataFrame, re_exports: DataFrame) -> DataFrame:
    """``file, name, origin_file, origin_name, hops``: every file and name under which an export can be imported: its own (0
    hops), and those that chains of re-exports of any length give it, each with the fewest hops.

    ``exports`` (file, name); ``re_exports`` (file, name, from_file, imported): the file exports what is ``imported`` there as
    ``name``; with ``*`` for both, all that the other file exports but ``default``. Rows with a null anywhere are left out.
    Only what is new goes on in a round, so chains that close end there.
    """
    key = ["file", "name", "origin_file", "origin_name"]
    lines = cut(re_exports.select("from_file", "imported", F.col("file").alias("to"), F.col("name").alias("as")).dropna().distinct())
    by_name, whole = lines.where("imported <> '*'"), lines.where("imported = '*'").drop("imported", "as")
    front = cut(exports.select("file", "name", F.col("file").alias("origin_file"), F.col("name").alias("origin_name")).dropna().distinct().withColumn("hops", F.lit(0)))
    seen, hops = front, 0
    while not front.isEmpty():
        hops += 1
        named = front.join(by_name, (F.col("file") == F.col("from_file")) & (F.col("name") == F.col("imported"))).select(F.col("to").alias("file"), F.col("as").alias("name"), "origin_file", "origin_name")
        every = front.where("name <> 'default'").join(whole, F.col("file") == F.col("from_file")).select(F.col("to").alias("file"), "name", "origin_file", "origin_name")
        front = cut(named.union(every).distinct().join(seen.select(*key), key, "left_anti").withColumn("hops", F.lit(hops)))
        seen = seen.union(front)
        if hops % 6 == 0:
            seen = cut(seen)
    return seen


def first_of_name(entities: DataFrame, name: str = "name") -> DataFrame:
    """``name, module``: the module of the first entity of a name, by id."""
    return entities.groupBy(name).agg(F.min_by("module", "id").alias("module"))


def with_origin(functions: DataFrame, known: DataFrame) -> DataFrame:
    """``functions`` (name, path, ...) enriched by the first of ``known`` (name, path, line) whose path holds theirs or is
    held by it."""
    pairs = functions.select("name", "path").distinct().join(known.select("name", F.col("path").alias("known_path"), "line"), "name")
    pairs = pairs.where(F.col("known_path").contains(F.col("path")) | F.col("path").contains(F.col("known_path")))
    best = pairs.groupBy("name", "path").agg(F.min(F.struct("known_path", "line")).alias("k")).select("name", "path", F.col("k.known_path").alias("origin"), F.col("k.line").alias("line"))
    return functions.join(best, ["name", "path"], "left")


def component_kinds(tags: DataFrame, imports: DataFrame, local: DataFrame) -> DataFrame:
    """``file, tag, kind``: a tag is ``intrinsic`` (it begins in lower case), ``imported``, ``local`` or ``unknown``."""
    t = tags.select("file", "tag").distinct()
    t = t.join(imports.select("file", F.col("local").alias("tag"), F.lit(True).alias("i")).distinct(), ["file", "tag"], "left")
    t = t.join(local.select("file", F.col("name").alias("tag"), F.lit(True).alias("l")).distinct(), ["file", "tag"], "left")
    return t.select("file", "tag", F.when(F.col("tag").rlike("^[a-z]"), "intrinsic").when(F.col("i"), "imported").when(F.col("l"), "local").otherwise("unknown").alias("kind"))


def rank_first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
