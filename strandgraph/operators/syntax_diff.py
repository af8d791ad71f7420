"""Comparing trees: nodes of two versions, matched by where they stand.

Nodes (tree, node, parent, ord, kind, name, flags); a root's parent is null. Every subtree gets a hash, from the leaves up: a
node's own values and, of each child, its place among the siblings and its hash, combined by an aggregate that needs no list
of children. Two versions are then compared from the roots down, and only below pairs whose hashes differ; trees may be of any
depth. A difference is a place that one side lacks or where kind, name or flags differ; a place below one that a side lacks
is no difference of its own. The first one in reading order is what a comparison reports; its confidence falls with what differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import text

from .lineage import cut
from .ranking import numbered

#: How sure a verdict of "different" is, by what differs. Fixed values.
CONFIDENCE = {"missing": 0.5, "kind": 0.5, "name": 0.7, "flags": 0.8, "count": 0.9}
FLAGS = ("is_async", "is_exported", "is_generator", "return_type", "params", "extends")
NODE = ("kind", "name", "flags")


def syntax_trees(nodes: DataFrame) -> DataFrame:
    """Nodes of syntax (file, node_id, parent_id, ord, kind, name, attrs) as trees; positions in the text don't matter."""
    flags = F.concat_ws("\x1f", *(F.coalesce(F.get(F.array(F.try_element_at("attrs", F.lit(f))), F.lit(0)), F.lit("")) for f in FLAGS))
    rows = nodes.where("kind NOT IN ('identifier', 'error')")
    parent = F.when(F.col("parent_id") >= 0, F.col("parent_id"))
    return rows.select(F.col("file").alias("tree"), F.col("node_id").alias("node"), parent.alias("parent"), "ord", "kind", F.when(F.col("kind") == "program", "").otherwise(F.col("name")).alias("name"), flags.alias("flags"))


def hashed(nodes: DataFrame) -> DataFrame:
    """``tree, node, parent, place, kind, name, flags, hash``: each node with its place from 0 among its siblings and the hash
    (two 64-bit halves) of all that is below and of itself; inner nodes that hang on no root are left out.

    Leaves, which most nodes are, are hashed at once and summed up by parent; only inner nodes go by levels."""
    rows = numbered(nodes.withColumn("family", F.struct("tree", "parent")), "family", "ord", "node")
    rows = cut(rows.select("tree", "node", "parent", F.col("at").alias("place"), *NODE))
    own = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in NODE]
    half = lambda seed, *of: F.xxhash64(F.lit(seed), *of)
    child = lambda seed: F.bit_xor(half(seed, "place", "hash.one", "hash.two"))
    whole = lambda *inside: F.struct(half(3, *own, *inside).alias("one"), half(4, *own, *inside).alias("two")).alias("hash")
    below = lambda of: of.where("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(child(1).alias("one"), child(2).alias("two"), F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    above = cut(rows.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct())
    leaves = cut(rows.join(above, ["tree", "node"], "left_anti").select(*rows.columns, whole(none, none, none)))
    sums = cut(below(leaves))
    every = cut(rows.join(above, ["tree", "node"], "left_semi").select(*rows.columns))
    levels = [every.where("parent IS NULL")]
    inner = every.where("parent IS NOT NULL")
    while True:
        up = levels[-1].select("tree", F.col("node").alias("parent"))
        level = cut(inner.join(up, ["tree", "parent"]).select(*rows.columns))
        if level.isEmpty():
            break
        levels.append(level)
    done, last = leaves, None
    for level in reversed(levels):
        inside = sums if last is None else sums.union(below(last)).groupBy("tree", "node").agg(F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"), F.sum("n").alias("n"))
        level = level.join(inside, ["tree", "node"], "left")
        last = cut(level.select(*rows.columns, whole(*(F.coalesce(c, none) for c in ("one", "two", "n")))))
        done = done.union(last)
    return done


def tree_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``tree, path, what, original, modified``: all places that differ in trees of the same name; a path is the places on the
    way from the root. A tree that only one side has differs at its root."""
    sides = [hashed(t).select(F.col("tree").alias("t"), "parent", F.col("place").alias("p"), F.struct("node", F.struct(*NODE).alias("own"), "hash").alias("side")) for t in (a, b)]
    none = F.lit(None).cast(sides[0].schema["side"].dataType)

    def matched(x: DataFrame, y: DataFrame) -> DataFrame:
        """What stands at the same place of a pair, of either side; grouped, as each side has one row a place at most."""
        every = x.withColumnsRenamed({"side": "x"}).withColumn("y", none).unionByName(y.withColumnRenamed("side", "y").withColumn("x", none))
        both = every.groupBy("t", "path", "p").agg(F.first("x", ignorenulls=True).alias("x"), F.first("y", ignorenulls=True).alias("y"))
        return both.where("NOT x.hash <=> y.hash").select("t", F.concat("path", F.array("p")).alias("path"), "x", "y")

    tops = (s.where("parent IS NULL").select("t", F.array().cast("array<long>").alias("path"), "p", "side") for s in sides)
    level, found = matched(*tops), None
    while True:
        level = cut(level)
        if found is not None and level.isEmpty():
            return found
        what = F.when(F.col("x").isNull() | F.col("y").isNull(), "missing")
        for c in NODE:
            what = what.when(~F.col(f"x.own.{c}").eqNullSafe(F.col(f"y.own.{c}")), c)
        shown = lambda s: F.when(F.col(s).isNotNull(), F.concat_ws(" ", f"{s}.own.kind", f"{s}.own.name"))
        told = level.select(F.col("t").alias("tree"), "path", what.alias("what"), shown("x").alias("original"), shown("y").alias("modified")).where("what IS NOT NULL")
        found = told if found is None else found.union(told)
        pairs = level.where("x IS NOT NULL AND y IS NOT NULL")
        below = (pairs.select("t", "path", F.col(f"{n}.node").alias("parent")).join(s, ["t", "parent"]).select("t", "path", "p", "side") for n, s in zip("xy", sides, strict=True))
        level = matched(*below)


def _confidence(what: Column) -> Column:
    out = F.lit(1.0)
    for k, v in CONFIDENCE.items():
        out = F.when(what == k, v).otherwise(out)
    return out


def tree_verdicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``tree, equivalent, confidence, what, original, modified``: each tree's first difference in reading order, if any."""
    first = tree_differences(a, b).groupBy("tree").agg(F.min_by(F.struct("what", "original", "modified"), "path").alias("d"))
    names = a.select("tree").union(b.select("tree")).distinct()
    return names.join(first, "tree", "left").select("tree", F.col("d").isNull().alias("equivalent"), _confidence(F.col("d.what")).alias("confidence"), "d.what", "d.original", "d.modified")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``file, path, what, original, modified, impact``: all places that differ, of files of syntax with the same name."""
    impact = F.when(F.col("what").isin("missing", "kind"), "high").otherwise(text.change_impact(F.when(F.col("what") == "flags", "isAsync").otherwise("name")))
    return tree_differences(syntax_trees(a), syntax_trees(b)).withColumnRenamed("tree", "file").withColumn("impact", impact)


def verdicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """``file, equivalent, confidence, what, original, modified``: each file's first difference in reading order, if any."""
    return tree_verdicts(syntax_trees(a), syntax_trees(b)).withColumnRenamed("tree", "file")
