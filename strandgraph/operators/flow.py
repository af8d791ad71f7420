"""Control and data flow of functions.

Statements (fn, pos, kind, target): ``kind`` is ``plain``, ``branch`` (goes on or to ``target``), ``jump`` (to ``target``) or
``return``; ``pos`` counts from 0 in a function. All functions are handled at once; blocks are named ``fn:number``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import CodeGraph
from .lineage import cut

ENTRY, EXIT = "entry", "exit"
#: Statements up to which a function's definitions are followed in one row; those of longer functions go by rounds over tables.
ONE_ROW = 2000


def leaders(statements: DataFrame) -> DataFrame:
    """``statements`` with ``leader``: the first of a function, targets, and what follows a branch, jump or return."""
    targets = statements.where("kind IN ('branch', 'jump') AND target IS NOT NULL").select("fn", F.col("target").alias("pos")).distinct().withColumn("aimed", F.lit(True))
    order = Window.partitionBy("fn").orderBy("pos")
    ends = F.lag(F.col("kind") != "plain").over(order)
    return statements.join(targets, ["fn", "pos"], "left").withColumn("leader", F.coalesce("aimed", F.lit(False)) | F.coalesce(ends, F.lit(True))).drop("aimed")


def blocks(statements: DataFrame) -> DataFrame:
    """``fn, pos, kind, target, block``: each statement with the number of its basic block, from 0."""
    order = Window.partitionBy("fn").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return leaders(statements).withColumn("block", (F.sum(F.col("leader").cast("int")).over(order) - 1).cast("int")).drop("leader")


def cfg(statements: DataFrame) -> DataFrame:
    """``fn, src, dst``: edges between blocks, an entry and an exit in each function. A target outside of it is the exit."""
    return _edges_between(blocks(statements))


def _edges_between(b: DataFrame) -> DataFrame:
    last = b.groupBy("fn", "block").agg(F.max_by(F.struct("kind", "target"), "pos").alias("l"))
    name = lambda c: F.concat_ws(":", F.col("fn").cast("string"), c)
    following = F.lead("block").over(Window.partitionBy("fn").orderBy("block"))
    last = last.withColumn("next", following)
    aim = b.select("fn", F.col("pos").alias("aim"), F.col("block").alias("aimed"))
    last = last.withColumn("aim", F.col("l.target")).join(aim, ["fn", "aim"], "left")
    onward = F.when(F.col("next").isNotNull(), name(F.col("next").cast("string"))).otherwise(name(F.lit(EXIT)))
    there = F.when(F.col("aimed").isNotNull(), name(F.col("aimed").cast("string"))).otherwise(name(F.lit(EXIT)))
    kind = F.col("l.kind")
    to = F.when(kind == "return", F.array(name(F.lit(EXIT)))).when(kind == "jump", F.array(there)).when(kind == "branch", F.array(onward, there)).otherwise(F.array(onward))
    inner = last.select("fn", name(F.col("block").cast("string")).alias("src"), F.explode(F.array_distinct(to)).alias("dst"))
    first = b.select("fn").distinct().select("fn", name(F.lit(ENTRY)).alias("src"), name(F.lit("0")).alias("dst"))
    return inner.union(first)


def cfg_graph(statements: DataFrame) -> tuple[CodeGraph, DataFrame]:
    edges = cfg(statements)
    return CodeGraph(edges), edges.select("fn").distinct().select(F.concat_ws(":", F.col("fn").cast("string"), F.lit(ENTRY)).alias("node"))


def scopes(statements: DataFrame) -> DataFrame:
    """``node, scope``: the function that each block, entry and exit of the flow graph belongs to."""
    edges = cfg(statements)
    return edges.select(F.col("src").alias("node"), F.col("fn").alias("scope")).union(edges.select("dst", "fn")).distinct()


def complexity(statements: DataFrame) -> DataFrame:
    """``fn, edges, nodes, complexity``: the graph's E - N + 2, 1 at least; entry and exit are nodes."""
    edges = cfg(statements)
    nodes = edges.select("fn", F.col("src").alias("n")).union(edges.select("fn", "dst")).distinct().groupBy("fn").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("fn").agg(F.count("*").alias("edges")).join(nodes, "fn")
    return e.select("fn", "edges", "nodes", F.greatest(F.lit(1), F.col("edges") - F.col("nodes") + 2).alias("complexity"))


def decision_complexity(nodes: DataFrame) -> DataFrame:
    """``fn, complexity``: one more than the decision points among a function's syntax nodes (fn, kind)."""
    points = F.col("kind").isin("if", "ternary", "switch", "for", "while", "do", "and", "or", "catch")
    return nodes.groupBy("fn").agg((1 + F.count_if(points)).alias("complexity"))


# --- data flow: defs (scope, name, pos, is_const), uses (scope, name, pos) ---


def def_use(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``scope, name, def_pos, use_pos``: each use with the last definition before it; null if there is none.

    Both go through one sort of (scope, name) by position; no pair is made that isn't an answer.
    """
    d = defs.select("scope", "name", "pos", F.lit(True).alias("is_def"))
    every = d.union(uses.select("scope", "name", "pos", F.lit(False)))
    order = Window.partitionBy("scope", "name").orderBy("pos", F.desc("is_def")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("is_def"), F.col("pos")), ignorenulls=True).over(order)
    return every.withColumn("def_pos", last).where("NOT is_def").select("scope", "name", "def_pos", F.col("pos").alias("use_pos"))


def first_definitions(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``scope, name, def_pos, use_pos``: the first definition of a name with each use after it, at once a definition too."""
    first = defs.groupBy("scope", "name").agg(F.min("pos").alias("def_pos"))
    return uses.join(first, ["scope", "name"]).where("def_pos < pos").select("scope", "name", "def_pos", F.col("pos").alias("use_pos"))


def chain(defs: DataFrame, uses: DataFrame, scope, name: str) -> DataFrame:
    """``pos, role``: all places of a variable."""
    mine = (F.col("scope") == scope) & (F.col("name") == name)
    return defs.where(mine).select("pos", F.lit("def").alias("role")).union(uses.where(mine).select("pos", F.lit("use")))


def variable_stats(defs: DataFrame, uses: DataFrame) -> DataFrame:
    """One row: ``total, used, unused, constants, reassigned_constants``; a variable is a (scope, name)."""
    v = defs.groupBy("scope", "name").agg(F.count("*").alias("n"), F.bool_or("is_const").alias("const"))
    v = v.join(uses.select("scope", "name", F.lit(True).alias("used")).distinct(), ["scope", "name"], "left")
    used = F.coalesce("used", F.lit(False))
    return v.agg(F.count("*").alias("total"), F.count_if(used).alias("used"), F.count_if(~used).alias("unused"), F.count_if("const").alias("constants"), F.count_if(F.col("const") & (F.col("n") > 1)).alias("reassigned_constants"))


def reassigned(defs: DataFrame) -> DataFrame:
    """``scope, name, times``: constants that are defined more than once."""
    return defs.where("is_const").groupBy("scope", "name").agg(F.count("*").alias("times")).where("times > 1")


# --- data flow along the control flow: statements as above, defs and uses (fn, pos, name) ---


def definitions_at_blocks(statements: DataFrame, defs: DataFrame, one_row: int = ONE_ROW) -> DataFrame:
    """``fn, block, name, def_pos``: definitions that reach the beginning of a block on some way, blocks as in ``cfg``.

    The fixpoint of the sets that blocks generate and let pass. A function of up to ``one_row`` statements is a row, with the
    edges and last definitions of its blocks as lists; longer ones go by rounds over tables, at any length.
    """
    return _definitions_at(cut(blocks(statements)), defs, one_row)


def _definitions_at(b: DataFrame, defs: DataFrame, one_row: int) -> DataFrame:
    inside = b.select("fn", "pos", "block").join(defs.select("fn", "pos", "name").distinct(), ["fn", "pos"])
    label = F.concat_ws(":", F.col("fn").cast("string"), F.col("block").cast("string"))
    last = inside.groupBy("fn", label.alias("block"), "name").agg(F.max("pos").alias("def_pos"))
    edges = _edges_between(b).select("fn", "src", "dst")
    long = cut(b.groupBy("fn").agg(F.count("*").alias("n")).where(F.col("n") > one_row).select("fn"))
    if long.isEmpty():
        return _by_function(last, edges)
    some = _by_function(last.join(long, "fn", "left_anti"), edges.join(long, "fn", "left_anti"))
    return some.union(_by_rounds(last.join(long, "fn", "left_semi"), edges.join(long, "fn", "left_semi")))


def _by_function(last: DataFrame, edges: DataFrame) -> DataFrame:
    """``fn, block, name, def_pos`` of functions whose edges (fn, src, dst) and last definitions of blocks are a row each."""
    line, definition = F.struct("src", "dst"), F.struct("block", "name", "def_pos")
    none = lambda of: F.lit(None).cast(of.schema["x"].dataType)
    lines, own = edges.select("fn", line.alias("x")), last.select("fn", definition.alias("x"))
    rows = lines.select("fn", F.col("x").alias("line"), none(own).alias("own")).union(own.select("fn", none(lines), F.col("x")))
    rows = rows.groupBy("fn").agg(F.collect_list("line").alias("lines"), F.collect_list("own").alias("own")).where(F.size("own") > 0)

    kind = last.schema
    kinds = lambda batch: [batch.column(0).type, *(f.type for f in batch.column(2).type.value_type)]
    one = lambda fn, lines, own: ((fn, *r) for r in _reaching(lines, own))
    return _many_of_each(rows, one, kinds, f"fn {kind['fn'].dataType.simpleString()}, block string, name {kind['name'].dataType.simpleString()}, def_pos {kind['def_pos'].dataType.simpleString()}", 4)


def _many_of_each(rows: DataFrame, one: Callable, kinds: Callable, schema: str, width: int) -> DataFrame:
    """The tuples that ``one`` makes of each row, of Arrow types ``kinds`` by the batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            pack = lambda rows, of=kinds(batch): pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], of[k]) for k in range(width)], names=names)
            for row in zip(*batch.columns, strict=True):
                out += one(*(v.as_py() for v in row))
                if len(out) >= 50_000:
                    yield pack(out)
                    out = []
            yield pack(out)

    return rows.mapInArrow(each, schema)


def _reaching(lines: list[dict], own: list[dict]) -> Iterator[tuple]:
    """(block, name, position) of one function; a set of definitions is a number with a bit for each."""
    after: dict = {}
    for e in lines:
        after.setdefault(e["src"], []).append(e["dst"])
    of_name: dict = {}
    for i, d in enumerate(own):
        of_name[d["name"]] = of_name.get(d["name"], 0) | 1 << i
    made: dict = {}
    stopped: dict = {}
    for i, d in enumerate(own):
        made[d["block"]] = made.get(d["block"], 0) | 1 << i
        stopped[d["block"]] = stopped.get(d["block"], 0) | of_name[d["name"]]
    begin: dict = {}
    queue = dict.fromkeys(made)
    while queue:
        block = next(iter(queue))
        del queue[block]
        end = made.get(block, 0) | begin.get(block, 0) & ~stopped.get(block, 0)
        for to in after.get(block, ()):
            was = begin.get(to, 0)
            if end & ~was:
                begin[to] = was | end
                queue[to] = None
    for block, left in begin.items():
        while left:
            d = own[(left & -left).bit_length() - 1]
            yield block, d["name"], d["def_pos"]
            left &= left - 1


def _by_rounds(last: DataFrame, edges: DataFrame) -> DataFrame:
    """The same as rows: a round moves what a block newly has at its end over its edges, leaves out what was there before, and
    goes on with what the block doesn't define anew. A row is moved once, and ways that meet add nothing, so the rounds are
    as many as the longest way of a definition that is still news."""
    last, edges = cut(last), cut(edges)
    kills = last.select("fn", "block", "name")
    front = last.select("fn", "block", "name", "def_pos")
    seen = None
    while True:
        step = front.withColumnRenamed("block", "src").join(edges, ["fn", "src"]).select("fn", F.col("dst").alias("block"), "name", "def_pos").distinct()
        news = step if seen is None else step.join(seen, ["fn", "block", "name", "def_pos"], "left_anti")
        news = cut(news)
        if news.isEmpty():
            return seen if seen is not None else news
        seen = news if seen is None else cut(seen.union(news))
        front = news.join(kills, ["fn", "block", "name"], "left_anti").select("fn", "block", "name", "def_pos")


def flow_def_use(statements: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """``fn, name, def_pos, use_pos``: each use with every definition that may be the last one before it on some way; a use
    that none reaches has a null. A definition in the same statement is no definition of what the statement uses."""
    placed = cut(blocks(statements))
    at = placed.select("fn", "pos", F.concat_ws(":", F.col("fn").cast("string"), F.col("block").cast("string")).alias("block"))
    d = defs.select("fn", "pos", "name").distinct().join(at, ["fn", "pos"]).withColumn("is_def", F.lit(True))
    u = uses.select("fn", "pos", "name").distinct().join(at, ["fn", "pos"]).withColumn("is_def", F.lit(False))
    order = Window.partitionBy("fn", "block", "name").orderBy("pos", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.max(F.when(F.col("is_def"), F.col("pos"))).over(order)
    here = cut(d.union(u).withColumn("def_pos", inner).where("NOT is_def").select("fn", "block", "name", "def_pos", F.col("pos").alias("use_pos")))
    before = _definitions_at(placed, defs, ONE_ROW)
    there = here.where("def_pos IS NULL").drop("def_pos").join(before, ["fn", "block", "name"], "left")
    columns = ["fn", "name", "def_pos", "use_pos"]
    return here.where("def_pos IS NOT NULL").select(*columns).union(there.select(*columns))


def dependencies(links: DataFrame) -> CodeGraph:
    """The graph of what flows where, of ``flow_def_use``: a node is a statement, written ``fn:pos``."""
    name = lambda pos: F.concat_ws(":", F.col("fn").cast("string"), F.col(pos).cast("string"))
    return CodeGraph(links.where("def_pos IS NOT NULL").select(name("def_pos").alias("src"), name("use_pos").alias("dst")))


def last_dependencies(links: DataFrame, one_row: int = 10 * ONE_ROW) -> DataFrame:
    """``node, distance``: what the last statement of each function that uses something depends on, through any number of
    statements, by ``flow_def_use``; nodes as in ``dependencies``. A function of up to ``one_row`` links is searched as one
    row, the others together by a walk over tables."""
    links = cut(links.where("def_pos IS NOT NULL AND fn IS NOT NULL").select("fn", "def_pos", "use_pos").distinct())
    long = cut(links.groupBy("fn").agg(F.count("*").alias("n")).where(F.col("n") > one_row).select("fn"))
    rows = links.join(long, "fn", "left_anti").groupBy(F.col("fn").cast("string").alias("fn")).agg(F.collect_list(F.struct("def_pos", "use_pos")).alias("links"))
    found = _many_of_each(rows, _above_last, lambda batch: [pa.string(), pa.int32()], "node string, distance int", 2)
    if long.isEmpty():
        return found
    left = links.join(long, "fn", "left_semi")
    last = left.groupBy("fn").agg(F.max("use_pos").alias("pos")).select(F.concat_ws(":", F.col("fn").cast("string"), F.col("pos").cast("string")).alias("node"))
    return found.union(dependencies(left).reversed().reach(last))


def _above_last(fn: str, links: list[dict]) -> Iterator[tuple]:
    above: dict = {}
    for e in links:
        above.setdefault(e["use_pos"], []).append(e["def_pos"])
    seen = {max(above): 0}
    front = list(seen)
    while front:
        step = {d for use in front for d in above.get(use, ()) if d not in seen}
        seen |= dict.fromkeys(step, seen[front[0]] + 1)
        front = list(step)
    return ((f"{fn}:{pos}", distance) for pos, distance in seen.items())
