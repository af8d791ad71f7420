"""Directed graphs as DataFrames: degrees, entries, reach, levels, paths, cycles, dominators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import Rounds, cut

#: Steps along the edges that are planned as one job. More steps make fewer jobs, but walk further into what is known.
STEPS = 4
#: Written layers of a walk that are kept apart before they are written as one.
LAYERS = 6
#: Random rankings in the first turn of the search for strongly connected components; twice as many in each of the next three.
RANKINGS = 4


class CodeGraph:
    """Edges ``(src, dst)`` and, optionally, nodes ``(node)``; each method plans a DataFrame.

    Edges with a null end are left out, repeated edges count once. Without nodes, these are the ends of the edges.
    Walks go by jobs of ``steps`` steps each, whatever the size of the graph.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None, steps: int = STEPS) -> None:
        self.steps = steps
        self._written: DataFrame | None = None
        self.edges = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
        own = self.edges.select(F.col("src").alias("node")).union(self.edges.select("dst"))
        self.nodes = (own if nodes is None else own.union(nodes.select("node").where("node IS NOT NULL"))).distinct()

    def written(self) -> DataFrame:
        """The edges, cut from their lineage once."""
        if self._written is None:
            self._written = cut(self.edges)
        return self._written

    # --- degrees and membership ---

    def degrees(self) -> DataFrame:
        """``node, out_degree, in_degree`` in one aggregation over both ends."""
        ends = self.edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
        ends = ends.union(self.edges.select("dst", F.lit(0), F.lit(1))).union(self.nodes.select("node", F.lit(0), F.lit(0)))
        return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))

    def stats(self) -> DataFrame:
        return self.degrees().agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.round(F.avg(F.col("out_degree") + F.col("in_degree")), 6).alias("avg_degree"))

    def entry_points(self) -> DataFrame:
        """Nodes that are nobody's target."""
        return self.nodes.join(self.edges.select(F.col("dst").alias("node")), "node", "left_anti")

    def leaves(self) -> DataFrame:
        return self.nodes.join(self.edges.select(F.col("src").alias("node")), "node", "left_anti")

    def mutual(self) -> DataFrame:
        """Unordered pairs with edges both ways; a self-loop pairs a node with itself."""
        back = self.edges.select(F.col("src").alias("b"), F.col("dst").alias("a"))
        both = self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(back, ["a", "b"], "left_semi")
        return both.where("a <= b")

    def adjacency(self) -> DataFrame:
        """``node, imports, imported_by``: sorted neighbours as text."""
        side = lambda key, other, name: self.edges.groupBy(F.col(key).alias("node")).agg(F.array_join(F.array_sort(F.collect_list(other)), ",").alias(name))
        return side("src", "dst", "imports").join(side("dst", "src", "imported_by"), "node", "full_outer").select("node", F.coalesce("imports", F.lit("")).alias("imports"), F.coalesce("imported_by", F.lit("")).alias("imported_by"))

    def reversed(self) -> CodeGraph:
        return CodeGraph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), steps=self.steps)

    def undirected(self) -> CodeGraph:
        return CodeGraph(self.edges.union(self.edges.select("dst", "src")), steps=self.steps)

    # --- reach ---

    def reach(self, start: DataFrame, depth: int | None = None) -> DataFrame:
        """``node, distance``: everything reachable from ``start`` (node), with the fewest edges; the start has 0."""
        return walk(self.written(), start.select("node").where("node IS NOT NULL"), depth, self.steps)

    def unreachable(self, start: DataFrame) -> DataFrame:
        """Nodes that nothing of ``start`` leads to."""
        return self.nodes.join(self.reach(start).select("node"), "node", "left_anti")

    def shortest_paths(self, start: DataFrame, depth: int) -> DataFrame:
        """``node, distance, path``: of the shortest paths of at most ``depth`` edges from ``start`` (one node) the first in
        the order of their nodes, as an array. Paths grow with the depth, so it is always bounded."""
        edges = self.written()
        front = cut(start.select("node", F.lit(0).alias("distance"), F.array("node").alias("path")))
        seen = front
        for d in range(1, depth + 1):
            step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "path")
            step = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
            front = cut(step.select("node", F.lit(d).alias("distance"), F.concat("path", F.array("node")).alias("path")))
            if front.isEmpty():
                break
            seen = seen.union(front)
        return seen

    def shortest_path(self, start: DataFrame, end: DataFrame, depth: int | None = None) -> DataFrame:
        """``step, node``: the shortest path from one node to another, the first in order where there are several; no rows
        without a way. What is kept on the way back is one row a distance, not a path for each node reached."""
        end = end.select("node")
        far = cut(self.reach(start, depth))
        into = self.written().join(far.select(F.col("node").alias("src"), F.col("distance").alias("before")), "src").join(far.withColumnRenamed("node", "dst"), "dst").where("distance = before + 1")
        above = cut(into.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("above")))
        way = far.join(end, "node", "left_semi").select("node", "distance", F.array("node").alias("path"))  # one row
        length = way.first()
        for d in range(1, length["distance"] + 1 if length else 1):
            way = above.join(F.broadcast(way), "node").select(F.col("above").alias("node"), "distance", F.concat(F.array("above"), "path").alias("path"))
            if d % (2 * self.steps) == 0:
                way = cut(way)
        return way.select(F.posexplode("path").alias("step", "node"))

    def weak_components(self) -> DataFrame:
        """``node, component``: nodes that edges join in either direction, by their smallest member."""
        rounds = Rounds()
        labels = rounds.step(self.nodes.select("node", F.col("node").alias("component")))
        both = cut(self.written().union(self.written().select("dst", "src")))
        while True:  # each takes the least label around it, then that label's own label
            near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
            hooked = labels.join(near, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
            # A root learns of the least label that its members saw.
            told = hooked.groupBy(F.col("was").alias("node")).agg(F.min("component").alias("told"))
            hooked = rounds.step(hooked.join(told, "node", "left").select("node", "was", F.least("component", F.coalesce("told", "component")).alias("component")))
            jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("further"))
            step = rounds.step(hooked.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")))
            labels = step.select("node", "component")
            if step.where("was <> component").isEmpty():
                return rounds.last(labels)

    def levels_from_roots(self) -> DataFrame:
        return self.reach(self.entry_points()).withColumnRenamed("distance", "level")

    def levels_from_leaves(self) -> DataFrame:
        return self.reversed().reach(self.leaves()).withColumnRenamed("distance", "level")

    def max_depth(self) -> DataFrame:
        """The largest breadth-first distance from the entry points."""
        return self.levels_from_roots().agg(F.coalesce(F.max("level"), F.lit(0)).alias("max_depth"))

    def neighbourhood(self, start: DataFrame, k: int, most: int | None = None, with_path: bool = False) -> DataFrame:
        """Nodes within k undirected edges: ``node, distance, score`` = 1 - distance / k, and ``path`` if wanted; the
        ``most`` nearest of them, ties to the smaller node."""
        around = self.undirected()
        near = around.shortest_paths(start, k) if with_path else around.reach(start, k)
        near = near.where("distance > 0").withColumn("score", F.round(1 - F.col("distance") / k, 6))
        return near.orderBy("distance", "node").limit(most) if most else near

    def simple_paths(self, start: DataFrame, end: DataFrame | None, k: int) -> DataFrame:
        """``path, length``: all paths of at most k edges without a repeated node, as node ids joined by ``>``."""
        edges = self.written()
        layer = start.select(F.col("node").alias("at"), F.array("node").alias("path"))
        found = None
        for _ in range(k):
            step = layer.join(edges, F.col("at") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
            layer = cut(step.select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
            found = layer if found is None else found.union(layer)
        if end is not None:
            found = found.join(end.select(F.col("node").alias("at")).distinct(), "at", "left_semi")
        return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).alias("length"))

    def best_paths(self, pairs: DataFrame, k: int, length: int) -> DataFrame:
        """``start, end, path, length``: for each pair (start, end) the ``k`` first of its paths of at most ``length`` edges
        without a repeated node, by length, then by their nodes in order; the path as an array. Pairs with a null end, or of one
        node, have none, repeated pairs count once.

        What the starts lead to is walked first, then, over the edges between that, how far nodes are from each end. The edges
        that bring a path nearer to an end in time are written with this end, so a path meets no others, however many leave a
        node that all paths pass. A pair that has its ``k`` paths grows no more: whatever comes later is longer.
        """
        asked = cut(pairs.select("start", "end").where("start <> end").distinct())
        ahead = walk(self.written(), asked.select(F.col("start").alias("node")), length - 1, self.steps)
        edges = cut(self.written().join(ahead.select(F.col("node").alias("src"), F.col("distance").alias("before")), "src"))
        into = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        far = cut(walk(into, asked.select(F.col("end").alias("node"), "end"), length, self.steps, carry=("end",)))
        layer = asked.join(far.select(F.col("node").alias("start"), "end"), ["start", "end"], "left_semi").select("start", "end", F.col("start").alias("at"), F.array("start").alias("path"))
        near = far.select(F.col("node").alias("dst"), "end", "distance")
        lines = cut(near.join(edges, "dst").where(F.col("before") + F.col("distance") < length).select("end", F.col("src").alias("at"), "dst", "distance"))
        found = None
        for d in range(1, length + 1):
            step = layer.join(lines, ["at", "end"]).where((F.col("distance") <= length - d) & ~F.array_contains("path", F.col("dst")))
            step = cut(step.select("start", "end", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
            done = step.where(F.col("at") == F.col("end")).select("start", "end", "path", F.lit(d).alias("length"))
            found = done if found is None else found.union(done)
            full = found.groupBy("start", "end").agg(F.count("*").alias("n")).where(F.col("n") >= k)
            layer = step.where(F.col("at") != F.col("end")).join(full, ["start", "end"], "left_anti")
            if layer.isEmpty():
                break
        place = F.row_number().over(Window.partitionBy("start", "end").orderBy("length", "path"))
        return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")

    # --- cycles ---

    def components(self) -> DataFrame:
        """``node, scc``: the strongly connected components that have an edge inside, named by their largest node.

        Nodes get random ranks. Each learns the best-ranked node that leads to it and the best-ranked one that it leads to.
        If these are one node, this is a member of its component. An edge whose ends differ in either is inside no
        component. Several rankings at once, twice as many in each turn, cut what is left into many parts, so the number of
        turns grows slower than the logarithm of the nodes, also on long chains; no component or chain is walked node by
        node (``spread``). Nodes that nothing leads to, or that lead nowhere, are taken away
        before each turn, as long as that takes many.
        """
        edges = _trim(self.written())
        found, turn = None, 0
        while found is None or not edges.isEmpty():
            arcs = edges.select(F.lit(True).alias("ahead"), "src", "dst").union(edges.select(F.lit(False), "dst", "src"))
            ends = edges.select("src").union(edges.select("dst")).distinct().select(F.col("src").alias("node"))
            ends = ends.withColumn("ranking", F.explode(F.sequence(F.lit(0), F.lit(RANKINGS * 2 ** min(turn, 3) - 1))))
            rank = F.struct(F.xxhash64(F.lit(turn), F.col("ranking"), F.col("node")).alias("rank"), F.col("node").alias("top"))
            marks = spread(arcs, ends.select("node", "ranking", F.explode(F.array(F.lit(True), F.lit(False))).alias("ahead"), rank.alias("label")), self.steps)
            each = marks.groupBy("node", "ranking").agg(F.max(F.when(F.col("ahead"), F.col("label.top"))).alias("above"), F.max(F.when(~F.col("ahead"), F.col("label.top"))).alias("below"))
            both = F.struct("ranking", "above", "below")
            # The first ranking that names a component does so for all its nodes.
            sides = cut(each.groupBy("node").agg(F.min(F.when(F.col("above") == F.col("below"), both)).alias("own"), F.array_sort(F.collect_list(both)).alias("sides")))
            members = sides.where("own IS NOT NULL").select("node", F.col("own.above").alias("top"))
            found = members if found is None else found.union(members)
            left = sides.where("own IS NULL")
            a, b = left.select(F.col("node").alias("src"), "sides"), left.select(F.col("node").alias("dst"), "sides")
            edges = _trim(edges.join(a, "src").join(b, ["dst", "sides"]).select("src", "dst"))
            turn += 1
        found = cut(found)
        # A lone node is a component with an edge inside only if it has a self-loop.
        loops = self.written().where("src = dst").select(F.col("src").alias("node"), F.lit(1).alias("loop"))
        names = found.join(loops, "node", "left").groupBy("top").agg(F.max("node").alias("scc"), F.count("*").alias("size"), F.max("loop").alias("loop"))
        return found.join(names.where("size > 1 OR loop = 1"), "top").select("node", "scc")

    def cycles(self) -> DataFrame:
        """``scc, size, members``: each strongly connected component with an edge inside; members in order, as text."""
        return self.components().groupBy("scc").agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("node")), lambda n: n.cast("string")), ",").alias("members"))

    def cycle_paths(self, length: int) -> DataFrame:
        """``scc, length, path``: every cycle of at most ``length`` edges without a repeated node, as its nodes in order from
        the smallest one on, joined by ``>``; a self-loop is one node.

        Only edges inside strongly connected components are walked, each way from its smallest node over larger ones, so a
        cycle is found once. The number of cycles may grow exponentially with their length, which is why that is asked for.
        """
        edges = cut(self.cyclic_edges())
        way = edges.where("dst >= src").select("scc", F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src").alias("path"))
        found = None
        for k in range(1, length + 1):
            way = cut(way)
            closed = way.where("at = start").select("scc", F.lit(k).alias("length"), F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))
            found = closed if found is None else found.union(closed)
            if k == length:
                break
            further = way.where("at > start").join(edges.select("src", "dst"), F.col("at") == F.col("src"))
            further = further.where((F.col("dst") >= F.col("start")) & ((F.col("dst") == F.col("start")) | ((F.col("dst") != F.col("at")) & ~F.array_contains("path", F.col("dst")))))
            way = further.select("scc", "start", F.col("dst").alias("at"), F.concat("path", F.array("at")).alias("path"))
            if way.isEmpty():
                break
        return found

    def cyclic_edges(self) -> DataFrame:
        """``src, dst, scc``: edges whose ends are in one strongly connected component, self-loops included."""
        scc = cut(self.components())
        a, b = scc.select(F.col("node").alias("src"), F.col("scc").alias("scc")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("sb"))
        return self.written().join(a, "src").join(b, "dst").where("scc = sb").select("src", "dst", "scc")

    def summary(self) -> DataFrame:
        """One row: ``nodes, edges, entries, leaves, cyclic_edges, has_cycles, max_depth``."""
        one = lambda df, name: df.agg(F.count("*").alias(name))
        out = one(self.nodes, "nodes").join(one(self.written(), "edges")).join(one(self.entry_points(), "entries")).join(one(self.leaves(), "leaves")).join(one(self.cyclic_edges(), "cyclic_edges")).join(self.max_depth())
        return out.select("nodes", "edges", "entries", "leaves", "cyclic_edges", (F.col("cyclic_edges") > 0).alias("has_cycles"), "max_depth")  # all of one row

    def neighbours(self, node: DataFrame, which: str = "both") -> DataFrame:
        """``node, direction, neighbour`` of the given nodes: ``imports`` (out), ``imported_by`` (in) or both."""
        go = lambda key, other, name: self.edges.select(F.col(key).alias("node"), F.lit(name).alias("direction"), F.col(other).alias("neighbour"))
        out, into = go("src", "dst", "imports"), go("dst", "src", "imported_by")
        every = {"imports": out, "imported_by": into, "both": out.union(into)}[which]
        return every.join(node.select("node").distinct(), "node", "left_semi")

    def natural_loops(self, entry: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """``head, node``: for each edge u -> h whose head h dominates u, h and what reaches u without passing h. With
        ``scope``, as for ``dominators``, each scope's loops are found in the group that finds its dominators."""
        if scope is not None:
            return _loops_by_scope(self.edges, entry.select("node").where("node IS NOT NULL").distinct(), scope.select("node", "scope"))
        dom = dominators(self.written(), entry)
        back = cut(self.written().join(dom.select(F.col("node").alias("src"), F.col("dom").alias("dst")), ["src", "dst"], "left_semi").select("src", F.col("dst").alias("head")))
        into = self.written().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = back.select(F.col("src").alias("node"), "head").union(back.select("head", "head")).distinct()
        return walk(into, start, None, self.steps, carry=("head",), on=F.col("node") != F.col("head")).select("head", "node")

    def loop_depths(self, entry: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """``node, loop_depth``: in how many natural loops a reachable node is."""
        loops = self.natural_loops(entry, scope).groupBy("node").agg(F.count("*").alias("loop_depth"))
        return self.reach(entry).select("node").join(loops, "node", "left").select("node", F.coalesce("loop_depth", F.lit(0)).alias("loop_depth"))


def walk(edges: DataFrame, start: DataFrame, depth: int | None, steps: int, carry: tuple[str, ...] = (), on: Column | None = None) -> DataFrame:
    """``node, *carry, distance``: a breadth-first search from ``start`` (node, *carry), for each value of ``carry`` its own.
    A row goes on only if ``on`` holds, a condition on these columns.

    Every node has an arc of no length to itself, by which it outlasts a step: so a step is one join and one aggregation, a
    job takes ``steps`` of them, and both sides of the join may be split where a node has many edges. What a job reaches
    is compared with what was seen before once, at its end; every few jobs the layers become one written table.
    """
    key = ["node", *carry]
    go = F.lit(True) if on is None else on
    front = cut(start.select(*key).distinct().withColumn("distance", F.lit(0)))
    ends = edges.select("src").union(edges.select("dst")).distinct()
    arcs = cut(edges.select("src", "dst", F.lit(1).alias("length")).union(ends.select("src", "src", F.lit(0))))
    seen, layers, d = front, 1, 0
    while depth is None or d < depth:
        here = front
        more = steps if depth is None else min(steps, depth - d)
        for k in range(d, d + more):
            step = here.join(arcs, F.col("node") == F.col("src")).where((F.col("length") == 0) | ((F.col("distance") == k) & go))
            here = step.select(F.col("dst").alias("node"), *carry, (F.col("distance") + F.col("length")).alias("distance")).groupBy(*key).agg(F.min("distance").alias("distance"))
        new = cut(here.where(F.col("distance") > d).join(seen.select(*key), key, "left_anti"))
        d += more
        front = new.where(F.col("distance") == d)
        seen, layers = seen.union(new), layers + 1
        if front.isEmpty():
            break
        if layers >= LAYERS:
            seen, layers = cut(seen), 1
    return seen


def spread(arcs: DataFrame, labels: DataFrame, steps: int) -> DataFrame:
    """``node, ranking, ahead, label``: the largest label that arcs (ahead, src, dst) bring to each row of ``labels``, for
    each ``ranking`` and value of ``ahead`` apart.

    A job takes labels ``steps`` arcs further. Each node also knows one node that leads to it; from job to job this is the one
    twice as far away, and each becomes a shortcut of its own, so along chains and rings labels get on by powers of two:
    the number of jobs follows the logarithm of their length, for each place where ways meet that they pass.
    """
    key, rounds = ["node", "ranking", "ahead"], Rounds()
    one = F.min_by("src", F.xxhash64("src", "dst")).alias("node")
    far = rounds.step(arcs.where("src <> dst").groupBy("ahead", "dst").agg(one).select("ahead", "node", "dst"), keep=True)
    arcs = rounds.step(arcs.union(labels.select("ahead", "node", "node")).distinct().withColumnRenamed("src", "node"), keep=True)
    while True:
        here = labels.withColumn("was", F.col("label"))
        for _ in range(steps):
            step = here.join(arcs, ["node", "ahead"])
            own = F.when(F.col("dst") == F.col("node"), F.col("was"))
            here = step.select(F.col("dst").alias("node"), "ranking", "ahead", "label", own.alias("was")).groupBy(*key).agg(F.max("label").alias("label"), F.max("was").alias("was"))
        here = rounds.step(here)
        labels = here.select(*key, "label")
        if here.where("label <> was").isEmpty():
            return rounds.last(labels)
        further = far.select("ahead", F.col("dst").alias("node"), F.col("node").alias("beyond"))
        far = rounds.step(far.join(further, ["ahead", "node"]).select("ahead", F.col("beyond").alias("node"), "dst"), keep=True)
        arcs = arcs.union(far.where("node <> dst"))


def _trim(edges: DataFrame) -> DataFrame:
    """The edges left when those from nodes that nothing leads to, and then those to nodes that lead nowhere, are taken away,
    again as long as this takes at least a quarter of them."""
    n = None
    while True:
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        was, n = n, edges.count()
        if n == 0 or was is not None and n > 0.75 * was:
            return edges


def dominators(edges: DataFrame, entry: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """``node, dom``: dom is on every way from an entry to the node; a node dominates itself.

    Entries (node) may be many, as those of all functions of a project at once. With ``scope`` (node, scope), where no edge
    leaves its scope, as none leaves a function, each scope is a group of its own; entries without a scope are left out. Without, pairs come from rounds
    of counting, at any size: d dominates n if it dominates as many of n's predecessors as n has among the nodes reached so far.
    """
    graph, entry = CodeGraph(edges), entry.select("node").where("node IS NOT NULL").distinct()
    if scope is not None:
        return _dominators_by_scope(graph.edges, entry, scope.select("node", "scope"))
    reached = cut(graph.reach(entry).select("node"))
    edges = cut(graph.written().join(reached.withColumnRenamed("node", "src"), "src", "left_semi"))
    roots = cut(entry)
    doms = cut(roots.select("node", F.col("node").alias("dom")))
    was = -1
    while (n := doms.count()) != was or not doms.select("node").distinct().count() == reached.count():
        was = n
        known = doms.select("node").distinct()
        into = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(roots.withColumnRenamed("node", "dst"), "dst", "left_anti")
        wanted = into.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("wanted"))
        agreed = into.join(doms.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node"), "dom").agg(F.count("*").alias("agreed"))
        above = agreed.join(wanted, "node").where("agreed = wanted AND node <> dom").select("node", "dom")
        doms = cut(above.union(wanted.select("node", F.col("node").alias("dom"))).union(roots.select("node", F.col("node").alias("dom"))))
    return doms


def _scoped(edges: DataFrame, entry: DataFrame, scope: DataFrame) -> DataFrame:
    lines = edges.join(scope.select(F.col("node").alias("src"), "scope"), "src").select("scope", "src", "dst", F.lit(False).alias("is_entry"))
    return lines.union(entry.join(scope, "node").select("scope", "node", "node", F.lit(True)))


def _by_scope(rows: DataFrame, found: Callable[[list, list], Iterable[tuple]], names: tuple[str, str]) -> DataFrame:
    def one(group: pd.DataFrame) -> pd.DataFrame:
        first, lines = group[group["is_entry"]], group[~group["is_entry"]]
        pairs = list(found([*lines["src"], *[None] * len(first)], [*lines["dst"], *first["dst"]]))
        return pd.DataFrame(pairs, columns=list(names))

    kind = rows.schema["src"].dataType.simpleString()
    return rows.groupBy("scope").applyInPandas(one, ", ".join(f"{n} {kind}" for n in names))


def _dominators_by_scope(edges: DataFrame, entry: DataFrame, scope: DataFrame) -> DataFrame:
    return _by_scope(_scoped(edges, entry, scope), _dominating, ("node", "dom"))


def _loops_by_scope(edges: DataFrame, entry: DataFrame, scope: DataFrame) -> DataFrame:
    return _by_scope(_scoped(edges, entry, scope), _looping, ("head", "node"))


def _looping(src: list, dst: list) -> Iterator[tuple]:
    """(head, node) of the natural loops of one function, edges as for ``_dominating``."""
    doms = set(_dominating(src, dst))
    before: dict = {}
    loops: dict = {}
    for a, b in zip(src, dst, strict=True):
        if a is not None:
            before.setdefault(b, []).append(a)
            if (a, b) in doms:
                loops.setdefault(b, {b}).add(a)
    for head, body in loops.items():
        queue = [n for n in body if n != head]
        while queue:
            for n in before.get(queue.pop(), ()):
                if n not in body:
                    body.add(n)
                    queue.append(n)
        yield from ((head, n) for n in body)


def _dominating(src: list, dst: list) -> Iterator[tuple]:
    """(node, dominator) of one function; edges from None lead to its entries. A node's dominators are those that all its
    known predecessors share, and itself; nodes are taken again when a predecessor's have changed."""
    after: dict = {}
    before: dict = {}
    for a, b in zip(src, dst, strict=True):
        after.setdefault(a, []).append(b)
        before.setdefault(b, []).append(a)
    doms: dict = {None: frozenset()}
    queue = dict.fromkeys(after.get(None, ()))
    while queue:
        node = next(iter(queue))
        del queue[node]
        new = frozenset.intersection(*(doms[p] for p in before[node] if p in doms)) | {node}
        if doms.get(node) != new:
            doms[node] = new
            queue |= dict.fromkeys(after.get(node, ()))
    return ((node, d) for node, over in doms.items() if node is not None for d in over)


def merge(*graphs: DataFrame) -> DataFrame:
    out = graphs[0].select("src", "dst")
    for g in graphs[1:]:
        out = out.union(g.select("src", "dst"))
    return out.distinct()


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change, src, dst``: edges and nodes added or removed (nodes have no dst)."""
    old, new = old.select("src", "dst").distinct(), new.select("src", "dst").distinct()
    nodes = lambda e: e.select("src").union(e.select("dst")).distinct().select("src", F.lit(None).cast(e.schema["dst"].dataType).alias("dst"))
    mark = lambda name, e: e.select(F.lit(name).alias("change"), "src", "dst")
    parts = [mark("added_edge", new.subtract(old)), mark("removed_edge", old.subtract(new)), mark("added_node", nodes(new).subtract(nodes(old))), mark("removed_node", nodes(old).subtract(nodes(new)))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def typed_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change, src, dst, old_types, new_types``: of edges (src, dst, type) that differ: pairs only one side has, and pairs
    whose types changed. One full join of a row a pair; types are sorted and joined by commas."""
    pairs = lambda e, name: e.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias(name))
    both = pairs(old, "old_types").join(pairs(new, "new_types"), ["src", "dst"], "full_outer")
    change = F.when(F.col("old_types").isNull(), "added_edge").when(F.col("new_types").isNull(), "removed_edge").when(F.col("old_types") != F.col("new_types"), "type_changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("change", "src", "dst", "old_types", "new_types")


def empty(spark: SparkSession, node_type: str = "string") -> CodeGraph:
    """A graph without nodes and edges."""
    return CodeGraph(spark.createDataFrame([], f"src {node_type}, dst {node_type}"))


def cohesion(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``cluster, size, internal, total, density, share``: of members (node, cluster) and edges.

    ``density`` is internal edges per possible edge in percent (0 for one member), ``share`` internal edges per edge
    that leaves a member in percent (100 for one member, 0 without edges).
    """
    a, b = members.select(F.col("node").alias("src"), F.col("cluster")), members.select(F.col("node").alias("dst"), F.col("cluster").alias("other"))
    lines = edges.where("src <> dst").join(a, "src").join(b, "dst", "left").groupBy("cluster").agg(F.count("*").alias("total"), F.count_if(F.col("cluster") == F.col("other")).alias("internal"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, inside, total = F.col("size"), zero(F.col("internal")), zero(F.col("total"))
    density = F.when(n <= 1, 0.0).otherwise(F.round(inside / (n * (n - 1)) * 100, 4))
    share = F.when(n <= 1, 100.0).when(total == 0, 0.0).otherwise(F.round(inside / total * 100, 0))
    return sizes.join(lines, "cluster", "left").select("cluster", "size", inside.alias("internal"), total.alias("total"), density.alias("density"), share.alias("share"))
