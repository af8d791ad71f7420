"""Graph operators: literal graphs, and random ones against plain searches."""

import numpy as np
import pytest

from strandgraph.operators.graph import CodeGraph, cohesion, diff, dominators, merge


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def rows(df):
    return {tuple(r) for r in df.collect()}


CYCLE3, CYCLE2, DAG = [("a", "b"), ("b", "c"), ("c", "a")], [("x", "y"), ("y", "x")], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
CHORD = [*CYCLE3, ("a", "c")]


def test_cyclic_edges(spark):
    """Several graphs beside each other in one, told apart by a number before their nodes."""
    graphs = [(CYCLE3, 3), (CYCLE2, 2), (DAG, 0), ([("s", "s")], 1), (CHORD, 4), ([*CYCLE3, *DAG, ("c", "x"), *CYCLE2], 6)]
    every = [(f"{k}{a}", f"{k}{b}") for k, (edges, _) in enumerate(graphs) for a, b in edges]
    got = [r["src"][0] for r in CodeGraph(frame(spark, every)).cyclic_edges().collect()]
    assert [got.count(str(k)) for k in range(len(graphs))] == [n for _, n in graphs]


def test_ring_is_one_component(spark):
    n, k = 500, 3
    ring = spark.createDataFrame([(i, (i + j) % n) for i in range(n) for j in range(1, k + 1)], "src long, dst long")
    got = CodeGraph(ring).components().collect()
    assert len(got) == n and {r["scc"] for r in got} == {n - 1}


def reached(edges, start):
    far, front = dict.fromkeys(start, 0), list(start)
    while front:
        front = [b for b in sorted({b for a, b in edges if a in front}) if b not in far]
        far |= dict.fromkeys(front, max(far.values()) + 1)
    return far


@pytest.mark.parametrize(("steps", "n"), [(1, 75), (4, 100)])
def test_against_plain_searches(spark, steps, n):
    """Reach, depth limits, components of both kinds and dominators; dominators also with each weak component as a scope."""
    pairs = {(int(a), int(b)) for a, b in np.random.default_rng(n).integers(0, 60, (n, 2))}
    nodes = {x for e in pairs for x in e}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    start = spark.createDataFrame([(min(nodes),), (3,), (None,), (77,)], "node long")
    g = CodeGraph(edges, steps=steps)
    far = reached(pairs, [min(nodes), 3, 77])
    assert rows(g.reach(start)) == set(far.items())
    assert rows(g.reach(start, 2)) == {(k, d) for k, d in far.items() if d <= 2}
    to = {a: reached(pairs, [a]) for a in nodes}
    inside = {a for a, b in pairs if a in to[b]}
    assert rows(g.components()) == {(a, max(b for b in to[a] if a in to[b])) for a in inside}
    both = pairs | {(b, a) for a, b in pairs}
    weak = {(a, min(reached(both, [a]))) for a in nodes}
    assert rows(g.weak_components()) == weak
    want = {(k, d) for k in far for d in far if k == d or k not in reached({e for e in pairs if d not in e}, {min(nodes), 3, 77} - {d})}
    assert rows(dominators(edges, start)) == want
    scope = spark.createDataFrame([*weak, *((k, k) for k in (3, 77) if k not in nodes)], "node long, scope long")
    assert rows(dominators(edges, start, scope)) == want


def test_long_chain_and_ring(spark):
    """A chain of 300 edges into a ring of 300: the rounds of components and of the weak kind don't follow the length."""
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(n + i, n + (i + 1) % n) for i in range(n)], "src long, dst long")
    assert rows(CodeGraph(edges).components()) == {(n + i, 2 * n - 1) for i in range(n)}


def test_nulls_repeats_and_empty_graphs(spark):
    g = CodeGraph(frame(spark, [("a", "b"), ("a", "b"), (None, "b"), ("a", None)]))
    assert rows(g.degrees()) == {("a", 1, 0), ("b", 0, 1)}
    none = CodeGraph(frame(spark, []))
    assert none.reach(frame(spark, []).selectExpr("src AS node")).count() == 0
    assert none.components().count() == none.weak_components().count() == none.entry_points().count() == 0
    assert [tuple(r) for r in none.summary().collect()] == [(0, 0, 0, 0, 0, False, 0)]


def test_levels_paths_and_neighbourhood(spark):
    g = CodeGraph(frame(spark, DAG))
    a, d = frame(spark, [("a", "d")]).selectExpr("src AS node"), frame(spark, [("a", "d")]).selectExpr("dst AS node")
    assert rows(g.levels_from_roots()) == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert rows(g.levels_from_leaves()) == {("d", 0), ("b", 1), ("c", 1), ("a", 2)}
    assert rows(g.simple_paths(a, d, 5)) == {("a>b>d", 2), ("a>c>d", 2)}
    assert rows(g.shortest_path(a, d)) == {(0, "a"), (1, "b"), (2, "d")}
    assert g.shortest_path(d, a).count() == 0
    assert {(r["node"], r["distance"], tuple(r["path"])) for r in g.shortest_paths(a, 5).collect()} == {("a", 0, ("a",)), ("b", 1, ("a", "b")), ("c", 1, ("a", "c")), ("d", 2, ("a", "b", "d"))}
    assert rows(g.neighbourhood(d, 2)) == {("b", 1, 0.5), ("c", 1, 0.5), ("a", 2, 0.0)}
    assert rows(g.unreachable(frame(spark, [("b", "")]).selectExpr("src AS node"))) == {("a",), ("c",)}
    assert rows(g.neighbours(d, "imported_by")) == {("d", "imported_by", "b"), ("d", "imported_by", "c")}


def test_dominators_and_loops(spark):
    edges = frame(spark, [("entry", "h"), ("h", "x"), ("x", "y"), ("y", "h"), ("x", "x2"), ("x2", "x"), ("h", "exit"), ("dead", "exit")])
    entry = frame(spark, [("entry", "")]).selectExpr("src AS node")
    want = {"entry": "entry", "h": "entry h", "x": "entry h x", "y": "entry h x y", "x2": "entry h x x2", "exit": "entry h exit"}
    scope = edges.selectExpr("src AS node").union(edges.selectExpr("dst")).distinct().selectExpr("node", "1 AS scope")
    for within in (None, scope):
        assert rows(dominators(edges, entry, within)) == {(n, d) for n, doms in want.items() for d in doms.split()}
        g = CodeGraph(edges)
        assert rows(g.natural_loops(entry, within)) == {("h", n) for n in ("h", "x", "y", "x2")} | {("x", "x"), ("x", "x2")}
        assert rows(g.loop_depths(entry, within)) == {("entry", 0), ("h", 1), ("x", 2), ("y", 1), ("x2", 2), ("exit", 0)}


def test_isolated_functions(spark):
    n = 300
    nodes = spark.createDataFrame([(f"f{i}",) for i in range(n)] + [("main",)], "node string")
    g = CodeGraph(frame(spark, [("main", "f0"), ("main", f"f{n - 1}")]), nodes)
    unused = {r["node"] for r in g.entry_points().collect()}
    assert len(unused - {"main"}) == n - 2 and "main" in unused


def test_diff_merge_and_cohesion(spark):
    old, new = frame(spark, [("a", "b"), ("b", "c")]), frame(spark, [("a", "b"), ("b", "d")])
    assert rows(diff(old, new)) == {("added_edge", "b", "d"), ("removed_edge", "b", "c"), ("added_node", "d", None), ("removed_node", "c", None)}
    assert merge(old, new).count() == 3
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, cluster int")
    assert rows(cohesion(old, members)) == {(1, 2, 1, 2, 50.0, 50.0), (2, 1, 0, 0, 0.0, 100.0)}


def test_cycles_against_walking(spark):
    rng = np.random.default_rng(4)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 9, (26, 2))} | {(20, 20), (30, 31), (31, 30), (31, 40)}
    want, ways = set(), [(a, (a,)) for a in {a for a, _ in edges}]
    for _ in range(6):
        ways = [(b, (*p, b)) for at, p in ways for a, b in edges if a == at and (b == p[0] or b not in p) and (len(p) == 1 or at != p[0])]
        want |= {p[:-1] for at, p in ways if at == p[0] and p[0] == min(p)}
    g = CodeGraph(spark.createDataFrame(sorted(edges), "src long, dst long"))
    for length in (6, 2):
        got = {tuple(map(int, r["path"].split(">"))) for r in g.cycle_paths(length).collect()}
        assert got == {p for p in want if len(p) <= length} and g.cycle_paths(length).count() == len(got)
    assert CodeGraph(frame(spark, DAG)).cycle_paths(4).count() == 0


def test_best_paths_of_pairs(spark):
    """Every pair's first three paths, against all simple paths of a plain search."""
    found = {(a, (a * 7 + s) % 12) for a in range(12) for s in (1, 3, 5)} | {(4, 4)}
    after = {}
    for a, b in found:
        after.setdefault(a, []).append(b)

    def ways(path, end):
        if path[-1] == end:
            yield path
        elif len(path) <= 4:
            for b in after.get(path[-1], ()):
                if b not in path:
                    yield from ways((*path, b), end)

    asked = [(a, b) for a in range(12) for b in range(12)] + [(0, 1), (None, 1), (1, None), (3, 99), (99, 3)]
    want = {(a, b, p, len(p) - 1) for a in range(12) for b in range(12) if a != b for p in sorted(ways((a,), b), key=lambda p: (len(p), p))[:3]}
    g = CodeGraph(spark.createDataFrame(sorted(found), "src long, dst long"))
    got = g.best_paths(spark.createDataFrame(asked, "start long, end long"), 3, 4).collect()
    assert len(got) == len(want) and {(r["start"], r["end"], tuple(r["path"]), r["length"]) for r in got} == want
    assert CodeGraph(frame(spark, [])).best_paths(frame(spark, []).selectExpr("src AS start", "dst AS end"), 3, 4).count() == 0


def test_names_handed_on_by_re_exports(spark):
    """A rename, a chain that closes, whole files without their default, nulls and repeats."""
    from strandgraph.operators.resolve import handed_on

    exports = spark.createDataFrame([("a", "f"), ("a", "f"), ("a", "default"), (None, "x")], "file string, name string")
    lines = [("b", "g", "a", "f"), ("c", "*", "b", "*"), ("b", "*", "c", "*"), ("d", "*", "a", "*"), ("e", "d", "a", "default"), ("e", None, "a", "f")]
    got = handed_on(exports, spark.createDataFrame(lines, "file string, name string, from_file string, imported string"))
    want = {("a", "f", "f", 0), ("a", "default", "default", 0), ("b", "g", "f", 1), ("c", "g", "f", 2), ("d", "f", "f", 1), ("e", "d", "default", 1)}
    assert {(r["file"], r["name"], r["origin_name"], r["hops"]) for r in got.collect()} == want and got.count() == len(want)
