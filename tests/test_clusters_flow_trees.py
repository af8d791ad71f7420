"""Clusters, definitions along control flow and tree comparison against plain loops on random input."""

import random

import pytest

from strandgraph.operators import clusters, flow, syntax_diff
from strandgraph.operators.ranking import numbered


def test_places_of_a_large_group(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(9)}", rng.randrange(50), i) for i in range(3000)] + [(None, 1, -1), (None, None, -2)]
    want, seen = {}, {}
    for g, o, i in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        want[i] = seen[g] = seen.get(g, -1) + 1
    got = numbered(spark.createDataFrame(rows, "g string, o int, i int").where("g IS NOT NULL"), "g", "o", "i").collect()
    assert {r["i"]: r["at"] for r in got} == {i: k for i, k in want.items() if i >= 0}


def grown(functions, calls, starts, most):
    """One cluster after the other: what the best start left reaches, nearest first, cut into pieces."""
    owned, out = set(), []
    for seed in starts:
        if seed in owned:
            continue
        layer, found = [seed], []
        owned.add(seed)
        while layer:
            found += layer
            layer = sorted({d for s, d in calls if s in layer and d in functions} - owned)
            owned |= set(layer)
        out += [(found[k - k % most], seed, k % most, name) for k, name in enumerate(found)]
    return out


def test_clusters_against_growing_one_after_the_other(spark):
    rng = random.Random(2)
    rows, calls, want, entries = [], [], [], []
    for m in ("a", "b"):
        names = [f"f{k:02}" for k in range(60)]
        exported = {n: rng.random() < 0.2 for n in names}
        own = {(rng.choice(names), rng.choice([*names, "outside"])) for _ in range(70)}
        called = {n: sum(d == n for _, d in own) for n in names}
        rows += [(m, n, exported[n]) for n in names]
        calls += [(m, s, d) for s, d in own]
        best = sorted(names, key=lambda n: (-(100 * exported[n] + called[n]), n))
        want += [(m, *r) for r in grown(set(names), own, best, 4)]
        first = sorted((n for n in names if not called[n]), key=lambda n: (not exported[n], n))
        entries += [(m, *r) for r in grown(set(names), own, first, 4)]
    functions, links = spark.createDataFrame(rows, "module string, name string, exported boolean"), spark.createDataFrame(calls, "module string, src string, dst string")
    columns = ["module", "cluster", "seed", "place", "name"]
    assert sorted(map(tuple, clusters.by_importance(functions, links, 4).select(*columns).collect())) == sorted(want)
    assert sorted(map(tuple, clusters.by_entry_points(functions, links, 4).select(*columns).collect())) == sorted(entries)
    assert clusters.by_importance(functions.limit(0), links, 4).collect() == []


def walked(code, defs, uses):
    """(fn, name, def_pos, use_pos) by walking statement by statement with sets of definitions, until nothing changes."""
    out = set()
    for fn, lines in code.items():
        n = len(lines)
        after = [set() for _ in range(n)]
        before = [set() for _ in range(n)]
        following = []
        for pos, (kind, target) in enumerate(lines):
            there = [target] if target is not None and 0 <= target < n else []
            following.append({"return": [], "jump": there, "branch": [pos + 1, *there]}.get(kind, [pos + 1]))
        for _ in range(n * n):
            was = [set(a) for a in after]
            for pos in range(n):
                d = defs.get((fn, pos))
                after[pos] = {(x, p) for x, p in before[pos] if x != d} | ({(d, pos)} if d else set())
                for q in following[pos]:
                    if q < n:
                        before[q] |= after[pos]
            if was == after:
                break
        for (f, pos), x in uses.items():
            if f == fn:
                found = {p for y, p in before[pos] if y == x}
                out |= {(fn, x, p, pos) for p in found} or {(fn, x, None, pos)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_definitions_along_control_flow(spark, seed):
    rng = random.Random(seed)
    code = {f: [(k := rng.choice(["plain", "plain", "branch", "jump", "return"]), rng.randrange(-1, 26) if k in ("branch", "jump") else None) for _ in range(24)] for f in (1, 2, 3)}
    defs = {(f, p): rng.choice("xyz") for f in code for p in range(24) if rng.random() < 0.4}
    uses = {(f, p): rng.choice("xyz") for f in code for p in range(24)}
    st = spark.createDataFrame([(f, p, k, t) for f, lines in code.items() for p, (k, t) in enumerate(lines)], "fn long, pos int, kind string, target int")
    table = lambda d: spark.createDataFrame([(f, p, x) for (f, p), x in d.items()], "fn long, pos int, name string")
    got = {tuple(r) for r in flow.flow_def_use(st, table(defs), table(uses)).select("fn", "name", "def_pos", "use_pos").collect()}
    reachable = walked(code, defs, uses)
    # Blocks that nothing leads to have definitions of their own that still reach what they lead to, here as there.
    assert got == reachable


def random_tree(rng, depth):
    kids = [] if depth == 0 else [random_tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    return [rng.choice("kl"), rng.choice("nm"), rng.choice(["", "f", None]), kids]


def changed(rng, t):
    if rng.random() < 0.04:
        t = [t[0], t[1] + "!", t[2], t[3]]
    kids = [changed(rng, k) for k in t[3] if rng.random() > 0.03]
    return [t[0], t[1], "g" if rng.random() < 0.02 else t[2], kids]


def node_rows(tree, t, parent=None, place=0, out=None):
    out = [] if out is None else out
    me = len(out)
    out.append((tree, me, parent, place * 10 - 5, t[0], t[1], t[2]))
    for k, kid in enumerate(t[3]):
        node_rows(tree, kid, me, k, out)
    return out


def plain_diff(tree, a, b, path=(0,)):
    shown = lambda t: t and f"{t[0]} {t[1]}"
    if a is None or b is None:
        return [(tree, path, "missing", shown(a), shown(b))]
    what = next((w for w, k in (("kind", 0), ("name", 1), ("flags", 2)) if a[k] != b[k]), None)
    out = [(tree, path, what, shown(a), shown(b))] if what else []
    for k in range(max(len(a[3]), len(b[3]))):
        out += plain_diff(tree, a[3][k] if k < len(a[3]) else None, b[3][k] if k < len(b[3]) else None, (*path, k))
    return out


SCHEMA = "tree string, node long, parent long, ord long, kind string, name string, flags string"


def test_trees_against_plain_comparison(spark):
    rng = random.Random(5)
    one, two, want = [], [], []
    for k in range(6):
        a = random_tree(rng, 5)
        b = a if k == 0 else changed(rng, a)
        one += node_rows(f"t{k}", a)
        two += node_rows(f"t{k}", b)
        want += plain_diff(f"t{k}", a, b)
    deep = lambda end: [("deep", i, i - 1 if i else None, 0, "k", end if i == 11 else "n", "") for i in range(12)]
    a, b = spark.createDataFrame(one + deep("n"), SCHEMA), spark.createDataFrame(two + deep("m"), SCHEMA)
    got = [(r["tree"], tuple(r["path"]), r["what"], r["original"], r["modified"]) for r in syntax_diff.tree_differences(a, b).collect()]
    assert sorted(got, key=repr) == sorted([*want, ("deep", (0,) * 12, "name", "k n", "k m")], key=repr)
    verdicts = {r["tree"]: (r["equivalent"], r["confidence"]) for r in syntax_diff.tree_verdicts(a, b).collect()}
    assert verdicts["t0"] == (True, 1.0) and verdicts["deep"] == (False, 0.7)


def test_trees_of_one_side_and_none(spark):
    a = spark.createDataFrame([("x", 0, None, 0, "k", "n", None)], SCHEMA)
    got = syntax_diff.tree_differences(a, a.limit(0)).collect()
    assert [(r["tree"], list(r["path"]), r["what"], r["original"], r["modified"]) for r in got] == [("x", [0], "missing", "k n", None)]
    assert syntax_diff.tree_differences(a, a).collect() == syntax_diff.tree_differences(a.limit(0), a.limit(0)).collect() == []
