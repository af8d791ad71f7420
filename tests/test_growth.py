"""What steps of plans make on inputs whose groups are large: rows that no result needs grow faster than the input."""

from strandgraph.operators import flow, search, syntax_diff
from strandgraph.operators.graph import CodeGraph


def most_rows(spark, run):
    """The result of ``run`` and the most rows that any part of the plans it executed put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    settled = lambda: spark._jsc.sc().listenerBus().waitUntilEmpty()
    settled()
    old, found, most = store.executionsCount(), run(), 0
    settled()
    new = store.executionsList()
    for i in range(int(old), new.size()):
        values, metrics = store.executionMetrics(new.apply(i).executionId()), new.apply(i).metrics()
        for m in (metrics.apply(k) for k in range(metrics.size())):
            value = values.get(m.accumulatorId())
            if m.name() == "number of output rows" and value.isDefined():
                most = max(most, int(value.get().replace(",", "").split("(")[0]))
    return found, most


def test_best_paths_past_a_hub(spark):
    """a path to one end doesn't meet all edges that leave a node on it."""
    n = 300
    edges = [("r", "hub")] + [("hub", f"s{i}") for i in range(n)] + [(f"s{i}", f"p{i}") for i in range(n)] + [("x", f"s{i}") for i in range(n)]
    pairs = spark.createDataFrame([("r", f"p{i}") for i in range(n)], "start string, end string")
    got, most = most_rows(spark, lambda: CodeGraph(spark.createDataFrame(edges, "src string, dst string")).best_paths(pairs, 3, 4).collect())
    assert {(r["end"], tuple(r["path"]), r["length"]) for r in got} == {(f"p{i}", ("r", "hub", f"s{i}", f"p{i}"), 3) for i in range(n)}
    assert n <= most < 20 * n


def many_of_a_name(spark):
    names = ["red bolt", "red bolts", "Red Bolt", "blue nut"]
    entities = spark.createDataFrame([(i, names[i % 4]) for i in range(4000)] + [(None, "red bolt"), (5000, None)], "id long, name string")
    queries = spark.createDataFrame([("red bolt",), ("RED BOLT",), ("red bol",), ("re",), ("blue nu",), ("rod bolt",)], "query string")
    return entities, queries


def test_prefixes_of_a_name_that_many_share(spark):
    """queries meet names, not all that are called so, and no table goes through the driver."""
    entities, queries = many_of_a_name(spark)
    found = search.prefix_many(entities, queries)
    got, most = most_rows(spark, lambda: found.collect())
    assert most <= 4002 and "Broadcast" not in found._jdf.queryExecution().toString()
    best = [(r["id"], r["name"], r["score"]) for r in sorted((r for r in got if r["query"] == "red bol"), key=lambda r: (-r["score"], -1 if r["id"] is None else r["id"]))]
    assert best == [(None, "red bolt", 0.875)] + [(i, ("red bolt", "", "Red Bolt")[i % 4], 0.875) for i in (0, 2, 4, 6, 8, 10, 12, 14, 16)]
    assert search.prefix_many(entities, queries, None).where("query = 're'").count() == 3001


def test_stages_of_a_name_that_many_share(spark):
    """the same of the three stages together; a name twice under one id counts twice for the next stage."""
    entities, queries = many_of_a_name(spark)
    found = search.smart_many(entities, queries)
    got, most = most_rows(spark, lambda: found.collect())
    # Exact names may each be looked for as they are and in small letters.
    assert most <= 2 * 4002 and "Broadcast" not in found._jdf.queryExecution().toString()
    exact = sorted((-1 if r["id"] is None else r["id"], r["stage"]) for r in got if r["query"] == "red bolt")
    assert exact == [(-1, 1)] + [(i, 1) for i in (0, 2, 4, 6, 8, 10, 12, 14, 16)]
    twice = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "abc")], "id long, name string")
    ask = spark.createDataFrame([("ab",)], "query string")
    assert [(r["id"], r["stage"]) for r in search.smart_many(twice, ask).collect()] == [(1, 1)]
    assert {(r["id"], r["stage"]) for r in search.smart_many(twice.distinct(), ask).collect()} == {(1, 1), (2, 2)}


def test_near_names_that_many_share(spark):
    """the same of names within two edits."""
    entities, queries = many_of_a_name(spark)
    got, most = most_rows(spark, lambda: search.fuzzy_many(entities, queries).collect())
    assert most <= 4002 and sorted(r["id"] for r in got if r["query"] == "blue nu") == [4 * i + 3 for i in range(10)]


def long_way(spark):
    """Two functions of 24 blocks, each a branch back to the first, and one with a loop of two; names set here and there."""
    statements = [(fn, pos, "branch", 0) for fn in ("f", "g") for pos in range(24)] + [("h", 0, "plain", None), ("h", 1, "branch", 1), ("h", 2, "return", None)]
    defs = [("f", 0, "x"), ("f", 5, "y"), ("f", 23, "x"), ("g", 3, "x"), ("h", 0, "x"), ("h", 1, "x")]
    uses = [("f", 20, "x"), ("f", 2, "y"), ("g", 3, "x"), ("h", 1, "x"), ("h", 2, "x"), ("h", 2, "z")]
    at = "fn string, pos int, name string"
    return spark.createDataFrame(statements, "fn string, pos int, kind string, target int"), spark.createDataFrame(defs, at), spark.createDataFrame(uses, at)


def executions(spark, run):
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    old, found = store.executionsCount(), run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return found, store.executionsCount() - old


def test_definitions_along_a_long_way(spark):
    """F8: the jobs don't follow the length of the way; functions too long for a row come out the same."""
    st, defs, _ = long_way(spark)
    rows = lambda **k: sorted(tuple(r) for r in flow.definitions_at_blocks(st, defs, **k).collect())
    got, n = executions(spark, rows)
    assert n < 12 and got == rows(one_row=3) == rows(one_row=0)
    assert ("f", "f:0", "x", 23) in got and ("f", "f:20", "x", 0) in got and ("f", "f:1", "x", 23) not in got and ("h", "h:1", "x", 1) in got


def test_uses_along_a_long_way(spark):
    """the same of each use's definitions."""
    got, n = executions(spark, lambda: {tuple(r) for r in flow.flow_def_use(*long_way(spark)).collect()})
    assert n < 12 and got == {("f", "x", 0, 20), ("f", "y", 5, 2), ("g", "x", 3, 3), ("h", "x", 0, 1), ("h", "x", 1, 1), ("h", "x", 1, 2), ("h", "z", None, 2)}


def test_dependencies_along_a_long_way(spark):
    """a chain of 30 statements and a ring, searched in as many jobs as a short one."""
    links = [("f", "v", i, i + 1) for i in range(30)] + [("g", "v", 1, 2), ("g", "v", 2, 1), ("g", "w", None, 9), ("h", "v", None, 1)]
    links = spark.createDataFrame(links, "fn string, name string, def_pos int, use_pos int")
    rows = lambda **k: sorted(tuple(r) for r in flow.last_dependencies(links, **k).collect())
    got, n = executions(spark, rows)
    assert n < 6 and got == rows(one_row=5) == sorted([(f"f:{i}", 30 - i) for i in range(31)] + [("g:2", 0), ("g:1", 1)])


def test_loops_of_scopes_in_one_job(spark):
    """loops are found where the dominators are, a loop of 30 nodes as one of two; the walk finds the same."""
    lines = [(f"{s}{i}", f"{s}{i + 1}") for s in "ab" for i in range(30)] + [("a30", "a1"), ("b7", "b3"), ("b5", "b5"), ("b9", "b2"), ("z", "b4")]
    scope = spark.createDataFrame([(f"{s}{i}", s) for s in "ab" for i in range(31)] + [("z", "b")], "node string, scope string")
    g, entry = CodeGraph(spark.createDataFrame(lines, "src string, dst string")), spark.createDataFrame([("a0",), ("b0",)], "node string")
    got, n = executions(spark, lambda: {tuple(r) for r in g.natural_loops(entry, scope).collect()})
    assert n <= 2 and got == {tuple(r) for r in g.natural_loops(entry).collect()} and ("a1", "a30") in got and ("b3", "z") in got


def test_leaves_are_hashed_once(spark, monkeypatch):
    """leaves are written with their places and with their hashes, but go by no levels; a change below shows above."""
    rows = [("t", "r", None, 0, "k", "r", "")] + [("t", f"i{k}", "r", k, "k", "i", "") for k in (0, 1)] + [("t", f"l{k}", f"i{k % 2}", k, "k", "l", "") for k in range(200)]
    table = lambda rows: spark.createDataFrame(rows, "tree string, node string, parent string, ord long, kind string, name string, flags string")
    written, cut = [], syntax_diff.cut

    def counted(df):
        df = cut(df)
        written.append(df.count())
        return df

    monkeypatch.setattr(syntax_diff, "cut", counted)
    hashes = lambda rows: {r["node"]: tuple(r["hash"]) for r in syntax_diff.hashed(table(rows)).collect()}
    one = hashes(rows)
    assert len(one) == 203 and sum(written) < 2.5 * 203
    two = hashes([(*r[:5], "other", r[6]) if r[1] == "l7" else r for r in rows])
    assert {n for n in one if one[n] != two[n]} == {"l7", "i1", "r"}
