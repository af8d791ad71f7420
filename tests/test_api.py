"""A project as one object, statements of functions, visitors."""

import pandas as pd

from strandgraph import api
from strandgraph.operators import flow
from strandgraph.operators.graph import dominators
from strandgraph.plans import project
from strandgraph.sources.statements import of_text, statements


def steps(body):
    return [(kind, target) for _, _, kind, target, _, _ in of_text("function f() {" + body + "}", "a.js")]


def test_statements():
    assert steps("") == [] and steps("a(); b();") == [("plain", None), ("plain", None)]
    assert steps("if (a) { b(); } else c(); d();") == [("branch", 3), ("plain", None), ("jump", 4), ("plain", None), ("plain", None)]
    assert steps("while (a) { if (b) break; c(); }") == [("branch", 5), ("branch", 3), ("jump", 5), ("plain", None), ("jump", 0)]
    assert steps("for (const x of y) continue; return x;") == [("branch", 3), ("jump", 0), ("jump", 0), ("return", None)]
    assert steps("do { a(); } while (b); c();") == [("plain", None), ("branch", 0), ("plain", None)]
    assert steps("try { a(); } catch (e) { b(); } finally { c(); }") == [("branch", 3), ("plain", None), ("jump", 4), ("plain", None), ("plain", None)]
    assert steps("switch (a) { case 1: b(); break; default: c(); }") == [("plain", None), ("branch", 4), ("plain", None), ("jump", 5), ("plain", None)]
    assert [s[2] for s in of_text("const f = x => x + 1; class A { m() { throw 1; } }", "a.js")] == ["return", "return"]
    assert list(of_text("function (", "a.js")) == []


def test_flow_of_real_text(spark):
    text = "function f(n) {\n  let s = 0;\n  while (n > 0) {\n    if (n % 2) { s += n; }\n    n--;\n  }\n  return s;\n  dead();\n}\nconst g = () => 1;"
    rows = spark.createDataFrame([("a.js", text), ("b.js", None)], "path string, content string")
    st = statements(rows)
    got = {(r["fn"], r["complexity"]) for r in flow.complexity(st).collect()}
    assert got == {("a.js#f", 3), ("a.js#g", 1)}
    g, entry = flow.cfg_graph(st)
    assert {r["node"] for r in g.unreachable(entry).collect()} == {"a.js#f:6"}
    assert dominators(g.written(), entry).where("node = 'a.js#f:3'").count() == 5
    assert {r["head"] for r in g.natural_loops(entry).collect()} == {"a.js#f:1"}


def test_project(spark, tmp_path):
    p = api.Project(project.files(spark))
    assert p.graph().cyclic_edges().count() == 2
    assert {r["id"] for r in p.search("fetchData").collect()} >= {"src/api.ts#fetchData"} and p.search_prefix("is").count() == 1 and p.search_fuzzy("helpr").count() == 1
    assert p.entity("src/api.ts#LIMIT").first()["type"] == "constant"
    assert {r["node"] for r in p.context("src/index.ts#main", 1).collect()} == {"src/index.ts#main.inner", "./api#fetchData", "./util/index#default"}
    assert p.unresolved().count() == 4 and p.dead_exports().count() > 0 and p.unused().count() == 4
    rules = {r["rule"] for r in p.issues().collect()}
    assert {"eval", "unresolved import", "duplicate export", "unused variable"} <= rules
    assert p.impact("src/util/index.ts", "helper").count() > 0 and p.clusters("src/api.ts").count() > 0
    assert p.prompt_pack("src/index.ts").first()["path"] == "src/index.ts" and p.minified().count() == len(project.FILES)
    assert p.control_flow().count() > 10 and p.dominators().count() > 10 and p.data_flow().count() > 0 and p.markdown().count() > 10
    assert p.embedded(lambda texts: [[len(t)] for t in texts]).where("vector[0] > 0").count() == p.entities.count()
    p.save(str(tmp_path / "p"))
    assert api.Project.load(spark, str(tmp_path / "p")).graph().cyclic_edges().count() == 2
    seen = api.walk(p.nodes, lambda rows: pd.DataFrame({"file": rows["file"][:1], "n": [len(rows)]}), "file string, n long")
    assert seen.count() == len(project.FILES)
    start = spark.createDataFrame([("src/util/index.ts",)], "node string")
    assert list(api.visit_nodes(p.graph().edges, str.upper, start)) == ["SRC/UTIL/INDEX.TS", "SRC/UTIL/HELPER.JS"]
    assert api.verify(spark, "id", {"x": (0, 5)}, "x", post=["result == x"]).first()["valid"]
