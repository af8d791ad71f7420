"""Queries of totals, metrics, filters and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandgraph.functions import paths
from strandgraph.operators import graph, ranking, report, syntax_diff, vectors
from strandgraph.sources import code, json_io

from . import project
from .catalogue import ENT, ENTRY, G_EVENT, G_PART, distances, event_graph, fixture, part_edges, part_entities, part_graph, query, read
from .graph_queries import definitions
from .project import literal

# Functions of a report: lines of orders; their flag says where they come from, their status whether they are exported.
_F = "SELECT l_orderkey AS module, l_partkey AS name, CASE l_returnflag WHEN 'N' THEN 'self' WHEN 'A' THEN 'external' ELSE 're-export' END AS source, l_linestatus = 'O' AS exported, l_linenumber % 2 = 0 AS is_async FROM lineitem"


def report_functions(spark, sf_dir):
    flag = F.col("l_returnflag")
    source = F.when(flag == "N", "self").when(flag == "A", "external").otherwise("re-export")
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("module"), F.col("l_partkey").alias("name"), source.alias("source"), (F.col("l_linestatus") == "O").alias("exported"), (F.col("l_linenumber") % 2 == 0).alias("is_async"))


@query(f"SELECT count(*) AS total, count(*) FILTER (source = 'self') AS self, count(*) FILTER (source = 'external') AS external, count(*) FILTER (source = 're-export') AS re_export, count(*) FILTER (exported) AS exported, count(*) FILTER (is_async) AS async FROM ({_F})")
def functions_by_source(spark, sf_dir):
    n = lambda s: F.count_if(F.col("source") == s)
    return report_functions(spark, sf_dir).agg(F.count("*").alias("total"), n("self").alias("self"), n("external").alias("external"), n("re-export").alias("re_export"), F.count_if("exported").alias("exported"), F.count_if("is_async").alias("async"))


@query(f"SELECT module, name FROM ({_F}) WHERE source = 're-export' AND exported")
def re_exported_functions(spark, sf_dir):
    return report_functions(spark, sf_dir).where("source = 're-export' AND exported").select("module", "name")


@query(f"SELECT module, unnest(list(name ORDER BY name)) AS name FROM ({_F}) GROUP BY module")
def all_functions(spark, sf_dir):
    """The functions of all modules, from a report that has a list a module."""
    modules = report_functions(spark, sf_dir).groupBy("module").agg(F.collect_list("name").alias("names"))
    return modules.select("module", F.explode("names").alias("name"))


@query(f"SELECT count(*) AS functions, count(DISTINCT module) AS modules, count(*) FILTER (exported) AS exported, count(*) FILTER (is_async) AS async, count(DISTINCT name) AS names, max(n) AS largest_module FROM ({_F}) f JOIN (SELECT module, count(*) AS n FROM ({_F}) GROUP BY module) USING (module)")
def project_totals(spark, sf_dir):
    per = report_functions(spark, sf_dir).groupBy("module").agg(F.count("*").alias("n"), F.count_if("exported").alias("e"), F.count_if("is_async").alias("a"))
    names = report_functions(spark, sf_dir).agg(F.count_distinct("name").alias("names"))
    return per.agg(F.sum("n").alias("functions"), F.count("*").alias("modules"), F.sum("e").alias("exported"), F.sum("a").alias("async"), F.max("n").alias("largest_module")).join(names)  # one row each


@query(f"""WITH RECURSIVE {G_PART}, c(a, b) AS (SELECT src, dst FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src), {distances(ENTRY)}, far AS (SELECT node, min(distance) AS d FROM r GROUP BY node)
SELECT (SELECT count(DISTINCT p_brand) FROM part) AS modules, (SELECT count(*) FROM part) AS functions, (SELECT count(*) FROM e) AS calls, (SELECT count(DISTINCT p_type) FROM part) AS types, EXISTS (SELECT 1 FROM c WHERE a = b) AS has_cycles, NOT EXISTS (SELECT 1 FROM c WHERE a = b) AS is_acyclic, (SELECT max(d) FROM far)::INT AS max_depth""")
def architecture_metrics(spark, sf_dir):
    ents = part_entities(spark, sf_dir).agg(F.count_distinct("module").alias("modules"), F.count("*").alias("functions"), F.count_distinct("type").alias("types"))
    g = part_graph(spark, sf_dir).summary().select(F.col("edges").alias("calls"), "has_cycles", (~F.col("has_cycles")).alias("is_acyclic"), "max_depth")
    return ents.join(g)  # one row each


@query("SELECT source, count(*) AS files, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY source")
def size_totals(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"))


@query("SELECT p_brand AS module, " + ", ".join(f"count(*) FILTER (p_type = '{t}') AS {t.lower()}" for t in ("ECONOMY", "SMALL", "LARGE", "PROMO", "STANDARD", "MEDIUM")) + " FROM part GROUP BY p_brand")
def entities_per_module(spark, sf_dir):
    """Counts of each kind side by side."""
    kinds = ("ECONOMY", "SMALL", "LARGE", "PROMO", "STANDARD", "MEDIUM")
    return part_entities(spark, sf_dir).groupBy("module").agg(*(F.count_if(F.col("type") == t).alias(t.lower()) for t in kinds))


@query(f"SELECT module, count(*) AS entities, count(DISTINCT type) AS types, array_to_string(list_sort(list(DISTINCT type)), ',') AS kinds FROM {ENT} GROUP BY module HAVING bool_or(type = 'PROMO') AND bool_or(id % 7 = 0)")
def filtered_cards(spark, sf_dir):
    """Modules that have any of the wanted kinds and an exported entity."""
    packages = part_entities(spark, sf_dir).groupBy("module").agg(F.collect_list(F.struct("id", "type")).alias("e"))
    kept = packages.where(F.exists("e", lambda x: x["type"] == "PROMO") & F.exists("e", lambda x: x["id"] % 7 == 0))
    kinds = F.array_sort(F.array_distinct(F.transform("e", lambda x: x["type"])))
    return kept.select("module", F.size("e").cast("long").alias("entities"), F.size(kinds).cast("long").alias("types"), F.array_join(kinds, ",").alias("kinds"))


@query("SELECT event_id, coalesce(event_type, '') AS name, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS line, value > 10 AS exported FROM events")
def sanitised_entities(spark, sf_dir):
    """Entities of a report with their types made sure of: missing texts are empty, missing numbers 0."""
    props = F.from_json("props", "k int")
    return read(spark, sf_dir, "events").select("event_id", F.coalesce("event_type", F.lit("")).alias("name"), F.coalesce(props["k"], F.lit(0)).alias("line"), (F.col("value") > 10).alias("exported"))


@query(f"WITH {G_EVENT}, m AS (SELECT 'all' AS mode, src, dst FROM e UNION ALL SELECT 'loops', src, dst FROM e WHERE src = dst UNION ALL SELECT 'from clicks', src, dst FROM e WHERE src = 'click') SELECT mode, count(*) AS edges, count(*) FILTER (src = dst) AS calls, count(DISTINCT src) AS sources FROM m GROUP BY mode")
def edge_stats_by_mode(spark, sf_dir):
    e = event_graph(spark, sf_dir).edges
    modes = F.array_compact(F.array(F.lit("all"), F.when(F.col("src") == F.col("dst"), "loops"), F.when(F.col("src") == "click", "from clicks")))
    rows = e.select(F.explode(modes).alias("mode"), "src", "dst")
    return rows.groupBy("mode").agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("calls"), F.count_distinct("src").alias("sources"))


@query(f"WITH {G_PART}, i AS (SELECT count(*) FILTER (NOT contains(text, '.')) AS a, count(*) FILTER (length(text) > 5000) AS b FROM documents) SELECT (SELECT count(*) FROM e) - (SELECT count(*) FROM nd) + 2 AS complexity, (SELECT count(*) FROM nd) AS functions, (SELECT count(*) FROM nd WHERE node NOT IN (SELECT dst FROM e)) AS unused_functions, a AS type_errors, b AS data_flow_issues FROM i")
def semantic_stats(spark, sf_dir):
    """Counts of an analysis by kind, and the graph's E - N + 2."""
    g = part_graph(spark, sf_dir)
    kinds = F.explode(F.array_compact(F.array(F.when(~F.col("text").contains("."), "type_error"), F.when(F.length("text") > 5000, "data_flow_error"))))
    issues = read(spark, sf_dir, "documents").select(kinds.alias("type"))
    counts = issues.agg(F.count_if(F.col("type") == "type_error").alias("type_errors"), F.count_if(F.col("type") == "data_flow_error").alias("data_flow_issues"))
    n, e, u = g.nodes.agg(F.count("*").alias("functions")), g.edges.agg(F.count("*").alias("e")), g.entry_points().agg(F.count("*").alias("unused_functions"))
    return n.join(e).join(u).join(counts).select((F.col("e") - F.col("functions") + 2).alias("complexity"), "functions", "unused_functions", "type_errors", "data_flow_issues")  # one row each


@query(f"WITH {G_PART} SELECT greatest(1, (SELECT count(*) FROM e) - (SELECT count(*) FROM nd) + 2) AS cyclomatic_complexity, (SELECT count(*) FROM nd) AS total_functions, (SELECT count(*) FROM nd WHERE node NOT IN (SELECT dst FROM e)) AS unused_functions, (SELECT count(*) FROM lineitem WHERE l_discount < 0.02) AS verified, (SELECT sum(o_orderkey % 3) FROM orders)::BIGINT AS fixes")
def refactoring_metrics(spark, sf_dir):
    s = part_graph(spark, sf_dir).summary()
    verified = read(spark, sf_dir, "lineitem").agg(F.count_if(F.col("l_discount") < 0.02).alias("verified"))
    fixes = read(spark, sf_dir, "orders").agg(F.sum(F.col("o_orderkey") % 3).alias("fixes"))
    return s.select(F.greatest(F.lit(1), F.col("edges") - F.col("nodes") + 2).alias("cyclomatic_complexity"), F.col("nodes").alias("total_functions"), F.col("entries").alias("unused_functions")).join(verified).join(fixes)  # one row each


@query("SELECT o_orderstatus AS kind, o_orderpriority AS type, count(*) AS n, sum(o_totalprice > 200000)::BIGINT AS grave FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def issue_rollup(spark, sf_dir):
    """Issues by kind and type with subtotals."""
    return read(spark, sf_dir, "orders").rollup(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("type")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("grave"))


@query("SELECT n_name AS module, count(*) AS entities, count(*) FILTER (c_acctbal > 0) AS exported, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS kinds, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS dependents FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def analysis_rollup(spark, sf_dir):
    """A row a module: its entities, kinds and dependents, each side aggregated before they are joined."""
    entities = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("entities"), F.count_if(F.col("c_acctbal") > 0).alias("exported"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("kinds"))
    dependents = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count("*").alias("dependents"))
    modules = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("module"))
    return modules.join(entities, "c_nationkey").join(dependents, "c_nationkey", "left").select("module", "entities", "exported", "kinds", F.coalesce("dependents", F.lit(0)).alias("dependents"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3 = 0 DESC, p_name, p_partkey)::INT AS place FROM part")
def exported_first(spark, sf_dir):
    order = Window.partitionBy("p_brand").orderBy((F.col("p_size") % 3 == 0).desc(), "p_name", "p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", F.row_number().over(order).alias("place"))


@query(r"SELECT page_id, ext, row_number() OVER (ORDER BY ext NULLS FIRST, url NULLS FIRST, page_id) AS place FROM (SELECT page_id, url, regexp_extract(string_split(url, '/')[-1], '[^.](\.[^.]*)$', 1) AS ext FROM pages)")
def files_in_order(spark, sf_dir):
    """All files by extension, then path, numbered by a range sort."""
    files = read(spark, sf_dir, "pages").select(F.lit(0).alias("all"), "page_id", "url", paths.extension(F.col("url")).alias("ext"))
    return ranking.numbered(files, "all", "ext", "url", "page_id").select("page_id", "ext", (F.col("at") + 1).alias("place"))


@query(f"WITH {G_PART} SELECT cluster, size, density, share FROM (SELECT c.cluster, size, round(coalesce(internal, 0)::DOUBLE / (size * (size - 1)) * 100, 4) AS density, CASE WHEN coalesce(total, 0) = 0 THEN 0.0::DOUBLE ELSE round(internal::DOUBLE / total * 100, 0) END AS share FROM (SELECT p_brand AS cluster, count(*) AS size FROM part GROUP BY 1) c LEFT JOIN (SELECT a.p_brand AS cluster, count(*) AS total, count(*) FILTER (a.p_brand = b.p_brand) AS internal FROM e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE src <> dst GROUP BY 1) l USING (cluster)) ORDER BY density DESC, size DESC, cluster LIMIT 5")
def best_clusters(spark, sf_dir):
    members = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"))
    return graph.cohesion(part_edges(spark, sf_dir), members).orderBy(F.desc("density"), F.desc("size"), "cluster").limit(5).select("cluster", "size", "density", "share")


@query(f"WITH {G_PART} SELECT 'edge' AS kind, src::VARCHAR || '->' || dst AS id, json_object('src', src, 'dst', dst)::VARCHAR AS json FROM e UNION ALL SELECT 'node', node::VARCHAR, json_object('node', node)::VARCHAR FROM nd")
def graph_json(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    rows = report.graph_json(g.nodes, g.edges)
    id_ = F.coalesce(F.get_json_object("json", "$.node"), F.concat(F.get_json_object("json", "$.src"), F.lit("->"), F.get_json_object("json", "$.dst")))
    return rows.select("kind", id_.alias("id"), "json")


@query(f"WITH {G_EVENT} SELECT '  \"' || src || '\" -> \"' || dst || '\" [color=\"#ef4444\", penwidth=2.5, style=\"dashed\"];' AS line FROM e")
def dot_of_cycles(spark, sf_dir):
    """Edges of a graph as DOT; in this one all are on cycles."""
    g = event_graph(spark, sf_dir)
    return report.dot(g.written(), g.cyclic_edges()).where("section = 2").select("line")


_INDEX = '{"version": "1.0.0", "entities": [{"id": "a#f", "name": "f", "type": "function", "module": "a", "line": 3, "metadata": {"isAsync": "true"}, "embedding": [0.5, 1]}, {"id": "b#g", "name": "g", "type": "class", "module": "b"}], "edges": [{"from": "a#f", "to": "b#g", "type": "function_call"}]}'
_SIGNATURES = '{"f": {"params": ["a"], "paramTypes": ["int"], "returnType": "void", "isAsync": true}, "g": {"name": "h", "params": [], "paramTypes": [], "returnType": "any"}}'
_CALLS = '{"nodes": ["x", "y"], "edges": [{"from": "x", "to": "y", "type": "direct"}], "entryPoints": ["x"]}'
_REPORT = '{"packages": {"a.ts": {"entities": {"functions": [{"name": "f", "line": "3", "isExported": "true"}, {"name": "g"}], "classes": [{"name": "C"}], "odd": [{"name": "no"}]}}, "b.ts": {"entities": {}}}}'


def _documents(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


@fixture(literal("id, type, module, line, is_async", [("a#f", "function", "a", 3, "true"), ("b#g", "class", "b", None, None)]))
def imported_index(spark, sf_dir):
    entities, _ = json_io.index(_documents(spark, _INDEX, "{broken"))
    return entities.select("id", "type", "module", "line", F.try_element_at("metadata", F.lit("isAsync")).alias("is_async"))


@fixture(literal("src, dst, type, weight", [("a#f", "b#g", "function_call", 1)]))
def imported_edges(spark, sf_dir):
    _, edges = json_io.index(_documents(spark, _INDEX))
    return edges.select("src", "dst", "type", F.col("weight").cast("int").alias("weight"))


@fixture(literal("name, params, return_type, is_async", [("f", "a", "void", True), ("h", "", "any", False)]))
def imported_signatures(spark, sf_dir):
    return json_io.signatures(_documents(spark, _SIGNATURES)).select("name", F.array_join("params", ",").alias("params"), "return_type", "is_async")


@fixture(literal("node, is_entry", [("x", True), ("y", False)]))
def imported_call_graph(spark, sf_dir):
    return json_io.call_graph(_documents(spark, _CALLS))[0]


@fixture(literal("module, kind, name, line, is_exported", [("a.ts", "functions", "f", 3, True), ("a.ts", "functions", "g", None, False), ("a.ts", "classes", "C", None, False)]))
def report_entities(spark, sf_dir):
    return json_io.report(_documents(spark, _REPORT)).drop("attrs")


@fixture(literal("file, equivalent, confidence, what, original, modified", [("same.ts", True, 1.0, None, None, None), ("name.ts", False, 0.7, "name", "function f", "function g"), ("flag.ts", False, 0.8, "flags", "function f", "function f"), ("gone.ts", False, 0.5, "missing", "variable f.y", None)]).replace("1.0,", "1.0::DOUBLE,"))
def syntax_verdicts(spark, sf_dir):
    """Two versions of files: the first difference of each."""
    old = "function f(a) { return h(a); }"
    pairs = [("same.ts", old, "function f(a) {\n  // more\n  return h(a);\n}"), ("name.ts", old, old.replace("f(", "g(")), ("flag.ts", old, "async " + old), ("gone.ts", "function f() { const x = 1; const y = 2; }", "function f() { const x = 1; }")]
    side = lambda k: code.parse(spark.createDataFrame([(p[0], p[k]) for p in pairs], "path string, content string"))
    return syntax_diff.verdicts(side(1), side(2))


# Trees of places: a region's nations, their customers, and these ones' orders; the later version has changes in each level.
_LATER = {"nation": "n_nationkey <> 13", "customer": "c_custkey % 409 <> 5"}
_PLACES = """t{v} AS (SELECT r_regionkey AS tree, ['0'] AS path, 'region' AS kind, r_name AS name, '' AS flags, 'r' || r_regionkey AS id FROM region),
n{v} AS (SELECT t.tree, list_append(t.path, lpad((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::VARCHAR, 9, '0')) AS path, 'nation' AS kind, {nation} AS name, '' AS flags, n_nationkey AS id FROM nation JOIN t{v} t ON t.tree = n_regionkey WHERE {keep_nation}),
c{v} AS (SELECT n.tree, list_append(n.path, lpad((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::VARCHAR, 9, '0')) AS path, 'customer' AS kind, c_name AS name, c_mktsegment AS flags, c_custkey AS id FROM customer JOIN n{v} n ON n.id = c_nationkey WHERE {keep_customer}),
o{v} AS (SELECT c.tree, list_append(c.path, lpad((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::VARCHAR, 9, '0')) AS path, 'order' AS kind, o_orderkey::VARCHAR AS name, {status} AS flags, o_orderkey AS id FROM orders JOIN c{v} c ON c.id = o_custkey),
a{v} AS (SELECT tree, path, kind, name, flags FROM t{v} UNION ALL SELECT tree, path, kind, name, flags FROM n{v} UNION ALL SELECT tree, path, kind, name, flags FROM c{v} UNION ALL SELECT tree, path, kind, name, flags FROM o{v})"""
_DIFFERENT = f"""{_PLACES.format(v=1, nation="n_name", keep_nation="true", keep_customer="true", status="o_orderstatus")},
{_PLACES.format(v=2, nation="CASE WHEN n_nationkey = 7 THEN lower(n_name) ELSE n_name END", keep_nation=_LATER["nation"], keep_customer=_LATER["customer"], status="CASE WHEN o_orderkey % 1999 = 1 THEN o_orderpriority ELSE o_orderstatus END")},
j AS (SELECT coalesce(x.tree, y.tree) AS tree, coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL OR y.path IS NULL THEN 'missing' WHEN x.name <> y.name THEN 'name' WHEN x.flags <> y.flags THEN 'flags' END AS what, x.kind || ' ' || x.name AS original, y.kind || ' ' || y.name AS modified FROM a1 x FULL JOIN a2 y ON x.tree = y.tree AND x.path = y.path),
d AS (SELECT * FROM j WHERE what IS NOT NULL AND (what <> 'missing' OR (EXISTS (SELECT 1 FROM a1 WHERE a1.tree = j.tree AND a1.path = j.path[:len(j.path) - 1]) AND EXISTS (SELECT 1 FROM a2 WHERE a2.tree = j.tree AND a2.path = j.path[:len(j.path) - 1]))))"""


def _place_trees(spark, sf_dir, later: bool):
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    status, n_name = F.col("o_orderstatus"), F.col("n_name")
    if later:
        nation, customer = nation.where(_LATER["nation"]), customer.where(_LATER["customer"])
        status = F.when(F.col("o_orderkey") % 1999 == 1, F.col("o_orderpriority")).otherwise(status)
        n_name = F.when(F.col("n_nationkey") == 7, F.lower("n_name")).otherwise(n_name)
    home = customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nation.select("n_nationkey", "n_regionkey"), "n_nationkey")
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    row = lambda df, tree, node, parent, order, kind, named, flags: df.select(F.col(tree).alias("tree"), node.alias("node"), parent.alias("parent"), F.col(order).cast("long").alias("ord"), F.lit(kind).alias("kind"), named.alias("name"), flags.alias("flags"))
    parts = [
        row(region, "r_regionkey", name("r", "r_regionkey"), F.lit(None).cast("string"), "r_regionkey", "region", F.col("r_name"), F.lit("")),
        row(nation, "n_regionkey", name("n", "n_nationkey"), name("r", "n_regionkey"), "n_nationkey", "nation", n_name, F.lit("")),
        row(customer.join(home.drop("n_nationkey"), "c_custkey"), "n_regionkey", name("c", "c_custkey"), name("n", "c_nationkey"), "c_custkey", "customer", F.col("c_name"), F.col("c_mktsegment")),
        row(orders.join(home.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"), "n_regionkey", name("o", "o_orderkey"), name("c", "o_custkey"), "o_orderkey", "order", F.col("o_orderkey").cast("string"), status),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"WITH {_DIFFERENT} SELECT tree, array_to_string(list_transform(path, lambda p: p::BIGINT::VARCHAR), '/') AS path, what, original, modified FROM d")
def tree_differences(spark, sf_dir):
    """All places in which two versions of the trees differ."""
    found = syntax_diff.tree_differences(_place_trees(spark, sf_dir, False), _place_trees(spark, sf_dir, True))
    return found.withColumn("path", F.array_join(F.transform("path", lambda p: p.cast("string")), "/"))


@query(f"WITH {_DIFFERENT}, f AS (SELECT tree, arg_min({{'what': what, 'original': original, 'modified': modified}}, path) AS d FROM d GROUP BY tree) SELECT r_regionkey AS tree, d IS NULL AS equivalent, CASE d.what WHEN 'missing' THEN 0.5 WHEN 'name' THEN 0.7 WHEN 'flags' THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence, d.what AS what, d.original AS original, d.modified AS modified FROM region LEFT JOIN f ON f.tree = r_regionkey")
def tree_verdicts(spark, sf_dir):
    """Each tree's first difference in reading order, and how sure it is that the versions differ."""
    return syntax_diff.tree_verdicts(_place_trees(spark, sf_dir, False), _place_trees(spark, sf_dir, True))


@query(f"WITH u AS (SELECT conv_id, turn, text, strlen(text) AS n FROM conversations WHERE text IS NOT NULL), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS total FROM u) SELECT conv_id, count(*) AS turns, sum(n)::BIGINT AS bytes FROM s WHERE total <= 4000 GROUP BY conv_id")
def context_pack(spark, sf_dir):
    """The last turns of each conversation that fit into a context of 4000 bytes."""
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.octet_length("text").alias("n"))
    total = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("total", total).where("total <= 4000").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum("n").alias("bytes"))


_DEFS = "SELECT user_id AS scope, event_type AS name, event_id AS pos FROM events WHERE event_id % 3 = 0"
_USES = "SELECT user_id AS scope, event_type AS name, event_id AS pos FROM events WHERE event_id % 3 <> 0"


@query(f"WITH l AS (SELECT max(d.pos) AS src, u.pos AS dst FROM ({_USES}) u JOIN ({_DEFS}) d ON d.scope = u.scope AND d.name = u.name AND d.pos <= u.pos WHERE u.name = 'click' GROUP BY u.scope, u.pos), f AS (SELECT min(src) AS a FROM l) SELECT 0 AS step, a AS node FROM f UNION ALL SELECT 1, min(dst) FROM l, f WHERE src = a")
def data_path(spark, sf_dir):
    """The way from the first definition of a click that is used to its first use."""
    from strandgraph.operators import flow

    links = flow.def_use(*definitions(spark, sf_dir)).where("def_pos IS NOT NULL AND name = 'click'").select(F.col("def_pos").alias("src"), F.col("use_pos").alias("dst"))
    g = graph.CodeGraph(links)
    first = g.written().agg(F.min("src").alias("node"))
    end = g.written().join(first.withColumnRenamed("node", "src"), "src", "left_semi").agg(F.min("dst").alias("node"))
    return g.shortest_path(first, end)


@query(f"SELECT id, module || '#' || name || '#' || id AS entity, type, module FROM {ENT}")
def entity_graph_nodes(spark, sf_dir):
    return part_entities(spark, sf_dir).select("id", F.concat_ws("#", "module", "name", F.col("id").cast("string")).alias("entity"), "type", "module")


@query(f"WITH {G_PART} SELECT a.p_brand AS src, b.p_brand AS dst, count(*) AS calls, CASE WHEN a.p_brand = b.p_brand THEN 'internal' ELSE 'import' END AS type FROM e JOIN part a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst GROUP BY ALL")
def module_edges(spark, sf_dir):
    """Edges between entities as edges between their modules."""
    home = part_entities(spark, sf_dir).select("id", "module")
    e = part_edges(spark, sf_dir).join(home.select(F.col("id").alias("src"), F.col("module").alias("a")), "src").join(home.select(F.col("id").alias("dst"), F.col("module").alias("b")), "dst")
    return e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("calls")).withColumn("type", F.when(F.col("src") == F.col("dst"), "internal").otherwise("import"))


@query("SELECT p_partkey AS id, length(p_name)::DOUBLE AS x, length(p_brand)::DOUBLE AS y, 3 AS dimension FROM part WHERE p_size > 45")
def provided_embeddings(spark, sf_dir):
    """Vectors of a function of texts that the caller brings."""
    ents = read(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_name", "p_brand").alias("text"))
    provider = lambda texts: [[len(t.split("|")[0]), len(t.split("|")[1]), 1] for t in texts]
    v = F.col("vector")
    return vectors.embed_with(ents, provider).select("id", v[0].alias("x"), v[1].alias("y"), F.size(v).alias("dimension"))


@query(f"SELECT id, round(2.0::DOUBLE / length(name), 6) AS score FROM {ENT} WHERE starts_with(lower(name), 're') ORDER BY score DESC, id LIMIT 10")
def similar_or_prefix(spark, sf_dir):
    """A search by vector falls back to names where there are no vectors."""
    return vectors.by_vector_or_prefix(part_entities(spark, sf_dir).select("id", "name"), "re", None)


@query(f"SELECT id, name, type FROM {ENT} WHERE id % 3 = 0 AND type IN ('PROMO', 'SMALL')")
def exported_of_kind(spark, sf_dir):
    return part_entities(spark, sf_dir).where("id % 3 = 0 AND type IN ('PROMO', 'SMALL')").select("id", "name", "type")


@fixture(literal("file, type", [("src/api.ts", "any types")]))
def untyped_files(spark, sf_dir):
    """Files with more than three declared ``any``."""
    from strandgraph.functions import rules

    more = spark.createDataFrame([("src/api.ts", "let a: any; let b:any, c: any = 1; f(x: any)"), ("src/b.ts", "let a: any; let many: anything")], "file string, content string")
    return more.where(F.size(rules.type_issues(F.col("content"))) > 0).select("file", F.lit("any types").alias("type"))


@fixture(literal("name, recursive", [("helper", False), ("main", False), ("loop", True)]))
def recursive_functions(spark, sf_dir):
    from strandgraph.functions import rules

    rows = spark.createDataFrame([("helper", project.HELPER), ("main", project.INDEX), ("loop", "function loop(n) { return loop(n - 1); }")], "name string, content string")
    return rows.select("name", rules.is_recursive(F.col("name"), F.col("content")).alias("recursive"))


@query(f"WITH RECURSIVE {G_PART}, b AS (SELECT dst AS src, src AS dst FROM e), w(node, path) AS (SELECT node, [node] FROM (SELECT max(dst) AS node FROM e) UNION ALL SELECT b.dst, list_append(path, b.dst) FROM w JOIN b ON w.node = b.src WHERE len(path) <= 4 AND NOT list_contains(path, b.dst)), s AS (SELECT node, min(len(path)) AS n FROM w GROUP BY node) SELECT w.node, (n - 1)::INT AS distance, array_to_string(min(path), '>') AS path FROM w JOIN s ON w.node = s.node AND len(path) = n GROUP BY w.node, n")
def impact_paths(spark, sf_dir):
    """What depends on a node, how far away it is, and how: an impact record."""
    g = part_graph(spark, sf_dir)
    found = g.reversed().shortest_paths(g.written().agg(F.max("dst").alias("node")), 4)
    return found.select("node", "distance", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))
