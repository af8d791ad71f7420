"""Queries of graph, resolution, flow and search operators over views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandgraph.operators import clusters, flow, graph, resolve, search, vectors

from .catalogue import CLOSURE, ENT, ENTRY, G_EVENT, G_PART, distances, event_graph, fixture, part_edges, part_entities, part_graph, query, read

FROM_ENTRIES = f"{distances(ENTRY)}, far AS (SELECT node, min(distance) AS d FROM r GROUP BY node)"
DEEPEST = "last AS (SELECT node, d FROM far ORDER BY d DESC, node LIMIT 1)"
WAY = """way(node, d) AS (SELECT node, d FROM last UNION ALL SELECT * FROM (SELECT min(e.src) AS node, way.d - 1 AS d FROM way JOIN e ON e.dst = way.node JOIN far ON far.node = e.src AND far.d = way.d - 1 GROUP BY way.d))"""


def way_to_deepest(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    far = g.levels_from_roots()
    return g, g.shortest_path(g.entry_points(), far.orderBy(F.desc("level"), "node").limit(1))


@query(f"WITH RECURSIVE {G_PART}, {FROM_ENTRIES}, {DEEPEST}, {WAY} SELECT d::INT AS step, node FROM way")
def shortest_path(spark, sf_dir):
    return way_to_deepest(spark, sf_dir)[1]


@query(f"WITH RECURSIVE {G_PART}, {FROM_ENTRIES}, {DEEPEST}, {WAY} SELECT d::INT AS step, node, p_name AS name, p_brand AS module, lead(node) OVER (ORDER BY d) AS next_node FROM way JOIN part ON p_partkey = node")
def path_with_metadata(spark, sf_dir):
    path = way_to_deepest(spark, sf_dir)[1]
    named = path.join(part_entities(spark, sf_dir).withColumnRenamed("id", "node"), "node")
    return named.select("step", "node", "name", "module", F.lead("node").over(Window.orderBy("step")).alias("next_node"))  # one path


@query(f"WITH RECURSIVE {G_PART}, {FROM_ENTRIES}, {DEEPEST} SELECT (SELECT d FROM last)::INT AS length, (SELECT count(*) FROM far) AS explored_nodes, (SELECT count(*) FROM e WHERE src IN (SELECT node FROM far)) AS explored_edges, 'found' AS status")
def graph_between(spark, sf_dir):
    """How two nodes hang together: the path's length, what was explored for it, and whether there is one."""
    g, path = way_to_deepest(spark, sf_dir)
    seen = g.reach(g.entry_points()).select("node")
    edges = g.written().join(seen.withColumnRenamed("node", "src"), "src", "left_semi").agg(F.count("*").alias("explored_edges"))
    length = path.agg(F.max("step").alias("length"))
    return length.join(seen.agg(F.count("*").alias("explored_nodes"))).join(edges).withColumn("status", F.when(F.col("length").isNull(), "no path").otherwise("found"))  # one row each


@query(f"""WITH RECURSIVE {G_PART}, {FROM_ENTRIES}, {CLOSURE.replace('r(a, b)', 'c(a, b)').replace('r.', 'c.').replace('FROM r', 'FROM c')}, cy AS (SELECT count(*) AS n FROM e WHERE src = dst OR EXISTS (SELECT 1 FROM c WHERE c.a = e.dst AND c.b = e.src))
SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM nd WHERE node NOT IN (SELECT dst FROM e)) AS entries, (SELECT count(*) FROM nd WHERE node NOT IN (SELECT src FROM e)) AS leaves, n AS cyclic_edges, n > 0 AS has_cycles, (SELECT max(d) FROM far)::INT AS max_depth FROM cy""")
def graph_summary(spark, sf_dir):
    return part_graph(spark, sf_dir).summary()


@query(f"WITH RECURSIVE {G_PART}, {CLOSURE}, s AS (SELECT x.a AS node, max(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT scc, count(*) AS size, string_agg(node, ',' ORDER BY node) AS members FROM s GROUP BY scc")
def cycles(spark, sf_dir):
    return part_graph(spark, sf_dir).cycles()


@query(f"WITH RECURSIVE {G_EVENT}, {CLOSURE}, s AS (SELECT x.a AS node, max(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT e.src, e.dst, a.scc FROM e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst WHERE a.scc = b.scc")
def cycle_edges(spark, sf_dir):
    """Edges on cycles with the cycle they are on."""
    return event_graph(spark, sf_dir).cyclic_edges()


@query(f"WITH {G_PART}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e) SELECT count(*) FILTER (a.src <= a.dst) AS pairs FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src")
def two_node_cycles(spark, sf_dir):
    return part_graph(spark, sf_dir).mutual().agg(F.count("*").alias("pairs"))


@query(f"""WITH RECURSIVE {G_PART}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w(node, path) AS (SELECT node, [node] FROM (SELECT min(node) AS node FROM nd) UNION ALL SELECT b.dst, list_append(path, b.dst) FROM w JOIN b ON w.node = b.src WHERE len(path) <= 3 AND NOT list_contains(path, b.dst)),
s AS (SELECT node, min(len(path)) AS n FROM w GROUP BY node), sp AS (SELECT w.node, min(path) AS path FROM w JOIN s ON w.node = s.node AND len(path) = n WHERE n > 1 GROUP BY w.node)
SELECT node, (len(path) - 1)::INT AS distance, round(1 - (len(path) - 1) / 3.0::DOUBLE, 6) AS score, array_to_string(path, '>') AS path FROM sp ORDER BY distance, node LIMIT 50""")
def neighbourhood_paths(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    near = g.neighbourhood(g.nodes.agg(F.min("node").alias("node")), 3, 50, with_path=True)
    return near.select("node", "distance", "score", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))


@query(f"WITH RECURSIVE {G_PART}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), c(a, z) AS (SELECT node, node FROM nd UNION SELECT c.a, b.dst FROM c JOIN b ON c.z = b.src AND b.dst < c.a) SELECT node, component, node NOT IN (SELECT dst FROM e) AS is_entry FROM (WITH RECURSIVE l(node, root) AS (SELECT node, node FROM nd UNION SELECT b.dst, l.root FROM l JOIN b ON l.node = b.src WHERE l.root < b.dst) SELECT node, min(root) AS component FROM l GROUP BY node)")
def flow_partition(spark, sf_dir):
    """Which nodes hang together, and which of them are entries."""
    g = part_graph(spark, sf_dir)
    entries = g.entry_points().withColumn("e", F.lit(True))
    return g.weak_components().join(entries, "node", "left").select("node", "component", F.coalesce("e", F.lit(False)).alias("is_entry"))


GEO = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


def geo_graph(spark, sf_dir):
    edge = lambda t, a, x, b, y: read(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    nations, customers, suppliers = edge("nation", "r", "n_regionkey", "n", "n_nationkey"), edge("customer", "n", "c_nationkey", "c", "c_custkey"), edge("supplier", "n", "s_nationkey", "s", "s_suppkey")
    return graph.CodeGraph(nations.union(customers).union(suppliers))


@query(f"WITH RECURSIVE {GEO}, {distances(ENTRY)} SELECT node, min(distance)::INT AS level FROM r GROUP BY node")
def level_from_root(spark, sf_dir):
    return geo_graph(spark, sf_dir).levels_from_roots()


@query(f"WITH RECURSIVE {GEO}, {distances(ENTRY)}, l AS (SELECT node, min(distance)::INT AS level FROM r GROUP BY node) SELECT level, count(*) AS nodes, count(*) FILTER (node LIKE 'c%') AS customers FROM l GROUP BY level")
def nodes_by_level(spark, sf_dir):
    return geo_graph(spark, sf_dir).levels_from_roots().groupBy("level").agg(F.count("*").alias("nodes"), F.count_if(F.col("node").startswith("c")).alias("customers"))


@query(f"WITH RECURSIVE {GEO}, {distances(ENTRY)}, l AS (SELECT node, min(distance)::INT AS level FROM r GROUP BY node) SELECT node FROM l WHERE level = 1")
def modules_at_level(spark, sf_dir):
    return geo_graph(spark, sf_dir).levels_from_roots().where("level = 1").select("node")


_WAYS = "ways(start, fin, here, path) AS (SELECT start, fin, start, [start] FROM asked UNION ALL SELECT start, fin, x.dst, list_append(path, x.dst) FROM ways JOIN x ON ways.here = x.src WHERE ways.here <> fin AND len(path) <= {most} AND NOT list_contains(path, x.dst))"


def _best(k: int, columns: str) -> str:
    return f"SELECT {columns}, array_to_string(path, '>') AS path, (len(path) - 1)::INT AS length FROM ways WHERE here = fin AND start <> fin QUALIFY row_number() OVER (PARTITION BY start, fin ORDER BY len(path), path) <= {k}"


def _as_text(paths):
    return paths.withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), ">"))


@query(f"WITH RECURSIVE {GEO}, x AS (SELECT * FROM e UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem), asked AS (SELECT DISTINCT 'r0' AS start, 'p' || l_partkey AS fin FROM lineitem), w(here, path) AS (SELECT 'r0', ['r0'] UNION ALL SELECT x.dst, list_append(path, x.dst) FROM w JOIN x ON w.here = x.src WHERE len(path) <= 5 AND NOT list_contains(path, x.dst)), ways AS (SELECT 'r0' AS start, here AS fin, here, path FROM w WHERE here LIKE 'p%') {_best(10, 'fin AS part')}")
def mixed_paths(spark, sf_dir):
    """The first ten ways from a region to each part in the union of three edge sets."""
    supplied = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    mixed = graph.CodeGraph(graph.merge(geo_graph(spark, sf_dir).edges, supplied))
    pairs = supplied.select(F.lit("r0").alias("start"), F.col("dst").alias("end"))
    return _as_text(mixed.best_paths(pairs, 10, 5)).select(F.col("end").alias("part"), "path", "length")


@query(f"WITH RECURSIVE {G_PART}, x AS (SELECT * FROM e), asked AS (SELECT DISTINCT min(l_partkey) AS start, max(l_partkey) AS fin FROM lineitem GROUP BY l_orderkey HAVING min(l_partkey) <> max(l_partkey)), {_WAYS.format(most=4)} {_best(3, 'start AS first_part, fin AS last_part')}")
def best_part_paths(spark, sf_dir):
    """The three best paths of at most four edges from the smallest to the largest part of each order."""
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("start"), F.max("l_partkey").alias("end"))
    return _as_text(part_graph(spark, sf_dir).best_paths(orders, 3, 4)).select(F.col("start").alias("first_part"), F.col("end").alias("last_part"), "path", "length")


@query(f"WITH RECURSIVE {G_EVENT}, x AS (SELECT * FROM e), asked AS (SELECT DISTINCT event_type AS start, lead(event_type, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fin FROM events), {_WAYS.format(most=4)} {_best(5, 'start AS first_event, fin AS last_event')}")
def best_event_paths(spark, sf_dir):
    """The five best ways from a type of event to what a user's third event after it is, where nearly every type follows every other."""
    later = F.lead("event_type", 3).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = read(spark, sf_dir, "events").select(F.col("event_type").alias("start"), later.alias("end"))
    return _as_text(event_graph(spark, sf_dir).best_paths(pairs, 5, 4)).select(F.col("start").alias("first_event"), F.col("end").alias("last_event"), "path", "length")


@query(f"WITH RECURSIVE {G_PART}, {distances('SELECT min(src), 0 FROM e')} SELECT node FROM nd WHERE node NOT IN (SELECT node FROM r)")
def unreachable_nodes(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return g.unreachable(g.edges.agg(F.min("src").alias("node")))


@query(f"WITH {G_PART}, n AS (SELECT src AS node, 'imports' AS direction, dst AS neighbour FROM e UNION ALL SELECT dst, 'imported_by', src FROM e) SELECT n.node, direction, neighbour, p_name AS name, p_brand AS module FROM n JOIN part ON p_partkey = neighbour WHERE node % 10 = 3")
def connections(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    found = g.neighbours(g.nodes.where("node % 10 = 3"))
    return found.join(part_entities(spark, sf_dir).select(F.col("id").alias("neighbour"), "name", "module"), "neighbour").select("node", "direction", "neighbour", "name", "module")


@query(f"WITH {G_PART}, x AS (SELECT src, dst FROM e WHERE src % 2 = 0) SELECT e.src, e.dst, CASE WHEN e.src % 2 = 0 THEN 'imports' ELSE 'imported_by' END AS shown_as FROM e WHERE e.src % 2 = 0 OR e.dst % 2 = 0")
def edges_by_direction(spark, sf_dir):
    """Edges that leave or enter the focus (even nodes), each once."""
    even = lambda c: F.col(c) % 2 == 0
    return part_edges(spark, sf_dir).where(even("src") | even("dst")).select("src", "dst", F.when(even("src"), "imports").otherwise("imported_by").alias("shown_as"))


@query(f"WITH {G_EVENT}, f AS (SELECT 'click' AS m) SELECT src, dst, src = m AS outward, dst = m AS inward, src = m OR dst = m AS either, src = m AND dst = m AS loop FROM e, f")
def focused_edges(spark, sf_dir):
    src, dst = F.col("src") == "click", F.col("dst") == "click"
    return event_graph(spark, sf_dir).edges.select("src", "dst", src.alias("outward"), dst.alias("inward"), (src | dst).alias("either"), (src & dst).alias("loop"))


@query(f"WITH {G_PART} SELECT dst AS callee, string_agg(src, ',' ORDER BY src) AS called_by, count(*) AS callers FROM e GROUP BY dst")
def called_by(spark, sf_dir):
    return part_edges(spark, sf_dir).groupBy(F.col("dst").alias("callee")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ",").alias("called_by"), F.count("*").alias("callers"))


@query("SELECT node, coalesce(i.n, 0) AS imports, coalesce(o.n, 0) AS imported_by, i.a AS least_import, o.a AS least_importer FROM (SELECT l_suppkey AS node, count(DISTINCT l_partkey) AS n, min(l_partkey) AS a FROM lineitem GROUP BY 1) i FULL JOIN (SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS a FROM lineitem GROUP BY 1) o USING (node)")
def supply_adjacency(spark, sf_dir):
    """Degrees and least neighbours of the graph supplier -> part, both ends numbered alike."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("i"), F.min("dst").alias("least_import"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("o"), F.min("src").alias("least_importer"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("i", F.lit(0)).alias("imports"), F.coalesce("o", F.lit(0)).alias("imported_by"), "least_import", "least_importer")


_TYPED = "SELECT l_suppkey AS src, l_partkey % 50 AS dst, l_linestatus AS type FROM lineitem WHERE l_returnflag = '{}' AND l_linenumber < 3"


@query(f"WITH a AS (SELECT src, dst, string_agg(DISTINCT type, ',' ORDER BY type) AS t FROM ({_TYPED.format('A')}) GROUP BY 1, 2), b AS (SELECT src, dst, string_agg(DISTINCT type, ',' ORDER BY type) AS t FROM ({_TYPED.format('R')}) GROUP BY 1, 2) SELECT CASE WHEN a.t IS NULL THEN 'added_edge' WHEN b.t IS NULL THEN 'removed_edge' ELSE 'type_changed' END AS change, src, dst, a.t AS old_types, b.t AS new_types FROM a FULL JOIN b USING (src, dst) WHERE a.t IS DISTINCT FROM b.t")
def typed_graph_diff(spark, sf_dir):
    side = lambda flag: read(spark, sf_dir, "lineitem").where((F.col("l_returnflag") == flag) & (F.col("l_linenumber") < 3)).select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_linestatus").alias("type"))
    return graph.typed_diff(side("A"), side("R"))


def _sides(flag: str) -> str:
    from .catalogue import _split

    return _split(flag)


@query(f"WITH e AS (SELECT * FROM {_sides('A')} UNION SELECT * FROM {_sides('N')}) SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")
def merged_entry_points(spark, sf_dir):
    """Entry points of two merged graphs, found anew."""
    return graph.CodeGraph(graph.merge(part_edges(spark, sf_dir, "A"), part_edges(spark, sf_dir, "N"))).entry_points()


@fixture("SELECT 0::BIGINT AS nodes, 0::BIGINT AS edges")
def empty_graph(spark, sf_dir):
    g = graph.empty(spark)
    return g.nodes.agg(F.count("*").alias("nodes")).join(g.edges.agg(F.count("*").alias("edges")))  # one row each



def _rings(edges: str, length: int) -> str:
    return f"w(start, here, path) AS (SELECT src, dst, [src] FROM {edges} UNION ALL SELECT start, {edges}.dst, list_append(path, here) FROM w JOIN {edges} ON w.here = {edges}.src WHERE here <> start AND here > start AND NOT list_contains(path, here) AND len(path) < {length}), ri AS (SELECT DISTINCT len(path)::INT AS length, array_to_string(path, '>') AS path FROM w WHERE here = start AND start = list_min(path) AND len(list_distinct(path)) = len(path))"


@query(f"WITH RECURSIVE {G_EVENT}, {_rings('e', 5)} SELECT length, path FROM ri")
def event_cycles(spark, sf_dir):
    """All ways in which types of events follow each other round to where they began."""
    return event_graph(spark, sf_dir).cycle_paths(5).select("length", "path")


@query(f"WITH RECURSIVE {G_PART}, {CLOSURE}, ce AS (SELECT e.src, e.dst FROM e WHERE e.src = e.dst OR EXISTS (SELECT 1 FROM r WHERE r.a = e.dst AND r.b = e.src)), {_rings('ce', 12)} SELECT length, path FROM ri")
def part_cycles(spark, sf_dir):
    return part_graph(spark, sf_dir).cycle_paths(12).select("length", "path")


# --- control and data flow: a user's events are a function's statements ---

STATEMENTS = """st AS (SELECT user_id AS fn, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, CASE event_type WHEN 'error' THEN 'return' WHEN 'purchase' THEN 'jump' WHEN 'click' THEN 'branch' ELSE 'plain' END AS kind, CASE WHEN event_type IN ('purchase', 'click') THEN (event_id % 90)::INT END AS target FROM events WHERE user_id % 5 = 0 OR true),
ld AS (SELECT st.*, (t.pos IS NOT NULL) OR coalesce(lag(kind) OVER (PARTITION BY st.fn ORDER BY st.pos) <> 'plain', true) AS leader FROM st LEFT JOIN (SELECT DISTINCT fn, target AS pos FROM st WHERE kind IN ('branch', 'jump')) t ON st.fn = t.fn AND st.pos = t.pos),
bl AS (SELECT fn, pos, kind, target, (sum(leader::INT) OVER (PARTITION BY fn ORDER BY pos) - 1)::INT AS block FROM ld),
la AS (SELECT fn, block, arg_max(kind, pos) AS kind, max(pos) AS last_pos FROM bl GROUP BY 1, 2),
lt AS (SELECT la.*, bl.target, lead(la.block) OVER (PARTITION BY la.fn ORDER BY la.block) AS nxt FROM la JOIN bl ON bl.fn = la.fn AND bl.pos = la.last_pos),
lo AS (SELECT lt.*, a.block AS aimed FROM lt LEFT JOIN bl a ON a.fn = lt.fn AND a.pos = lt.target),
cf AS (SELECT DISTINCT fn, fn || ':' || block AS src, fn || ':' || unnest(CASE kind WHEN 'return' THEN ['exit'] WHEN 'jump' THEN [coalesce(aimed::VARCHAR, 'exit')] WHEN 'branch' THEN [coalesce(nxt::VARCHAR, 'exit'), coalesce(aimed::VARCHAR, 'exit')] ELSE [coalesce(nxt::VARCHAR, 'exit')] END) AS dst FROM lo
UNION SELECT DISTINCT fn, fn || ':entry', fn || ':0' FROM bl)"""


def statements(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = F.when(F.col("event_type") == "error", "return").when(F.col("event_type") == "purchase", "jump").when(F.col("event_type") == "click", "branch").otherwise("plain")
    target = F.when(F.col("event_type").isin("purchase", "click"), (F.col("event_id") % 90).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("fn"), place.alias("pos"), kind.alias("kind"), target.alias("target"))


@query(f"WITH {STATEMENTS} SELECT fn, pos, kind, leader FROM ld")
def statement_leaders(spark, sf_dir):
    return flow.leaders(statements(spark, sf_dir)).select("fn", "pos", "kind", "leader")


@query(f"WITH {STATEMENTS} SELECT fn, pos, kind, target, block FROM bl")
def basic_blocks(spark, sf_dir):
    return flow.blocks(statements(spark, sf_dir))


@query(f"WITH {STATEMENTS} SELECT fn, src, dst FROM cf")
def control_flow_edges(spark, sf_dir):
    return flow.cfg(statements(spark, sf_dir))


@query(f"WITH {STATEMENTS}, n AS (SELECT fn, count(*) AS nodes FROM (SELECT fn, src FROM cf UNION SELECT fn, dst FROM cf) GROUP BY fn), c AS (SELECT fn, count(*) AS edges FROM cf GROUP BY fn) SELECT fn, edges, nodes, greatest(1, edges - nodes + 2) AS complexity FROM c JOIN n USING (fn)")
def flow_complexity(spark, sf_dir):
    return flow.complexity(statements(spark, sf_dir))


_E = "e AS (SELECT src, dst FROM cf), nd AS (SELECT src AS node, fn FROM cf UNION SELECT dst, fn FROM cf), ok(node) AS (SELECT DISTINCT fn || ':entry' FROM cf UNION SELECT e.dst FROM ok JOIN e ON ok.node = e.src)"
_DOM = f"{_E}, rn AS (SELECT nd.node, fn FROM nd JOIN ok USING (node)), av(d, node) AS (SELECT a.node, b.node FROM rn a JOIN rn b ON a.fn = b.fn WHERE b.node LIKE '%:entry' AND a.node <> b.node UNION SELECT av.d, e.dst FROM av JOIN e ON av.node = e.src WHERE e.dst <> av.d), dm AS (SELECT b.node, a.node AS dom FROM rn a JOIN rn b ON a.fn = b.fn WHERE NOT EXISTS (SELECT 1 FROM av WHERE av.d = a.node AND av.node = b.node))"


@query(f"WITH RECURSIVE {STATEMENTS}, {_E} SELECT node FROM nd WHERE node NOT IN (SELECT node FROM ok)")
def unreachable_blocks(spark, sf_dir):
    g, entry = flow.cfg_graph(statements(spark, sf_dir))
    return g.unreachable(entry)


@query(f"WITH RECURSIVE {STATEMENTS}, {_DOM} SELECT node, dom FROM dm")
def block_dominators(spark, sf_dir):
    st = statements(spark, sf_dir)
    g, entry = flow.cfg_graph(st)
    return graph.dominators(g.written(), entry, flow.scopes(st))


@query(f"WITH RECURSIVE {STATEMENTS}, {_DOM}, bk AS (SELECT e.src, e.dst FROM e JOIN dm ON dm.node = e.src AND dm.dom = e.dst), lp(head, node) AS (SELECT dst, src FROM bk UNION SELECT lp.head, e.src FROM lp JOIN e ON e.dst = lp.node WHERE lp.node <> lp.head) SELECT DISTINCT head, node FROM (SELECT * FROM lp UNION SELECT dst, dst FROM bk)")
def natural_loops(spark, sf_dir):
    st = statements(spark, sf_dir)
    g, entry = flow.cfg_graph(st)
    return g.natural_loops(entry, flow.scopes(st))


_DEFS = "SELECT user_id AS scope, event_type AS name, event_id AS pos, value < 5 AS is_const FROM events WHERE event_id % 3 = 0"
_USES = "SELECT user_id AS scope, event_type AS name, event_id AS pos FROM events WHERE event_id % 3 <> 0"


def definitions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("name"), F.col("event_id").alias("pos"), (F.col("value") < 5).alias("is_const"))
    return e.where("pos % 3 = 0"), e.where("pos % 3 <> 0").drop("is_const")


@query(f"SELECT u.scope, u.name, max(d.pos) AS def_pos, u.pos AS use_pos FROM ({_USES}) u LEFT JOIN ({_DEFS}) d ON d.scope = u.scope AND d.name = u.name AND d.pos <= u.pos GROUP BY u.scope, u.name, u.pos")
def reaching_definitions(spark, sf_dir):
    return flow.def_use(*definitions(spark, sf_dir))


@query(f"WITH d AS ({_DEFS}), u AS ({_USES}), v AS (SELECT scope, name, count(*) AS n, bool_or(is_const) AS c FROM d GROUP BY 1, 2), w AS (SELECT v.*, EXISTS (SELECT 1 FROM u WHERE u.scope = v.scope AND u.name = v.name) AS used FROM v) SELECT count(*) AS total, count(*) FILTER (used) AS used, count(*) FILTER (NOT used) AS unused, count(*) FILTER (c) AS constants, count(*) FILTER (c AND n > 1) AS reassigned_constants FROM w")
def variable_stats(spark, sf_dir):
    return flow.variable_stats(*definitions(spark, sf_dir))


@query(f"SELECT scope, name, count(*) AS times FROM ({_DEFS}) WHERE is_const GROUP BY 1, 2 HAVING count(*) > 1")
def reassigned_constants(spark, sf_dir):
    return flow.reassigned(definitions(spark, sf_dir)[0])


@query(f"SELECT pos, 'def' AS role FROM ({_DEFS}) WHERE scope = 7 AND name = 'click' UNION ALL SELECT pos, 'use' FROM ({_USES}) WHERE scope = 7 AND name = 'click'")
def def_use_chain(spark, sf_dir):
    return flow.chain(*definitions(spark, sf_dir), 7, "click")


@query(f"WITH RECURSIVE d AS (SELECT u.scope, u.name, max(d.pos) AS src, u.pos AS dst FROM ({_USES}) u JOIN ({_DEFS}) d ON d.scope = u.scope AND d.name = u.name AND d.pos <= u.pos GROUP BY u.scope, u.name, u.pos), n AS (SELECT pos AS src, lead(pos) OVER (PARTITION BY scope ORDER BY pos) AS dst FROM (SELECT scope, pos FROM ({_USES}) WHERE name = 'purchase' UNION SELECT scope, pos FROM ({_DEFS}) WHERE name = 'purchase')), e AS (SELECT src, dst FROM d UNION SELECT src, dst FROM n WHERE dst IS NOT NULL), {distances('SELECT min(src), 0 FROM e', 'e', 300)} SELECT node, min(distance)::INT AS distance FROM r GROUP BY node")
def data_dependencies(spark, sf_dir):
    """Everything the first definition flows into: through its uses and through the purchases that follow each other."""
    defs, uses = definitions(spark, sf_dir)
    links = flow.def_use(defs, uses).where("def_pos IS NOT NULL").select(F.col("def_pos").alias("src"), F.col("use_pos").alias("dst"))
    bought = defs.select("scope", "name", "pos").union(uses).where("name = 'purchase'")
    follows = bought.select(F.col("pos").alias("src"), F.lead("pos").over(Window.partitionBy("scope").orderBy("pos")).alias("dst")).where("dst IS NOT NULL")
    g = graph.CodeGraph(links.union(follows))
    return g.reach(g.written().agg(F.min("src").alias("node")))


# A statement uses the variable of its event's type; every third one sets that of another type before it goes on.
_TYPES = ("view", "click", "purchase", "signup", "error")
_SETS = "CASE event_id % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TYPES)) + " END"
_FLOW = f"""{STATEMENTS},
at AS (SELECT user_id AS fn, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS pos, event_type AS used, CASE WHEN event_id % 3 = 0 THEN {_SETS} END AS def FROM events),
df AS (SELECT at.fn, bl.block, at.pos, def AS name FROM at JOIN bl ON bl.fn = at.fn AND bl.pos = at.pos WHERE def IS NOT NULL),
us AS (SELECT at.fn, bl.block, at.pos, used AS name FROM at JOIN bl ON bl.fn = at.fn AND bl.pos = at.pos),
gn AS (SELECT fn, block, fn || ':' || block AS src, name, max(pos) AS def_pos FROM df GROUP BY ALL),
rd(fn, blk, name, def_pos) AS (SELECT gn.fn, cf.dst, name, def_pos FROM gn JOIN cf ON cf.src = gn.src
  UNION SELECT rd.fn, cf.dst, rd.name, rd.def_pos FROM rd JOIN cf ON cf.src = rd.blk WHERE NOT EXISTS (SELECT 1 FROM gn WHERE gn.src = rd.blk AND gn.name = rd.name)),
lk AS (SELECT us.fn, us.name, coalesce((SELECT max(df.pos) FROM df WHERE df.fn = us.fn AND df.block = us.block AND df.name = us.name AND df.pos < us.pos), rd.def_pos) AS def_pos, us.pos AS use_pos
  FROM us LEFT JOIN rd ON rd.blk = us.fn || ':' || us.block AND rd.name = us.name),
du AS (SELECT DISTINCT fn, name, def_pos, use_pos FROM lk)""".replace("at AS (SELECT user_id", "am AS (SELECT user_id").replace("at.", "am.").replace("FROM at ", "FROM am ")


def _flow_links(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    sets = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("event_id") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("fn"), place.alias("pos"), "event_type", F.when(F.col("event_id") % 3 == 0, sets).alias("name"))
    defs, uses = rows.where("name IS NOT NULL").select("fn", "pos", "name"), rows.select("fn", "pos", F.col("event_type").alias("name"))
    return statements(spark, sf_dir), defs, uses


@query(f"WITH RECURSIVE {_FLOW} SELECT fn, blk AS block, name, def_pos FROM rd")
def definitions_at_blocks(spark, sf_dir):
    """What reaches each basic block, over branches, jumps and loops."""
    st, defs, _ = _flow_links(spark, sf_dir)
    return flow.definitions_at_blocks(st, defs)


@query(f"WITH RECURSIVE {_FLOW} SELECT fn, name, def_pos, use_pos FROM du")
def flow_def_use(spark, sf_dir):
    return flow.flow_def_use(*_flow_links(spark, sf_dir))


_LINKS = f"{_FLOW}, e AS (SELECT DISTINCT fn || ':' || def_pos AS src, fn || ':' || use_pos AS dst FROM du WHERE def_pos IS NOT NULL)"


@query(f"WITH RECURSIVE {_LINKS}, b AS (SELECT dst AS src, src AS dst FROM e), {distances('SELECT fn || chr(58) || max(use_pos), 0 FROM du WHERE def_pos IS NOT NULL GROUP BY fn', 'b')} SELECT node, min(distance)::INT AS distance FROM r GROUP BY node")
def flow_dependencies(spark, sf_dir):
    """All that the last statement of each function that uses something depends on, through any number of statements."""
    return flow.last_dependencies(flow.flow_def_use(*_flow_links(spark, sf_dir)))


# --- resolution ---

_ID = "replace(p_name, ' ', '_') || '_' || p_partkey"
_FILE = f"'src/' || replace(lower(p_brand), '#', '') || '/' || {_ID} || CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' WHEN 2 THEN '/index.tsx' ELSE '.vue' END"
FILES = f"fl AS (SELECT {_FILE} AS path FROM part WHERE p_partkey % 9 <> 0)"
IMPORTS = f"im AS (SELECT DISTINCT a.path AS file, '../' || replace(lower(b.p_brand), '#', '') || '/' || replace(b.p_name, ' ', '_') || '_' || b.p_partkey || CASE WHEN b.p_partkey % 4 < 2 AND b.p_partkey % 3 = 0 THEN '.js' ELSE '' END AS specifier FROM e JOIN (SELECT p_partkey, {_FILE} AS path FROM part) a ON a.p_partkey = e.src JOIN part b ON b.p_partkey = e.dst WHERE a.p_partkey % 4 <> 2)"
_TRY = "[base, CASE WHEN base LIKE '%.js' THEN base[1:length(base) - 3] || '.ts' WHEN base LIKE '%.ts' THEN base[1:length(base) - 3] || '.js' END, base || '.ts', base || '.tsx', base || '.js', base || '.jsx', base || '.mjs', base || '.cjs', base || '/index.ts', base || '/index.tsx', base || '/index.js', base || '/index.jsx', base || '/index.mjs', base || '/index.cjs', base || '/index']"
RESOLVED = f"{FILES}, {IMPORTS}, ba AS (SELECT file, specifier, 'src/' || specifier[4:] AS base FROM im), ca AS (SELECT file, specifier, unnest({_TRY}) AS path, generate_subscripts({_TRY}, 1) AS ord FROM ba), hi AS (SELECT file, specifier, arg_min(ca.path, ord) AS resolved FROM ca JOIN fl ON fl.path = ca.path GROUP BY 1, 2), rs AS (SELECT im.file, im.specifier, resolved FROM im LEFT JOIN hi USING (file, specifier))"


def project(spark, sf_dir):
    """Parts as files of a project, and the edges of the part graph as their imports."""
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    folder = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    end = F.element_at(F.array(*map(F.lit, (".ts", ".js", "/index.tsx", ".vue"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("src/"), folder, F.lit("/"), name, end).alias("path"), F.concat(F.lit("../"), folder, F.lit("/"), name, F.when((F.col("p_partkey") % 4 < 2) & (F.col("p_partkey") % 3 == 0), ".js").otherwise("")).alias("specifier"))
    files = parts.where("id % 9 <> 0").select("path")
    edges = part_edges(spark, sf_dir)
    imports = edges.join(parts.select(F.col("id").alias("src"), F.col("path").alias("file")), "src").join(parts.select(F.col("id").alias("dst"), "specifier"), "dst").where("src % 4 <> 2")
    return files, imports.select("file", "specifier").distinct()


@query(f"WITH {G_PART}, {RESOLVED} SELECT file, specifier, resolved FROM rs")
def resolve_imports_first_match(spark, sf_dir):
    files, imports = project(spark, sf_dir)
    return resolve.resolve_imports(imports, files)


@query(f"WITH {G_PART}, {RESOLVED} SELECT file, specifier FROM rs WHERE resolved IS NULL")
def unresolved_imports(spark, sf_dir):
    files, imports = project(spark, sf_dir)
    return resolve.unresolved_imports(resolve.resolve_imports(imports, files)).select("file", "specifier")


_ALIASES = [("@/*", "src/*"), ("#lib", "lib/index"), ("~*/x/*", "deep/*/y/*")]


@query(f"SELECT file, specifier, CASE WHEN specifier LIKE '@/%' THEN 'root/src/' || specifier[3:] WHEN specifier = '#lib' THEN 'root/lib/index' WHEN specifier LIKE '~%/x/%' THEN 'root/deep/' || regexp_extract(specifier, '^~(.*)/x/(.*)$', 1) || '/y/' || regexp_extract(specifier, '^~(.*)/x/(.*)$', 2) END AS alias_base FROM (SELECT p_partkey AS file, CASE p_partkey % 4 WHEN 0 THEN '@/' || {_ID} WHEN 1 THEN '#lib' WHEN 2 THEN '~' || {_ID} || '/x/' || lower(p_type) ELSE './' || {_ID} END AS specifier FROM part)")
def alias_paths(spark, sf_dir):
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    k = F.col("p_partkey") % 4
    spec = F.when(k == 0, F.concat(F.lit("@/"), name)).when(k == 1, "#lib").when(k == 2, F.concat(F.lit("~"), name, F.lit("/x/"), F.lower("p_type"))).otherwise(F.concat(F.lit("./"), name))
    return resolve.expand_aliases(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), spec.alias("specifier")), _ALIASES, ["file"], "root")


@query(f"WITH RECURSIVE {G_PART}, {RESOLVED}, ie AS (SELECT DISTINCT file AS src, coalesce(resolved, specifier) AS dst FROM rs), rt AS (SELECT min(src) AS root FROM ie), {distances('SELECT root, 1 FROM rt', 'ie', 6)} SELECT node, min(distance)::INT AS depth, node NOT IN (SELECT path FROM fl) AND node NOT IN (SELECT file FROM im) AS unresolved FROM r GROUP BY node")
def import_graph(spark, sf_dir):
    """What the first file imports, and what that imports, six deep; imports that mean no file stay as leaves."""
    files, imports = project(spark, sf_dir)
    edges = resolve.resolve_imports(imports, files).select(F.col("file").alias("src"), F.coalesce("resolved", "specifier").alias("dst"))
    g = graph.CodeGraph(edges)
    near = g.reach(g.written().agg(F.min("src").alias("node")), 5).select("node", (F.col("distance") + 1).alias("depth"))
    known = files.select(F.col("path").alias("node")).union(imports.select("file")).distinct().withColumn("k", F.lit(True))
    return near.join(known, "node", "left").select("node", "depth", F.col("k").isNull().alias("unresolved"))


_FN = "(SELECT p_partkey AS id, p_brand AS module, p_name AS name FROM part)"
_CALLS = "(SELECT DISTINCT p.p_brand AS module, l.l_orderkey AS caller, CASE WHEN l.l_linenumber = 7 THEN 'missing' ELSE q.p_name END AS callee FROM lineitem l JOIN part p ON p.p_partkey = l.l_suppkey JOIN part q ON q.p_partkey = l.l_partkey)"


@query(f"SELECT c.module, c.caller, c.callee, coalesce(a.id, b.id) AS target, CASE WHEN a.id IS NOT NULL THEN c.module ELSE b.module END AS target_module FROM {_CALLS} c LEFT JOIN (SELECT module, name, min(id) AS id FROM {_FN} GROUP BY 1, 2) a ON a.module = c.module AND a.name = c.callee LEFT JOIN (SELECT name, arg_min(id, (module, id)) AS id, min(module) AS module FROM {_FN} GROUP BY 1) b ON b.name = c.callee")
def call_resolution_same_module_first(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    calls = lines.join(part.select(F.col("p_partkey").alias("l_suppkey"), F.col("p_brand").alias("module")), "l_suppkey").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    calls = calls.select("module", F.col("l_orderkey").alias("caller"), F.when(F.col("l_linenumber") == 7, "missing").otherwise(F.col("p_name")).alias("callee")).distinct()
    return resolve.resolve_calls(calls, part_entities(spark, sf_dir).select("id", "module", "name"))


@query(f"WITH en AS (SELECT module || '#' || name || id AS id, name FROM {_FN}), ks AS (SELECT id, unnest(list_distinct([name, id, string_split(id, '#')[-1]])) AS callee FROM en), ca AS (SELECT id AS caller, CASE length(name) % 3 WHEN 0 THEN name WHEN 1 THEN id ELSE string_split(id, '#')[-1] || CASE WHEN length(id) % 2 = 0 THEN 'x' ELSE '' END END AS callee FROM en) SELECT caller, callee, min(id) AS target FROM ca LEFT JOIN ks USING (callee) GROUP BY 1, 2")
def call_edges(spark, sf_dir):
    """Calls by name, id or what follows the last # of an id."""
    en = part_entities(spark, sf_dir).select(F.concat("module", F.lit("#"), "name", F.col("id").cast("string")).alias("id"), "name")
    short = F.substring_index("id", "#", -1)
    callee = F.when(F.length("name") % 3 == 0, F.col("name")).when(F.length("name") % 3 == 1, F.col("id")).otherwise(F.concat(short, F.when(F.length("id") % 2 == 0, "x").otherwise("")))
    return resolve.resolve_by_any_key(en.select(F.col("id").alias("caller"), callee.alias("callee")).distinct(), en)


@query(f"WITH {G_PART} SELECT src, dst FROM e WHERE dst IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def edges_to_existing(spark, sf_dir):
    return part_edges(spark, sf_dir).join(read(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "dst")


@query(f"SELECT name, arg_min(module, id) AS module FROM {_FN} GROUP BY name")
def module_of_function(spark, sf_dir):
    return resolve.first_of_name(part_entities(spark, sf_dir))


_DAY = "date_diff('day', TIMESTAMP '1992-01-01', {})"


@query(f"WITH sp AS (SELECT o_custkey AS file, o_orderkey AS span, {_DAY.format('o_orderdate')} AS s FROM orders), pt AS (SELECT DISTINCT o_custkey AS file, {_DAY.format('l_shipdate')} AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT pt.file, pt.pos, arg_min(sp.span, (-sp.s, sp.s + 90, sp.span)) AS span FROM pt LEFT JOIN sp ON sp.file = pt.file AND sp.s <= pt.pos AND pt.pos < sp.s + 90 GROUP BY 1, 2")
def enclosing_function(spark, sf_dir):
    """The latest order of a customer that was open (90 days) when something was shipped to them."""
    day = lambda c: F.datediff(F.col(c), F.lit("1992-01-01")).cast("long")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("span"), day("o_orderdate").alias("start"))
    shipped = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("span"), day("l_shipdate").alias("pos")).join(orders.select("span", "file"), "span").select("file", "pos").distinct()
    return resolve.enclosing(shipped, orders.withColumn("end", F.col("start") + 90), cell=128)


@query("WITH f AS (SELECT DISTINCT p_name AS name, lower(p_brand) AS path FROM part WHERE p_size > 30), k AS (SELECT p_name AS name, 'src/' || lower(p_brand) || '/' || p_type AS path, p_partkey AS line FROM part WHERE p_size <= 30) SELECT f.name, f.path, arg_min(k.path, (k.path, k.line)) AS origin, arg_min(k.line, (k.path, k.line)) AS line FROM f LEFT JOIN k ON k.name = f.name AND (contains(k.path, f.path) OR contains(f.path, k.path)) GROUP BY 1, 2")
def enriched_functions(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    functions = p.where("p_size > 30").select(F.col("p_name").alias("name"), F.lower("p_brand").alias("path")).distinct()
    known = p.where("p_size <= 30").select(F.col("p_name").alias("name"), F.concat(F.lit("src/"), F.lower("p_brand"), F.lit("/"), "p_type").alias("path"), F.col("p_partkey").alias("line"))
    return resolve.with_origin(functions, known)


@query(r"WITH t AS (SELECT DISTINCT page_id AS file, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages UNION SELECT page_id, unnest(['Card', 'Row', 'Nav']) FROM pages) SELECT file, tag, CASE WHEN regexp_matches(tag, '^[a-z]') THEN 'intrinsic' WHEN tag = 'Card' AND file % 2 = 0 THEN 'imported' WHEN tag IN ('Card', 'Row') AND file % 3 = 0 THEN 'local' ELSE 'unknown' END AS kind FROM t")
def component_kinds(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), "html")
    tags = pages.select("file", F.explode(F.concat(F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), F.array(*map(F.lit, ("Card", "Row", "Nav"))))).alias("tag"))
    imports = pages.where("file % 2 = 0").select("file", F.lit("Card").alias("local"))
    local = pages.where("file % 3 = 0").select("file", F.explode(F.array(F.lit("Card"), F.lit("Row"))).alias("name"))
    return resolve.component_kinds(tags, imports, local)


# --- search ---


@query(f"""WITH q AS (SELECT id, name FROM {ENT}), x AS (SELECT id, name, 1.0::DOUBLE AS score, 1 AS stage FROM q WHERE name = 'blue bolts' OR lower(name) = 'blue bolts'),
p AS (SELECT id, name, round(10.0::DOUBLE / length(name), 6), 2 FROM q WHERE starts_with(lower(name), 'blue bolts') ORDER BY 3 DESC, id LIMIT 10),
f AS (SELECT * FROM (SELECT id, name, round(1 - levenshtein(lower(name), 'blue bolts')::DOUBLE / greatest(length(name), 10), 6) AS score, 3 AS stage FROM q) WHERE score >= 0.6 ORDER BY score DESC, id LIMIT 10),
a AS (SELECT * FROM x UNION ALL SELECT * FROM p UNION ALL SELECT * FROM f), c AS (SELECT count(*) FILTER (stage = 1) AS n1, count(*) FILTER (stage = 2) AS n2 FROM a)
SELECT id, name, score, stage::INT AS stage FROM a, c WHERE stage = 1 OR (stage = 2 AND n1 < 2) OR (stage = 3 AND n1 < 2 AND n1 + n2 < 2) ORDER BY stage, score DESC, id LIMIT 10""")
def smart_search(spark, sf_dir):
    return search.smart(part_entities(spark, sf_dir).select("id", "name"), "blue bolts")


_COSINE = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"


@query(f"SELECT q.vec_id AS query, e.vec_id AS id, {_COSINE} AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, e.vec_id) <= 10")
def vector_topk_many(spark, sf_dir):
    """The ten nearest by cosine of every twentieth vector, among all others."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.nearest_many(vectors, vectors.where("id % 20 = 0"))


# Searches as a user would type them: names with a letter left out, doubled or cut off at the end, or as they are.
_ASKED = "qs AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name[1:p_partkey % length(p_name)] || p_name[p_partkey % length(p_name) + 2:] WHEN 2 THEN p_name[1:p_partkey % length(p_name) + 1] || p_name[p_partkey % length(p_name) + 1:] WHEN 3 THEN p_name[1:length(p_name) - 3] ELSE upper(p_name) || 'x' END AS query FROM part)"


def _asked(spark, sf_dir):
    name, n = F.col("p_name"), F.length("p_name")
    at = (F.col("p_partkey") % n).cast("int")
    rest = lambda k: F.substring(name, k, n)
    kind = F.col("p_partkey") % 5
    text = F.when(kind == 0, name).when(kind == 1, F.concat(F.substring(name, F.lit(1), at), rest(at + 2))).when(kind == 2, F.concat(F.substring(name, F.lit(1), at + 1), rest(at + 1))).when(kind == 3, F.substring(name, F.lit(1), n - 3)).otherwise(F.concat(F.upper(name), F.lit("x")))
    return read(spark, sf_dir, "part").select(text.alias("query")).distinct()


_FUZZY = f"fz AS (SELECT query, id, name, round(1 - levenshtein(lower(name), lower(query))::DOUBLE / greatest(length(name), length(query)), 6) AS score FROM qs JOIN {ENT} t ON levenshtein(lower(name), lower(query)) <= 2 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10)"
_PREFIX = f"px AS (SELECT query, id, name, round(length(query)::DOUBLE / length(name), 6) AS score FROM qs JOIN {ENT} t ON starts_with(lower(name), lower(query)) AND query <> '' QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 10)"


@query(f"WITH {_ASKED}, {_PREFIX} SELECT query, id, name, score FROM px")
def prefix_search_many(spark, sf_dir):
    return search.prefix_many(part_entities(spark, sf_dir), _asked(spark, sf_dir))


@query(f"WITH {_ASKED}, {_FUZZY} SELECT query, id, name, score FROM fz")
def fuzzy_search_many(spark, sf_dir):
    return search.fuzzy_many(part_entities(spark, sf_dir), _asked(spark, sf_dir))


@query(f"WITH {_ASKED}, {_PREFIX}, {_FUZZY}, a AS (SELECT query, id, name, 1.0::DOUBLE AS score, 1 AS stage FROM qs JOIN {ENT} t ON name = query OR lower(name) = query UNION ALL SELECT *, 2 FROM px UNION ALL SELECT *, 3 FROM fz), c AS (SELECT query, count(*) FILTER (stage = 1) AS n1, count(*) FILTER (stage <= 2) AS n2 FROM a GROUP BY query), b AS (SELECT a.* FROM a JOIN c USING (query) WHERE stage = 1 OR (stage = 2 AND n1 < 2) OR (stage = 3 AND n2 < 2) QUALIFY row_number() OVER (PARTITION BY query, id ORDER BY stage) = 1) SELECT query, id, name, score, stage::INT AS stage FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY stage, score DESC, id) <= 10")
def smart_search_many(spark, sf_dir):
    """Exact, prefix and fuzzy search for a table of queries at once."""
    return search.smart_many(part_entities(spark, sf_dir), _asked(spark, sf_dir))


@query(f"""WITH RECURSIVE {G_PART}, l AS (SELECT 'f' || src AS from_file, 'f' || dst AS file, CASE WHEN (src + dst) % 3 = 0 THEN '*' ELSE 'n' || src % 4 END AS imported, CASE WHEN (src + dst) % 3 = 0 THEN '*' ELSE 'n' || dst % 4 END AS name FROM e),
h(file, name, origin_file, origin_name, hops) AS (SELECT 'f' || node, 'n' || node % 4, 'f' || node, 'n' || node % 4, 0 FROM nd UNION SELECT l.file, CASE WHEN imported = '*' THEN h.name ELSE l.name END, origin_file, origin_name, hops + 1 FROM h JOIN l ON l.from_file = h.file AND (imported = '*' OR imported = h.name) WHERE hops < 60)
SELECT file, name, origin_file, origin_name, min(hops)::INT AS hops FROM h GROUP BY ALL""")
def handed_on_names(spark, sf_dir):
    """Where each part's export can be imported along chains of re-exports, renamed or whole, over the part graph."""
    g = part_graph(spark, sf_dir)
    named = lambda of: (F.concat(F.lit("f"), F.col(of).cast("string")), F.concat(F.lit("n"), (F.col(of) % 4).cast("string")))
    (file, name), (from_file, imported), (own, called) = named("dst"), named("src"), named("node")
    whole = (F.col("src") + F.col("dst")) % 3 == 0
    lines = g.edges.select(file.alias("file"), F.when(whole, "*").otherwise(name).alias("name"), from_file.alias("from_file"), F.when(whole, "*").otherwise(imported).alias("imported"))
    return resolve.handed_on(g.nodes.select(own.alias("file"), called.alias("name")), lines)


@query(f"WITH {G_PART}, x AS (SELECT id, name FROM {ENT} WHERE name = (SELECT min(p_name) FROM part)), n AS (SELECT src AS node, 'imports' AS direction, dst AS neighbour FROM e UNION ALL SELECT dst, 'imported_by', src FROM e) SELECT id, name, direction, neighbour FROM x LEFT JOIN n ON n.node = x.id")
def exact_search_with_context(spark, sf_dir):
    ents = part_entities(spark, sf_dir).select("id", "name")
    hit = ents.join(F.broadcast(ents.agg(F.min("name").alias("name"))), "name", "left_semi")  # one row
    around = part_graph(spark, sf_dir).neighbours(hit.select(F.col("id").alias("node"))).withColumnRenamed("node", "id")
    return hit.join(around, "id", "left").select("id", "name", "direction", "neighbour")


@query(f"WITH RECURSIVE {G_PART}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), {distances('SELECT min(src), 0 FROM e', 'b', 2)} SELECT node AS id, name, module, min(distance)::INT AS distance FROM r JOIN {ENT} t ON t.id = node GROUP BY ALL")
def entity_context(spark, sf_dir):
    """An entity, what it is joined to, and what these are joined to."""
    g = part_graph(spark, sf_dir)
    near = g.undirected().reach(g.edges.agg(F.min("src").alias("node")), 2)
    return near.join(part_entities(spark, sf_dir).withColumnRenamed("id", "node"), "node").select(F.col("node").alias("id"), "name", "module", "distance")


@query(f"WITH {G_PART}, f AS (SELECT dst, count(*) AS n FROM e GROUP BY dst) SELECT p_partkey AS id, (CASE WHEN p_size % 3 = 0 THEN 100 ELSE 0 END + coalesce(n, 0))::BIGINT AS importance FROM part LEFT JOIN f ON dst = p_partkey ORDER BY importance DESC, id LIMIT 50")
def important_functions(spark, sf_dir):
    often = part_edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    ents = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3 == 0).alias("exported"))
    score = F.when(F.col("exported"), 100).otherwise(0) + F.coalesce("n", F.lit(0))
    return ents.join(often, "id", "left").select("id", score.cast("long").alias("importance")).orderBy(F.desc("importance"), "id").limit(50)


_WORDS = "w AS (SELECT doc_id AS id, unnest(list_filter(string_split(regexp_replace(lower(text), '[^a-zа-яё0-9_]+', ' ', 'g'), ' '), lambda t: length(t) > 1)) AS word FROM documents), df AS (SELECT word, count(DISTINCT id) AS df FROM w GROUP BY word), vo AS (SELECT word, (row_number() OVER (ORDER BY df, word) - 1)::INT AS place, ln((SELECT count(*) FROM documents) / (1 + df)::DOUBLE) AS idf FROM df ORDER BY df, word LIMIT 128)"


@query(f"WITH {_WORDS} SELECT word, df FROM df")
def document_frequency(spark, sf_dir):
    return vectors.document_frequency(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_WORDS} SELECT word, place, round(idf, 6) AS idf FROM vo")
def tfidf_vocabulary(spark, sf_dir):
    return vectors.fit(read(spark, sf_dir, "documents"), "doc_id", "text").select("word", "place", F.round("idf", 6).alias("idf"))


@query(f"WITH {_WORDS}, x AS (SELECT id, place, sum(idf) AS w FROM w JOIN vo USING (word) GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM x GROUP BY id) SELECT id, place, round(w / norm, 6) AS weight FROM x JOIN n USING (id) WHERE norm > 0")
def tfidf_embeddings(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return vectors.embed(docs, vectors.fit(docs, "doc_id", "text"), "doc_id", "text").select("id", "place", F.round("weight", 6).alias("weight"))


def _brand_functions(spark, sf_dir):
    functions = part_entities(spark, sf_dir).select("module", F.col("id").cast("string").alias("name"), (F.col("id") % 3 == 0).alias("exported"))
    home = part_entities(spark, sf_dir).select("id", "module")
    calls = part_edges(spark, sf_dir).join(home.select(F.col("id").alias("src"), "module"), "src").join(home.select(F.col("id").alias("dst"), F.col("module").alias("m")), "dst").where("module = m")
    return functions, calls.select("module", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))


_CLUSTERS = f"""{G_PART}, f AS (SELECT p_brand AS module, p_partkey::VARCHAR AS name, p_partkey % 3 = 0 AS exported FROM part),
c AS (SELECT a.module, a.name AS src, b.name AS dst FROM e JOIN f a ON a.name = e.src::VARCHAR JOIN f b ON b.name = e.dst::VARCHAR WHERE a.module = b.module),
k AS (SELECT module, dst AS name, count(*) AS called FROM c GROUP BY ALL),
i AS (SELECT f.*, coalesce(called, 0) AS called, exported::INT * 100 + coalesce(called, 0) AS importance FROM f LEFT JOIN k USING (module, name)),
st AS ({{starts}}),
r(module, seed, name, d) AS (SELECT module, name, name, 0 FROM st UNION SELECT r.module, r.seed, c.dst, r.d + 1 FROM r JOIN c ON c.module = r.module AND c.src = r.name WHERE r.d < 60),
o AS (SELECT r.module, seed, r.name, d FROM r JOIN st ON st.module = r.module AND st.name = r.seed QUALIFY row_number() OVER (PARTITION BY r.module, r.name ORDER BY rank, d) = 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY module, seed ORDER BY d, name) - 1 AS nth FROM o),
g AS (SELECT module, first_value(name) OVER (PARTITION BY module, seed, nth // 10 ORDER BY nth) AS cluster, seed, (nth % 10)::INT AS place, name FROM pl)"""
_BY_IMPORTANCE = _CLUSTERS.format(starts="SELECT module, name, row_number() OVER (ORDER BY importance DESC, name) AS rank FROM i")
_BY_ENTRIES = _CLUSTERS.format(starts="SELECT module, name, row_number() OVER (ORDER BY exported DESC, name) AS rank FROM i WHERE called = 0")
_DESCRIBED = """s AS (SELECT module, cluster, count(*) AS size, bool_or(exported) AS exported FROM g JOIN f USING (module, name) GROUP BY ALL),
ie AS (SELECT x.module, x.cluster, count(*) AS total, count(*) FILTER (x.cluster = y.cluster) AS inside FROM (SELECT DISTINCT * FROM c WHERE src <> dst) t JOIN g x ON x.module = t.module AND x.name = t.src LEFT JOIN g y ON y.module = t.module AND y.name = t.dst GROUP BY ALL),
dc AS (SELECT s.module, s.cluster, s.size, exported, CASE WHEN size <= 1 THEN 0.0 ELSE round(coalesce(inside, 0)::DOUBLE / (size * (size - 1)) * 100, 4) END::DOUBLE AS density, CASE WHEN size <= 1 THEN 100 WHEN coalesce(total, 0) = 0 THEN 0 ELSE round(inside::DOUBLE / total * 100, 0) END::DOUBLE AS share FROM s LEFT JOIN ie USING (module, cluster))"""


@query(f"WITH RECURSIVE {_BY_IMPORTANCE} SELECT module, cluster, seed, place, name FROM g")
def greedy_clusters(spark, sf_dir):
    return clusters.by_importance(*_brand_functions(spark, sf_dir))


@query(f"WITH RECURSIVE {_BY_ENTRIES} SELECT module, cluster, seed, place, name FROM g")
def clusters_of_entries(spark, sf_dir):
    return clusters.by_entry_points(*_brand_functions(spark, sf_dir))


@query(f"WITH RECURSIVE {_BY_ENTRIES}, {_DESCRIBED} SELECT module || '#' || cluster AS cluster, size, CASE WHEN exported THEN 'core' ELSE 'helper' END AS kind, density, share FROM dc")
def entry_clusters(spark, sf_dir):
    functions, calls = _brand_functions(spark, sf_dir)
    return clusters.described(clusters.by_entry_points(functions, calls), functions, calls).select("cluster", "size", "kind", "density", "share")


@query(f"WITH RECURSIVE {_BY_IMPORTANCE}, {_DESCRIBED}, b AS (SELECT * FROM dc ORDER BY density DESC, size DESC, module || '#' || cluster LIMIT 5) SELECT b.module || '#' || b.cluster AS cluster, string_agg(g.name, ', ' ORDER BY place) FILTER (place < 3) AS functions FROM b JOIN g USING (module, cluster) GROUP BY ALL")
def suggested_layout(spark, sf_dir):
    functions, calls = _brand_functions(spark, sf_dir)
    found = clusters.by_importance(functions, calls)
    return clusters.layout(clusters.described(found, functions, calls), found).select("cluster", "functions")
