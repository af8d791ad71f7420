"""Registered queries over the driver's tables, and SQL that says independently what each returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.functions import text
from strandgraph.operators import flow, graph, search

# Views: the part graph joins parts that follow each other in an order; the event graph the types of a user's events.
LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
G_PART = f"""p AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE)}) AS dst FROM lineitem WHERE l_quantity >= 45),
e AS (SELECT DISTINCT src, dst FROM p WHERE dst IS NOT NULL), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""
G_EVENT = """p AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT DISTINCT src, dst FROM p WHERE dst IS NOT NULL), nd AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"""
CLOSURE = "r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    lines = lines.where(F.col("l_returnflag") == flag) if flag else lines
    follows = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    return lines.select(F.col("l_partkey").alias("src"), follows.alias("dst")).where("dst IS NOT NULL").distinct()


def part_graph(spark: SparkSession, sf_dir: str) -> graph.CodeGraph:
    return graph.CodeGraph(part_edges(spark, sf_dir))


def event_graph(spark: SparkSession, sf_dir: str) -> graph.CodeGraph:
    follows = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return graph.CodeGraph(read(spark, sf_dir, "events").select(F.col("event_type").alias("src"), follows.alias("dst")))


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("module"), F.col("p_type").alias("type"))


QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Checks on a small project of texts, with the rows that must come out. They read no table, so they aren't registered.
FIXTURES: dict = {}
FIXTURE_ORACLES: dict[str, str] = {}


def query(sql: str | None, queries: dict = QUERIES, oracles: dict[str, str] = ORACLES):
    def add(f):
        queries[f.__name__] = f
        if sql:
            oracles[f.__name__] = sql
        return f

    return add


def fixture(sql: str | None):
    return query(sql, FIXTURES, FIXTURE_ORACLES)


def distances(start: str, edges: str = "e", far: int = 80) -> str:
    return f"r(node, distance) AS ({start} UNION SELECT {edges}.dst, r.distance + 1 FROM r JOIN {edges} ON r.node = {edges}.src WHERE r.distance < {far})"


ENTRY = "SELECT node, 0 FROM nd WHERE node NOT IN (SELECT dst FROM e)"


@query(f"WITH {G_PART} SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT 2.0 * count(*) FROM e) / (SELECT count(*) FROM nd), 6)::DOUBLE AS avg_degree")
def graph_stats(spark, sf_dir):
    return part_graph(spark, sf_dir).stats()


@query(f"WITH {G_PART} SELECT node, (SELECT count(*) FROM e WHERE src = node) AS out_degree, (SELECT count(*) FROM e WHERE dst = node) AS in_degree FROM nd")
def degrees(spark, sf_dir):
    return part_graph(spark, sf_dir).degrees()


@query(f"WITH {G_PART} SELECT node FROM nd WHERE node NOT IN (SELECT dst FROM e)")
def entry_points(spark, sf_dir):
    return part_graph(spark, sf_dir).entry_points()


@query(f"WITH {G_EVENT} SELECT a.src AS a, a.dst AS b FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst")
def mutual_calls(spark, sf_dir):
    return event_graph(spark, sf_dir).mutual()


@query(f"WITH {G_EVENT}, i AS (SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS imports FROM e GROUP BY src), o AS (SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS imported_by FROM e GROUP BY dst) SELECT node, coalesce(imports, '') AS imports, coalesce(imported_by, '') AS imported_by FROM i FULL JOIN o USING (node)")
def adjacency_lists(spark, sf_dir):
    return event_graph(spark, sf_dir).adjacency()


@query(f"WITH RECURSIVE {G_PART}, {distances(ENTRY)} SELECT node, min(distance)::INT AS distance FROM r GROUP BY node")
def impact_with_distance(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return g.reach(g.entry_points())


@query(f"WITH RECURSIVE {G_PART}, b AS (SELECT dst AS src, src AS dst FROM e), {distances('SELECT max(node), 0 FROM nd', 'b')} SELECT node, min(distance)::INT AS distance FROM r GROUP BY node")
def reach_backward(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return g.reversed().reach(g.nodes.agg(F.max("node").alias("node")))


@query(f"WITH RECURSIVE {G_PART}, {distances('SELECT node, 0 FROM nd WHERE node NOT IN (SELECT src FROM e)', 'b').replace('r(node', 'b AS (SELECT dst AS src, src AS dst FROM e), r(node')} SELECT node, min(distance)::INT AS level FROM r GROUP BY node")
def level_from_leaves(spark, sf_dir):
    return part_graph(spark, sf_dir).levels_from_leaves()


@query(f"WITH RECURSIVE {G_PART}, {distances(ENTRY)} SELECT max(d)::INT AS max_depth FROM (SELECT min(distance) AS d FROM r GROUP BY node)")
def max_depth(spark, sf_dir):
    return part_graph(spark, sf_dir).max_depth()


@query(f"WITH RECURSIVE {G_PART}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), {distances('SELECT min(node), 0 FROM nd', 'b', 3)} SELECT node, min(distance)::INT AS distance, round(1 - min(distance) / 3.0::DOUBLE, 6) AS score FROM r GROUP BY node HAVING min(distance) > 0")
def neighbourhood_khop(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return g.neighbourhood(g.nodes.agg(F.min("node").alias("node")), 3)


@query(f"WITH RECURSIVE {G_PART}, r(here, path) AS (SELECT node, [node] FROM (SELECT min(src) AS node FROM e) UNION ALL SELECT e.dst, list_append(path, e.dst) FROM r JOIN e ON r.here = e.src WHERE len(path) <= 5 AND NOT list_contains(path, e.dst)) SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INT AS length FROM r WHERE len(path) > 1")
def all_simple_paths(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return g.simple_paths(g.edges.agg(F.min("src").alias("node")), None, 5)


@query(f"WITH RECURSIVE {G_PART}, {CLOSURE} SELECT e.src, e.dst FROM e WHERE e.src = e.dst OR EXISTS (SELECT 1 FROM r WHERE r.a = e.dst AND r.b = e.src)")
def cyclic_edges(spark, sf_dir):
    return part_graph(spark, sf_dir).cyclic_edges().select("src", "dst")


@query(f"WITH RECURSIVE {G_PART}, {CLOSURE} SELECT x.a AS node, max(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def scc(spark, sf_dir):
    return part_graph(spark, sf_dir).components()


def _split(flag: str) -> str:
    order = ", ".join(LINE)
    return f"(SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {order}) AS dst FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = '{flag}') WHERE dst IS NOT NULL)"


@query(
    f"""WITH a AS {_split("A")}, b AS {_split("N")}, na AS (SELECT src AS n FROM a UNION SELECT dst FROM a), nb AS (SELECT src AS n FROM b UNION SELECT dst FROM b)
SELECT 'added_edge' AS change, src, dst FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'removed_edge', src, dst FROM (FROM a EXCEPT FROM b)
UNION ALL SELECT 'added_node', n, NULL FROM (FROM nb EXCEPT FROM na) UNION ALL SELECT 'removed_node', n, NULL FROM (FROM na EXCEPT FROM nb)"""
)
def graph_diff(spark, sf_dir):
    return graph.diff(part_edges(spark, sf_dir, "A"), part_edges(spark, sf_dir, "N"))


@query(f"SELECT * FROM {_split('A')} UNION SELECT * FROM {_split('N')}")
def graph_merge(spark, sf_dir):
    return graph.merge(part_edges(spark, sf_dir, "A"), part_edges(spark, sf_dir, "N"))


@query(
    f"""WITH {G_PART}, m AS (SELECT p_partkey AS node, p_brand AS cluster FROM part),
l AS (SELECT a.cluster, count(*) AS total, count(*) FILTER (a.cluster = b.cluster) AS internal FROM e JOIN m a ON e.src = a.node LEFT JOIN m b ON e.dst = b.node WHERE e.src <> e.dst GROUP BY a.cluster),
s AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster)
SELECT s.cluster, size, coalesce(internal, 0) AS internal, coalesce(total, 0) AS total,
CASE WHEN size <= 1 THEN 0.0::DOUBLE ELSE round(coalesce(internal, 0)::DOUBLE / (size * (size - 1)) * 100, 4) END AS density,
CASE WHEN size <= 1 THEN 100.0::DOUBLE WHEN coalesce(total, 0) = 0 THEN 0.0::DOUBLE ELSE round(internal::DOUBLE / total * 100, 0) END AS share FROM s LEFT JOIN l USING (cluster)"""
)
def cohesion(spark, sf_dir):
    members = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("cluster"))
    return graph.cohesion(part_edges(spark, sf_dir), members)


ENT = "(SELECT p_partkey AS id, p_name AS name, p_brand AS module, p_type AS type FROM part)"


@query("SELECT p_brand AS module, p_type AS type, count(*) AS n FROM part GROUP BY ALL")
def count_by_type_and_module(spark, sf_dir):
    return part_entities(spark, sf_dir).groupBy("module", "type").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS module, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, module LIMIT 10")
def top_modules(spark, sf_dir):
    return part_entities(spark, sf_dir).groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(10)


@query(f"SELECT id, name, 1.0::DOUBLE AS score FROM {ENT} WHERE name = (SELECT min(p_name) FROM part)")
def exact_search(spark, sf_dir):
    ents = part_entities(spark, sf_dir)
    least = ents.agg(F.min("name").alias("name"))
    return ents.join(F.broadcast(least), "name", "left_semi").select("id", "name", F.lit(1.0).alias("score"))  # one row


@query(f"SELECT id, name, round(2.0::DOUBLE / length(name), 6) AS score FROM {ENT} WHERE starts_with(lower(name), 'bl') ORDER BY score DESC, id LIMIT 10")
def prefix_search(spark, sf_dir):
    return search.prefix(part_entities(spark, sf_dir).select("id", "name"), "bl")


@query(f"SELECT id, name, score FROM (SELECT id, name, round(1 - levenshtein(lower(name), 'blue steel')::DOUBLE / greatest(length(name), 10), 6) AS score FROM {ENT}) WHERE score >= 0.4 ORDER BY score DESC, id LIMIT 10")
def fuzzy_search(spark, sf_dir):
    return search.fuzzy(part_entities(spark, sf_dir).select("id", "name"), "blue steel", 0.4)


@query("SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) >= 0.2 ORDER BY score DESC, id LIMIT 10")
def vector_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id = 0").select(F.col("embedding").alias("q"))
    score = F.round(search.cosine(F.col("embedding"), F.col("q")), 6)
    found = vectors.join(F.broadcast(asked), how="cross").select(F.col("vec_id").alias("id"), score.alias("score"))  # one row, the query
    return found.where("score >= 0.2").orderBy(F.desc("score"), "id").limit(10)


@query("SELECT user_id AS scope, event_type AS name, f AS def_pos, event_id AS use_pos FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events) WHERE f < event_id")
def def_use_edges(spark, sf_dir):
    """A user's first event of a type with each later one."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("name"), F.col("event_id").alias("pos"))
    return flow.first_definitions(events, events)


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def dead_exports(spark, sf_dir):
    used = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(used, "c_custkey", "left_anti").distinct()


@query(r"SELECT doc_id, contains(text, 'eval(') AS has_eval, regexp_matches(lower(text), 'password|secret|api_key|token') AS has_secret_word, regexp_matches(text, '[A-Za-z0-9_-]{32,}') AS has_long_token FROM documents")
def security_flags(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", t.contains("eval(").alias("has_eval"), F.lower(t).rlike("password|secret|api_key|token").alias("has_secret_word"), t.rlike("[A-Za-z0-9_-]{32,}").alias("has_long_token"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z]')) AS tags, len(regexp_extract_all(html, 'href=')) AS links FROM pages")
def markup_facets(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<[a-zA-Z]")).cast("long").alias("tags"), F.regexp_count("html", F.lit("href=")).cast("long").alias("links"))


@query(f"WITH {G_PART} SELECT dst AS node, count(*) AS calls FROM e GROUP BY dst")
def callee_frequency(spark, sf_dir):
    return part_edges(spark, sf_dir).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("calls"))


@query(f"WITH RECURSIVE {G_PART}, {distances('SELECT min(src), 0 FROM e')} SELECT node, min(distance)::INT AS distance FROM r GROUP BY node")
def reach_forward(spark, sf_dir):
    g = part_graph(spark, sf_dir)
    return g.reach(g.edges.agg(F.min("src").alias("node")))


@query(
    r"""WITH p AS (SELECT a.conv_id, a.turn, string_split(a.text, chr(10)) AS x, string_split(b.text, chr(10)) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
q AS (SELECT conv_id, turn, x, y, unnest(range(1, greatest(len(x), len(y)) + 1)) AS i FROM p)
SELECT conv_id, turn, i::INT AS line, x[i] AS old_line, y[i] AS new_line FROM q WHERE x[i] IS DISTINCT FROM y[i]"""
)
def line_diff(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.split("text", "\n", -1).alias("x"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("x").alias("y"))
    lines = turns.join(later, ["conv_id", "turn"]).select("conv_id", "turn", F.posexplode(F.arrays_zip("x", "y")).alias("at", "pair"))
    lines = lines.where(~F.col("pair.x").eqNullSafe(F.col("pair.y")))
    return lines.select("conv_id", "turn", (F.col("at") + 1).alias("line"), F.col("pair.x").alias("old_line"), F.col("pair.y").alias("new_line"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(lower(text), '[^a-zа-яё0-9_]', ' ', 'g'), ' '), lambda t: length(t) > 1))::INT AS n_tokens FROM documents")
def tokenise(spark, sf_dir):
    words = F.split(F.regexp_replace(F.lower("text"), "[^a-zа-яё0-9_]", " "), " ")
    n_tokens = F.when(F.col("text").isNotNull(), F.size(F.filter(words, lambda t: F.length(t) > 1)))
    return read(spark, sf_dir, "documents").select("doc_id", n_tokens.alias("n_tokens"))


@query(r"SELECT p_partkey, length(p_name) > 40 AS too_long, regexp_matches(p_name, '^[A-Z_]+$') AS all_caps, regexp_matches(lower(p_name), '^(data|temp|item|value|result)$') AS generic FROM part")
def naming_rules(spark, sf_dir):
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", (F.length(name) > 40).alias("too_long"), name.rlike("^[A-Z_]+$").alias("all_caps"), F.lower(name).rlike("^(data|temp|item|value|result)$").alias("generic"))


#: Rule, severity, pattern. Fixed values.
SECURITY_RULES = (("eval", 9, r"eval\("), ("exec", 7, r"exec\("), ("secret", 8, r"(password|secret|api_key|token)"))


@query("SELECT * FROM (" + " UNION ALL ".join(rf"SELECT '{rule}' AS rule, {severity} AS severity, count(*) FILTER (regexp_matches(lower(text), '{pattern}')) AS n FROM documents" for rule, severity, pattern in SECURITY_RULES) + ") WHERE n > 0")
def issue_summary(spark, sf_dir):
    text = F.lower("text")
    issues = F.array(*(F.when(text.rlike(pattern), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, severity, pattern in SECURITY_RULES))
    found = read(spark, sf_dir, "documents").select(F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("i"))
    return found.groupBy(F.col("i.rule").alias("rule"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, " + ", ".join(rf"len(regexp_extract_all(html, '\{a}')) = len(regexp_extract_all(html, '\{b}')) AS {name}" for name, a, b in (("braces", "{", "}"), ("parentheses", "(", ")"), ("brackets", "[", "]"))) + " FROM pages")
def bracket_balance(spark, sf_dir):
    same = lambda a, b: F.regexp_count("html", F.lit("\\" + a)) == F.regexp_count("html", F.lit("\\" + b))
    return read(spark, sf_dir, "pages").select("page_id", same("{", "}").alias("braces"), same("(", ")").alias("parentheses"), same("[", "]").alias("brackets"))


@query(r"SELECT page_id, regexp_extract(url, '([^/?#]*)[^/]*$', 1) AS base_name, len(string_split(url, '/'))::INT AS n_parts FROM pages")
def path_display(spark, sf_dir):
    parts = F.when(F.col("url").isNotNull(), F.size(F.split("url", "/", -1)))
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/?#]*)[^/]*$", 1).alias("base_name"), parts.alias("n_parts"))


@query(r"WITH m AS (SELECT length(text) AS c, length(trim(regexp_replace(regexp_replace(regexp_replace(text, '/\*[\s\S]*?\*/', '', 'g'), '//[^\n]*', '', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS k FROM documents) SELECT count(*) AS n, sum(c)::BIGINT AS chars, sum(k)::BIGINT AS kept, round(1 - sum(k)::DOUBLE / sum(c), 6) AS saved FROM m")
def compression_stats(spark, sf_dir):
    """What is saved by taking comments and needless blanks out of whole texts."""
    docs = read(spark, sf_dir, "documents").select(F.length("text").alias("c"), F.length(text.shortened(F.col("text"))).alias("k"))
    return docs.agg(F.count("*").alias("n"), F.sum("c").alias("chars"), F.sum("k").alias("kept"), F.round(1 - F.sum("k") / F.sum("c"), 6).alias("saved"))
