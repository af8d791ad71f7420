"""Queries that compare two versions of function signatures, made of the part table, and verdicts on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandgraph.functions import text
from strandgraph.operators import signatures

from .catalogue import query, read

# Version 1 has a function a part; version 2 renames every 11th, drops every 13th, and changes types, returns and flags.
_V1 = "SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || p_partkey AS name, string_split(p_name, ' ') AS params, [p_type, 'x' || p_partkey] AS param_types, p_brand AS return_type, p_size % 2 = 0 AS is_async, p_size % 3 = 0 AS is_exported, CASE WHEN p_size % 5 = 0 THEN ['T'] ELSE []::VARCHAR[] END AS type_params, false AS is_generator, p_size % 7 = 0 AS has_rest FROM part"
_V2 = """SELECT id, CASE WHEN id % 11 = 0 THEN name || '_v2' ELSE name END AS name, params, CASE WHEN id % 17 = 0 THEN ['any', param_types[2]] ELSE param_types END AS param_types, CASE WHEN id % 7 = 0 THEN 'void' ELSE return_type END AS return_type,
CASE WHEN id % 19 = 0 THEN NOT is_async ELSE is_async END AS is_async, CASE WHEN id % 23 = 0 THEN NOT is_exported ELSE is_exported END AS is_exported, type_params, id % 29 = 0 AS is_generator, has_rest FROM v1 WHERE id % 13 <> 0
UNION ALL SELECT -id, 'extra_' || id, ['q'], ['y' || id], 'void', false, true, []::VARCHAR[], false, false FROM v1 WHERE id % 31 = 0"""
SQL = f"v1 AS ({_V1}), v2 AS ({_V2})"
_CHANGED = """a.params IS DISTINCT FROM b.params OR a.param_types IS DISTINCT FROM b.param_types AS params_changed, a.type_params IS DISTINCT FROM b.type_params AS type_params_changed, a.return_type <> b.return_type AS return_changed,
a.is_async <> b.is_async AS async_changed, a.is_exported <> b.is_exported AS exported_changed, a.is_generator <> b.is_generator AS generator_changed, a.has_rest <> b.has_rest AS rest_changed"""
_IMPACT = "CASE WHEN return_changed OR async_changed OR rest_changed THEN 'high' WHEN params_changed OR type_params_changed OR exported_changed OR generator_changed THEN 'medium' END"
_RENAMES = """o AS (SELECT name, param_types::VARCHAR || return_type AS shape, row_number() OVER (PARTITION BY param_types::VARCHAR || return_type ORDER BY name) AS n FROM v1 WHERE name NOT IN (SELECT name FROM v2)),
w AS (SELECT name, param_types::VARCHAR || return_type AS shape, row_number() OVER (PARTITION BY param_types::VARCHAR || return_type ORDER BY name) AS n FROM v2 WHERE name NOT IN (SELECT name FROM v1)),
rn AS (SELECT o.name AS old_name, w.name AS new_name FROM o JOIN w USING (shape, n))"""
_DIFF = f"""k AS (SELECT v1.*, coalesce(new_name, name) AS key, new_name IS NOT NULL AS renamed FROM v1 LEFT JOIN rn ON old_name = name),
c AS (SELECT a.name, b.name AS new_name, a.renamed, {_CHANGED} FROM k a FULL JOIN v2 b ON a.key = b.name),
df AS (SELECT name, new_name, CASE WHEN new_name IS NULL THEN 'missing' WHEN name IS NULL THEN 'added' WHEN renamed THEN 'renamed' WHEN {_IMPACT} IS NOT NULL THEN 'changed' ELSE 'unchanged' END AS status, CASE WHEN name IS NOT NULL AND new_name IS NOT NULL THEN {_IMPACT} END AS impact FROM c)"""


def versions(spark, sf_dir):
    p, id_, size = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), id_.cast("string"))
    none = F.array().cast("array<string>")
    v1 = p.select(id_.alias("id"), name.alias("name"), F.split("p_name", " ").alias("params"), F.array("p_type", F.concat(F.lit("x"), id_.cast("string"))).alias("param_types"), F.col("p_brand").alias("return_type"),
        (size % 2 == 0).alias("is_async"), (size % 3 == 0).alias("is_exported"), F.when(size % 5 == 0, F.array(F.lit("T"))).otherwise(none).alias("type_params"), F.lit(False).alias("is_generator"), (size % 7 == 0).alias("has_rest"))
    i = F.col("id")
    flip = lambda c, n: F.when(i % n == 0, ~F.col(c)).otherwise(F.col(c))
    v2 = v1.where(i % 13 != 0).withColumns({"name": F.when(i % 11 == 0, F.concat("name", F.lit("_v2"))).otherwise(F.col("name")), "param_types": F.when(i % 17 == 0, F.array(F.lit("any"), F.element_at("param_types", 2))).otherwise(F.col("param_types")),
        "return_type": F.when(i % 7 == 0, "void").otherwise(F.col("return_type")), "is_async": flip("is_async", 19), "is_exported": flip("is_exported", 23), "is_generator": i % 29 == 0})
    extra = v1.where(i % 31 == 0).select(-i, F.concat(F.lit("extra_"), i.cast("string")), F.array(F.lit("q")), F.array(F.concat(F.lit("y"), i.cast("string"))), F.lit("void"), F.lit(False), F.lit(True), none, F.lit(False), F.lit(False))
    return v1, v2.union(extra)


@query(f"WITH {SQL}, {_RENAMES} SELECT * FROM rn")
def rename_detection(spark, sf_dir):
    return signatures.renames(*versions(spark, sf_dir))


@query(f"WITH {SQL}, {_RENAMES}, {_DIFF} SELECT * FROM df")
def signature_diff(spark, sf_dir):
    return signatures.diff(*versions(spark, sf_dir))


@query(f"WITH {SQL}, x AS (SELECT a.name, {_CHANGED} FROM v1 a JOIN v2 b USING (name)) SELECT *, {_IMPACT} AS impact FROM x WHERE {_IMPACT} IS NOT NULL")
def signature_changes(spark, sf_dir):
    return signatures.changes(*versions(spark, sf_dir))


@query(f"WITH {SQL} SELECT a.name, len(a.params) = len(b.params) AND a.return_type = b.return_type AND a.is_async = b.is_async AND len([i FOR i IN range(1, len(a.param_types) + 1) IF a.param_types[i] <> b.param_types[i] AND a.param_types[i] <> 'any' AND b.param_types[i] <> 'any']) = 0 AS compatible FROM v1 a JOIN v2 b USING (name)")
def compatible_signatures(spark, sf_dir):
    v1, v2 = versions(spark, sf_dir)
    return v1.alias("a").join(v2.alias("b"), F.col("a.name") == F.col("b.name")).select("a.name", signatures.compatible("a", "b").alias("compatible"))


@query(f"WITH {SQL} SELECT min(name) AS name FROM v1 WHERE len(params) = 2 AND return_type = 'Brand#7' AND is_async")
def function_by_signature(spark, sf_dir):
    return signatures.first_by_shape(versions(spark, sf_dir)[0], 2, "Brand#7", True)


@query(f"WITH {SQL} SELECT coalesce(a.name, b.name) AS name, a.name IS NOT NULL AS in_old, b.name IS NOT NULL AS in_new FROM v1 a FULL JOIN v2 b USING (name)")
def function_matches(spark, sf_dir):
    v1, v2 = versions(spark, sf_dir)
    both = v1.select("name", F.lit(True).alias("in_old")).join(v2.select("name", F.lit(True).alias("in_new")), "name", "full_outer")
    return both.select("name", F.coalesce("in_old", F.lit(False)).alias("in_old"), F.coalesce("in_new", F.lit(False)).alias("in_new"))


@query(f"WITH {SQL} SELECT id, CASE WHEN is_exported THEN 'export ' ELSE '' END || CASE WHEN is_async THEN 'async ' ELSE '' END || 'function' || CASE WHEN is_generator THEN '*' ELSE '' END || ' ' || name || CASE WHEN len(type_params) > 0 THEN '<T>' ELSE '' END || '(' || array_to_string([params[i] || ': ' || coalesce(param_types[i], 'any') FOR i IN range(1, len(params) + 1)], ', ') || '): ' || return_type AS declared FROM v2")
def signature_texts(spark, sf_dir):
    v2 = versions(spark, sf_dir)[1]
    s = F.struct("*", F.lit(None).cast("string").alias("class_name"))
    return v2.select("id", s.alias("s")).select("id", text.signature_text(F.col("s")).alias("declared"))


_SUMMARY = "SELECT count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'renamed') AS renamed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (impact = 'high') AS high_impact, count(*) FILTER (status = 'missing') = 0 AND count(*) FILTER (impact = 'high') = 0 AS equivalent FROM df"


@query(f"WITH {SQL}, {_RENAMES}, {_DIFF} {_SUMMARY}")
def refactoring_verdict(spark, sf_dir):
    """Counts of a comparison and whether nothing is missing and nothing changed with high impact."""
    n = lambda c: F.count_if(F.col("status") == c)
    high = F.count_if(F.coalesce(F.col("impact") == "high", F.lit(False)))
    return signature_diff(spark, sf_dir).agg(*(n(s).alias(s) for s in ("changed", "missing", "added", "renamed", "unchanged")), high.alias("high_impact"), ((n("missing") == 0) & (high == 0)).alias("equivalent"))


@query("SELECT l_orderkey, l_linenumber, min(CASE WHEN a < b AND a < c THEN a WHEN b < c THEN b ELSE c END) AS confidence, bool_and(c > 0.5) AS equivalent FROM (SELECT l_orderkey, l_linenumber, 1 - l_discount AS a, 1 - l_tax AS b, 1 - l_discount * 4 AS c FROM lineitem) GROUP BY ALL")
def file_equivalence(spark, sf_dir):
    """The least confidence of the stages of a check, and whether all stages agree."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (1 - F.col("l_discount")).alias("a"), (1 - F.col("l_tax")).alias("b"), (1 - F.col("l_discount") * 4).alias("c"))
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.least("a", "b", "c")).alias("confidence"), F.bool_and(F.col("c") > 0.5).alias("equivalent"))


@query(f"WITH {SQL}, x AS (SELECT id % 500 AS key, list_sort(list(DISTINCT return_type || is_async)) AS rows FROM v1 GROUP BY key), y AS (SELECT id % 500 AS key, list_sort(list(DISTINCT return_type || is_async)) AS rows FROM v2 WHERE id >= 0 GROUP BY key) SELECT key, coalesce(x.rows = y.rows, false) AS same FROM x FULL JOIN y USING (key)")
def contract_equality(spark, sf_dir):
    v1, v2 = versions(spark, sf_dir)
    rows = lambda v: v.where("id >= 0").select((F.col("id") % 500).alias("key"), "return_type", "is_async")
    return signatures.contracts_equal(rows(v1), rows(v2), "key")


@query("SELECT a.l_orderkey, array_to_string(list_sort(list_intersect(a.p, b.p)), ',') AS both_parts, list_sort(a.p) = list_sort(b.p) AS same FROM (SELECT l_orderkey, list(DISTINCT l_partkey % 20) AS p FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) a JOIN (SELECT l_orderkey, list(DISTINCT l_partkey % 20) AS p FROM lineitem WHERE l_linenumber > 3 GROUP BY 1) b USING (l_orderkey)")
def set_intersections(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 20).alias("p"))
    sets = lines.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("p"))).alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 3, F.col("p"))).alias("b")).where("size(a) > 0 AND size(b) > 0")
    return sets.select("l_orderkey", F.array_join(F.transform(F.array_sort(F.array_intersect("a", "b")), lambda x: x.cast("string")), ",").alias("both_parts"), (F.array_sort("a") == F.array_sort("b")).alias("same"))


@query("SELECT DISTINCT l_returnflag AS type, l_linestatus AS original, l_linenumber AS modified FROM lineitem")
def unique_differences(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("original"), F.col("l_linenumber").alias("modified")).dropDuplicates()
