"""JSON documents in: indexes, signatures, call graphs and nested reports become tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = "struct<id: string, name: string, type: string, module: string, line: int, metadata: map<string, string>, embedding: array<double>>"
EDGE = "struct<`from`: string, `to`: string, type: string, weight: double>"
INDEX = f"version string, entities array<{ENTITY}>, edges array<{EDGE}>"
SIGNATURE = "struct<name: string, params: array<string>, paramTypes: array<string>, returnType: string, isAsync: boolean, isExported: boolean, typeParameters: array<string>, isGenerator: boolean, hasRestParam: boolean, className: string>"
CALL_GRAPH = f"nodes array<string>, edges array<{EDGE}>, entryPoints array<string>"
REPORT_KINDS = ("functions", "classes", "constants", "interfaces", "types", "variables")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: whole documents."""
    return spark.read.format("text").option("wholetext", "true").load(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of index documents (text); a document that can't be read gives no rows."""
    d = docs.select(F.from_json("text", INDEX).alias("d"))
    entities = d.select(F.explode("d.entities").alias("e")).select("e.*")
    edges = d.select(F.explode("d.edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.type", F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    return entities, edges


def signatures(docs: DataFrame) -> DataFrame:
    """Signatures of documents that map names to them."""
    rows = docs.select(F.explode(F.from_json("text", f"map<string, {SIGNATURE}>")).alias("key", "s"))
    no = F.lit(False)
    return rows.select(F.coalesce("s.name", "key").alias("name"), "s.params", F.col("s.paramTypes").alias("param_types"), F.col("s.returnType").alias("return_type"), F.coalesce("s.isAsync", no).alias("is_async"), F.coalesce("s.isExported", no).alias("is_exported"), F.col("s.typeParameters").alias("type_params"), F.coalesce("s.isGenerator", no).alias("is_generator"), F.coalesce("s.hasRestParam", no).alias("has_rest"), F.col("s.className").alias("class_name"))


def call_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of call-graph documents; nodes tell whether they are entries."""
    d = docs.select(F.from_json("text", CALL_GRAPH).alias("d"))
    entries = F.coalesce("d.entryPoints", F.array().cast("array<string>"))
    nodes = d.select(F.explode("d.nodes").alias("node"), entries.alias("entries")).select("node", F.array_contains("entries", F.col("node")).alias("is_entry"))
    return nodes, d.select(F.explode("d.edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.type")


def report(docs: DataFrame) -> DataFrame:
    """``module, kind, name, line, is_exported, attrs``: the entities of nested reports, packages -> entities -> kinds."""
    packages = docs.select(F.explode(F.from_json("text", "struct<packages: map<string, struct<entities: map<string, array<map<string, string>>>>>>")["packages"]).alias("module", "p"))
    kinds = packages.select("module", F.explode("p.entities").alias("kind", "rows")).where(F.col("kind").isin(*REPORT_KINDS))
    e = kinds.select("module", "kind", F.explode("rows").alias("attrs"))
    get = lambda k: F.try_element_at("attrs", F.lit(k))
    return e.select("module", "kind", get("name").alias("name"), get("line").cast("int").alias("line"), F.coalesce(get("isExported") == "true", F.lit(False)).alias("is_exported"), "attrs")
