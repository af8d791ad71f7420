"""A project as one object: its files are scanned and read once, everything else is a DataFrame away.

    project = Project.open(spark, "/path/to/project")
    project.graph().cyclic_edges().show()
    project.search("fetch").show()
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.functions import rules
from strandgraph.operators import clusters, flow, formal, minify, report, resolve, search, vectors
from strandgraph.operators.graph import CodeGraph, dominators
from strandgraph.operators.lineage import cut
from strandgraph.sources import code, files, json_io
from strandgraph.sources.statements import statements


class Project:
    """Files (path, ext, size, lines, content) and what follows from them."""

    def __init__(self, files_: DataFrame, aliases: list[tuple[str, str]] | None = None, root: str = "") -> None:
        self.files, self.aliases, self.root = files_, aliases, root

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **how) -> Project:
        return cls(files.scan(spark, folder, **how))

    @cached_property
    def nodes(self) -> DataFrame:
        """Syntax of all files, read once and written."""
        return cut(code.parse(self.files))

    @cached_property
    def entities(self) -> DataFrame:
        return cut(code.entities(self.nodes))

    @cached_property
    def resolved(self) -> DataFrame:
        return cut(resolve.resolve_imports(code.imports(self.nodes), self.files, self.aliases, self.root))

    # --- graphs ---

    def graph(self) -> CodeGraph:
        """Files and what they import."""
        return CodeGraph(code.project_edges(self.files, self.nodes, self.aliases, self.root))

    def call_graph(self) -> CodeGraph:
        return CodeGraph(code.call_graph(self.nodes), code.functions(self.nodes).select(F.col("id").alias("node")))

    def control_flow(self) -> DataFrame:
        return flow.cfg(statements(self.files))

    def dominators(self) -> DataFrame:
        rows = statements(self.files)
        g, entry = flow.cfg_graph(rows)
        return dominators(g.written(), entry, flow.scopes(rows))

    def data_flow(self) -> DataFrame:
        """``scope, name, def_pos, use_pos``: declarations of a scope with their uses in it."""
        owner = self.nodes.where(F.col("kind").isin(*code.FUNCTIONS)).select("file", F.col("node_id").alias("parent_id"), F.col("name").alias("fn"))
        uses = code.identifiers(self.nodes).join(owner, ["file", "parent_id"], "left").select(F.concat_ws("#", "file", "fn").alias("scope"), "name", "pos")
        return flow.def_use(code.variables(self.nodes), uses)

    # --- index ---

    def search(self, query: str, limit: int = 10) -> DataFrame:
        return search.smart(self.entities.select("id", "name"), query, limit)

    def search_prefix(self, query: str, limit: int = 10) -> DataFrame:
        return search.prefix(self.entities.select("id", "name"), query, limit)

    def search_fuzzy(self, query: str, threshold: float = 0.7, limit: int = 10) -> DataFrame:
        return search.fuzzy(self.entities.select("id", "name"), query, threshold, limit)

    def entity(self, id_: str) -> DataFrame:
        return self.entities.where(F.col("id") == id_)

    def context(self, id_: str, depth: int = 2) -> DataFrame:
        """What is called by and calls an entity, ``depth`` edges around, with the way there."""
        start = self.files.sparkSession.createDataFrame([(id_,)], "node string")
        return self.call_graph().neighbourhood(start, depth, 50, with_path=True)

    def embedded(self, provider: Callable[[list[str]], list[list[float]]]) -> DataFrame:
        """Entities with vectors of their texts."""
        text = self.entities.withColumn("text", F.concat_ws(" ", "name", "type", "file"))
        return vectors.embed_with(text, provider)

    # --- findings ---

    def unresolved(self) -> DataFrame:
        return resolve.unresolved_imports(self.resolved)

    def dead_exports(self) -> DataFrame:
        return resolve.dead_exports(code.exports(self.nodes), code.imports(self.nodes), self.resolved)

    def unused(self) -> DataFrame:
        return code.unused_names(self.files, self.nodes)

    def impact(self, file: str, entity: str) -> DataFrame:
        spans = self.nodes.where(F.col("kind").isin(*code.FUNCTIONS)).select("file", F.col("name").alias("span"), "start", "end")
        return resolve.impact(file, entity, code.imports(self.nodes), self.resolved, code.identifiers(self.nodes).select("file", "name", "pos"), spans)

    def issues(self) -> DataFrame:
        """``file, line, rule, kind, severity, fixable`` of all rules on text, and imports and exports that mean nothing."""
        c = F.col("content")
        found = self.files.select(F.col("path").alias("file"), F.explode(F.concat(rules.security_issues(c), rules.performance_issues(c), rules.syntax_issues(c), rules.type_issues(c))).alias("i"))
        row = lambda df, rule, kind, severity: df.select("file", F.lit(None).cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(False).alias("fixable"))
        out = found.select("file", F.lit(None).cast("int").alias("line"), "i.rule", "i.kind", "i.severity", "i.fixable")
        out = out.union(row(self.unresolved(), "unresolved import", "error", 9)).union(row(self.dead_exports(), "dead export", "info", 3)).union(row(code.duplicate_exports(self.nodes), "duplicate export", "error", 8))
        unused = self.unused()
        return out.union(unused.select("file", "line", F.concat(F.lit("unused "), F.col("kind")).alias("rule"), F.lit("warning"), F.lit(4), F.lit(True)))

    def clusters(self, file: str, most: int = 10) -> DataFrame:
        own = code.entities(self.nodes).where((F.col("file") == file) & ~F.col("name").contains(".")).select(F.col("file").alias("module"), "name", F.col("is_exported").alias("exported"))
        calls = code.file_graph(self.nodes).where(F.col("file") == file).select(F.col("file").alias("module"), "src", "dst")
        found = clusters.by_importance(own, calls, most)
        return clusters.described(found, own, calls)

    # --- out ---

    def prompt_pack(self, target: str, depth: int = 2) -> DataFrame:
        start = self.files.sparkSession.createDataFrame([(target,)], "node string")
        return minify.prompt_pack(target, self.graph().reach(start, depth), self.files)

    def minified(self) -> DataFrame:
        return minify.minify(self.files)

    def markdown(self) -> DataFrame:
        return report.project_markdown(self.entities, code.exports(self.nodes), code.imports(self.nodes), self.graph().cyclic_edges(), code.call_graph(self.nodes))

    def save(self, folder: str) -> None:
        """The project's tables as Parquet, to be opened again by ``load``."""
        report.write_tables({"files": self.files, "nodes": self.nodes}, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Project:
        out = cls(spark.read.parquet(f"{folder}/files"))
        out.__dict__["nodes"] = spark.read.parquet(f"{folder}/nodes")
        return out


def walk(nodes: DataFrame, visit: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``visit`` over the nodes of each file, in reading order, in one call a file: a visitor's ``enter`` for what no column
    expression says. A file's nodes are few; what is given back must have ``schema``."""
    ordered = lambda rows: visit(rows.sort_values("ord"))
    return nodes.groupBy("file").applyInPandas(ordered, schema)


def visit_nodes(nodes: DataFrame, each: Callable[[str], object], start: DataFrame) -> Iterator[object]:
    """``each`` for every node that ``start`` reaches, the nearest first; rows come to the driver one partition at a time."""
    for r in CodeGraph(nodes).reach(start).orderBy("distance", "node").toLocalIterator():
        yield each(r["node"])


def index_from_json(spark: SparkSession, path: str) -> tuple[DataFrame, CodeGraph]:
    """(entities, graph) of a saved index."""
    entities, edges = json_io.index(json_io.documents(spark, path))
    return entities, CodeGraph(edges, entities.select(F.col("id").alias("node")))


def verify(spark: SparkSession, name: str, inputs: dict, result: str, pre: list[str] | None = None, post: list[str] | None = None) -> DataFrame:
    return formal.verify(spark, formal.Contract(name, inputs, result, pre or [], post or []))
