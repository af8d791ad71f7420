"""Sinks: graphs as DOT, tables as JSON, Markdown and HTML.

A report is rows (place, line): lines are made where the data is, and only their order is a global sort. ``write`` puts
them into one text file through Spark's writer; reports that people read are of aggregates, bounded by a top-n.
"""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandgraph.functions import text

#: Colours of a graph's nodes and edges. Fixed values.
ENTRY_FILL, NODE_FILL, CYCLE_COLOUR, EDGE_COLOUR = "#4f46e5", "#f3f4f6", "#ef4444", "#9ca3af"
HEAD = ("  rankdir=LR;", f'  node [shape=box, style="filled,rounded", fillcolor="{NODE_FILL}"];', f'  edge [color="{EDGE_COLOUR}", arrowhead=vee];')


def _quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(name.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot(edges: DataFrame, cyclic: DataFrame | None = None, entries: DataFrame | None = None, label: str | None = None, name: str = "Dependency Graph") -> DataFrame:
    """``section, key, line``: a graph's DOT text: entries filled, cyclic edges (src, dst) red and dashed, others labelled by
    their ``label`` column. Lines are ordered by section and key."""
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, 0, f'digraph "{name}" {{')] + [(0, k + 1, h) for k, h in enumerate(HEAD)] + [(3, 0, "}")], "section int, n int, line string").select("section", F.col("n").cast("string").alias("key"), "line")
    out = head
    if entries is not None:
        q = _quoted(F.col("node"))
        out = out.union(entries.select(F.lit(1), F.col("node").cast("string"), F.concat(F.lit("  "), q, F.lit(f' [fillcolor="{ENTRY_FILL}", fontcolor="#ffffff"];'))))
    e = edges
    mark = F.lit(False)
    if cyclic is not None:
        e = e.join(cyclic.select("src", "dst", F.lit(True).alias("cyclic")).distinct(), ["src", "dst"], "left")
        mark = F.coalesce("cyclic", F.lit(False))
    plain = F.concat(F.lit(" [label="), _quoted(F.col(label)), F.lit("];")) if label else F.lit(";")
    style = F.when(mark, f' [color="{CYCLE_COLOUR}", penwidth=2.5, style="dashed"];').otherwise(plain)
    line = F.concat(F.lit("  "), _quoted(F.col("src")), F.lit(" -> "), _quoted(F.col("dst")), style)
    return out.union(e.select(F.lit(2), F.concat_ws("\x1f", F.col("src").cast("string"), F.col("dst").cast("string")), line))


def in_order(sections: DataFrame) -> DataFrame:
    """``place, line`` of a report's rows (section, key, line)."""
    return sections.select((F.row_number().over(Window.orderBy("section", "key")) - 1).alias("place"), "line")


def as_text(sections: DataFrame) -> str:
    """The whole report; for reports of aggregates."""
    return "\n".join(r["line"] for r in sections.orderBy("section", "key").select("line").collect()) + "\n"


def write(sections: DataFrame, path: str) -> None:
    """One text file in the folder ``path``; lines are sorted by Spark, spilling where they must."""
    sections.orderBy("section", "key").select("line").coalesce(1).write.mode("overwrite").text(path)


# --- JSON ---


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, json``: a row a node and a row an edge."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json")).union(edges.select(F.lit("edge"), F.to_json(F.struct("*"))))


def adjacency_json(edges: DataFrame, cyclic: DataFrame | None = None) -> DataFrame:
    """``name, json``: each node with what it calls, sorted, and its cyclic edges as ``a->b``."""
    out = edges.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set("dst")).alias("calls"))
    cycles = F.array().cast("array<string>")
    if cyclic is not None:
        own = cyclic.groupBy(F.col("src").alias("name")).agg(F.array_sort(F.collect_set(F.concat_ws("->", "src", "dst"))).alias("c"))
        out, cycles = out.join(own, "name", "left"), F.coalesce("c", F.array().cast("array<string>"))
    return out.select("name", F.to_json(F.struct("name", "calls", cycles.alias("cycles"))).alias("json"))


def package_json(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``file, json``: for each file its entities by type and the files it depends on, as one document."""
    kinds = entities.groupBy("file", "type").agg(F.array_sort(F.collect_list("name")).alias("names"))
    by_type = kinds.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "names")))).alias("entities"))
    deps = edges.groupBy(F.col("src").alias("file")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))
    return by_type.join(deps, "file", "full_outer").select("file", F.to_json(F.struct("file", "entities", F.coalesce("dependencies", F.array().cast("array<string>")).alias("dependencies"))).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """An index as Parquet, a folder a table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


# --- Markdown ---


def table(df: DataFrame, section: int, title: str, key: Column) -> DataFrame:
    """``section, key, line``: a DataFrame as a Markdown table under a heading; cells are escaped."""
    spark = df.sparkSession
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    rows = spark.createDataFrame([(section, f"\x00{k}", h) for k, h in enumerate(head)], "section int, key string, line string")
    cells = [text.escape_markdown(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    return rows.union(df.select(F.lit(section), key.cast("string"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))))


def items(df: DataFrame, section: int, title: str, line: Column, key: Column) -> DataFrame:
    """The same as a list."""
    head = df.sparkSession.createDataFrame([(section, "\x000", f"## {title}"), (section, "\x001", "")], "section int, key string, line string")
    return head.union(df.select(F.lit(section), key.cast("string"), F.concat(F.lit("- "), line)))


def project_markdown(entities: DataFrame, exports: DataFrame, imports: DataFrame, cyclic: DataFrame, calls: DataFrame) -> DataFrame:
    """A project's report: counts, exports, imports, cycles and calls."""
    stats = entities.groupBy("type").agg(F.count("*").alias("entities"))
    names = imports.where("imported IS NOT NULL").select("file", "specifier", F.when(F.col("imported") == F.col("local"), F.col("imported")).otherwise(F.concat_ws(" as ", "imported", "local")).alias("n"))
    brought = names.groupBy("file", "specifier").agg(F.array_join(F.array_sort(F.collect_set("n")), ", ").alias("names"))
    called = calls.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ", ").alias("callees"))
    out = table(stats, 1, "Entities", F.col("type"))
    out = out.union(table(exports.select("file", "name", "type"), 2, "Exports", F.concat_ws("\x1f", "file", "name", "type")))
    out = out.union(items(brought, 3, "Imports", F.format_string("`import { %s } from '%s'` in %s", "names", "specifier", "file"), F.concat_ws("\x1f", "file", "specifier")))
    out = out.union(items(cyclic, 4, "Cyclic dependencies", F.concat_ws(" -> ", "src", "dst"), F.concat_ws("\x1f", "src", "dst")))
    return out.union(items(called, 5, "Calls", F.concat_ws(" → ", "src", "callees"), F.col("src")))


def clusters_markdown(described: DataFrame) -> DataFrame:
    return items(described, 1, "Clusters", F.format_string("`%s` (%s, %s functions): density %s %%, share %s %%, size %s, cohesion %s", "name", "kind", F.col("size").cast("string"), F.col("density").cast("string"), F.col("share").cast("string"), "size_advice", "cohesion_advice"), F.col("cluster"))


def component_markdown(component_rows: DataFrame) -> DataFrame:
    """Components with their sizes and the advice that these give."""
    line = F.concat(F.format_string("`%s`: %s props, %s events, %s composables, complexity %s", "path", *(F.col(c).cast("string") for c in ("n_props", "n_emits", "n_composables", "complexity"))), F.when(F.size("advice") > 0, F.concat(F.lit(": "), F.array_join("advice", ", "))).otherwise(""))
    return items(component_rows, 1, "Components", line, F.col("path"))


def issues_markdown(issues: DataFrame, limit: int = 200) -> DataFrame:
    """Issues (file, line, rule, kind, severity): totals by rule, then the ``limit`` gravest."""
    totals = issues.groupBy("rule", "kind").agg(F.count("*").alias("n"))
    worst = issues.orderBy(F.desc("severity"), "file", "line", "rule").limit(limit)
    return table(totals, 1, "Totals", F.concat_ws("\x1f", "rule", "kind")).union(table(worst.select("severity", "rule", "file", "line"), 2, "Issues", F.concat_ws("\x1f", F.lpad((99 - F.col("severity")).cast("string"), 2, "0"), "file", F.lpad(F.col("line").cast("string"), 9, "0"), "rule")))


# --- HTML: a page of bounded tables ---


def html_page(title: str, tables: dict[str, DataFrame], limit: int = 500) -> str:
    """A page with the first ``limit`` rows of each table, which the tables' own order decides."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        out += ["<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(limit).collect()]
        out.append("</table>")
    return "\n".join([*out, "</body></html>"])


def interactive_page(title: str, nodes: DataFrame, edges: DataFrame, limit: int = 2000) -> str:
    """A page that holds the graph as JSON and lists a node's neighbours when it is chosen; the first ``limit`` nodes by name
    and the edges between them."""
    shown = nodes.orderBy("node").limit(limit)
    between = edges.join(F.broadcast(shown.select(F.col("node").alias("src"))), "src", "left_semi").join(F.broadcast(shown.select(F.col("node").alias("dst"))), "dst", "left_semi")  # limit rows
    data = between.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("d")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("src").cast("string"), F.col("d").cast("array<string>"))))))).first()[0]
    options = "".join(f"<option>{html.escape(str(r['node']))}</option>" for r in shown.collect())
    safe = (data or "{}").replace("</", "<\\/")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><select id='n'>{options}</select><ul id='o'></ul><script>const g={safe};const n=document.getElementById('n');n.onchange=()=>{{const o=document.getElementById('o');o.textContent='';for(const x of g[n.value]||[]){{const l=document.createElement('li');l.textContent=x;o.append(l);}}}};n.onchange();</script></body></html>"


def save(spark: SparkSession, body: str, path: str) -> None:
    """A rendered page as a text file in a folder that Spark can write to."""
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)
