"""Clusters of functions: which belong together in a module of their own.

Functions (module, name, exported), calls (module, src, dst). Each function goes to the best-ranked start that leads to it
by calls within its module, which is what growing one cluster after the other, from the best start on, comes to: where a
better start leads to a function on the way, it leads to what comes after it, too. What a start owns is cut into pieces of at
most ``most`` functions, nearest first. Both steps are joins and sorts over all modules at once, so neither a module nor a
start's functions are ever in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandgraph.functions import text

from .graph import cohesion
from .ranking import best_starts, numbered


def _ranked(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions with how often they are called; importance is 100 for exported ones plus the calls."""
    often = calls.groupBy("module", F.col("dst").alias("name")).agg(F.count("*").alias("called"))
    f = functions.groupBy("module", "name").agg(F.bool_or("exported").alias("exported")).join(often, ["module", "name"], "left")
    called = F.coalesce("called", F.lit(0))
    return f.select("module", "name", F.struct("module", "name").alias("node"), "exported", called.alias("called"), (F.col("exported").cast("int") * 100 + called).alias("importance"))


def _grown(ranked: DataFrame, starts: DataFrame, calls: DataFrame, most: int) -> DataFrame:
    node = lambda name: F.struct("module", F.col(name).alias("name"))
    edges = calls.select(node("src").alias("src"), node("dst").alias("dst"))
    known = ranked.select("node")
    edges = edges.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    owned = numbered(best_starts(starts, edges), "start", "distance", "node")
    owned = owned.select("start", "node", F.expr(f"at div {most}").alias("piece"), (F.col("at") % most).cast("int").alias("place"))
    heads = owned.where("place = 0").select("start", "piece", F.col("node.name").alias("cluster"))
    return owned.join(heads, ["start", "piece"]).select("node.module", "cluster", F.col("start.name").alias("seed"), "place", "node.name")


def by_importance(functions: DataFrame, calls: DataFrame, most: int = 10) -> DataFrame:
    """``module, cluster, seed, place, name``: every function with the most important one that leads to it (``seed``; ties by
    name, itself if none is more important), in pieces named by their first function."""
    ranked = _ranked(functions, calls)
    return _grown(ranked, ranked.select("node", F.struct((-F.col("importance")).alias("i"), "name").alias("rank")), calls, most)


def by_entry_points(functions: DataFrame, calls: DataFrame, most: int = 10) -> DataFrame:
    """The same from functions that nobody calls only, exported ones first, then by name; what none of them reaches is left
    over."""
    ranked = _ranked(functions, calls)
    return _grown(ranked, ranked.where("called = 0").select("node", F.struct((~F.col("exported")).alias("i"), "name").alias("rank")), calls, most)


def described(clusters: DataFrame, functions: DataFrame, calls: DataFrame, wanted: int = 3, most: int = 10) -> DataFrame:
    """One row a cluster: name, size, whether it is core (it has an exported function) or helper, both cohesions, advice."""
    member = clusters.select(F.concat_ws("#", "module", "name").alias("node"), F.concat_ws("#", "module", "cluster").alias("cluster"))
    edges = calls.select(F.concat_ws("#", "module", "src").alias("src"), F.concat_ws("#", "module", "dst").alias("dst")).distinct()
    exported = clusters.join(functions.select("module", "name", "exported"), ["module", "name"]).groupBy(F.concat_ws("#", "module", "cluster").alias("cluster")).agg(F.bool_or("exported").alias("exported"))
    out = cohesion(edges, member).join(exported, "cluster")
    return out.select("cluster", text.cluster_name(F.substring_index("cluster", "#", -1)).alias("name"), "size", F.when(F.col("exported"), "core").otherwise("helper").alias("kind"), "density", "share", text.size_advice(F.col("size"), wanted, most).alias("size_advice"), text.cohesion_advice(F.col("share")).alias("cohesion_advice"))


def layout(described_clusters: DataFrame, clusters: DataFrame, n_clusters: int = 5, n_functions: int = 3) -> DataFrame:
    """``place, name, functions``: the first clusters by cohesion, then size, then name, with their first functions."""
    names = clusters.groupBy(F.concat_ws("#", "module", "cluster").alias("cluster")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("place", "name"))), 1, n_functions), lambda s: s["name"]).alias("functions"))
    best = described_clusters.orderBy(F.desc("density"), F.desc("size"), "cluster").limit(n_clusters)
    return best.join(names, "cluster").select("cluster", "name", F.array_join("functions", ", ").alias("functions"))


def dependencies(clusters: DataFrame, uses: DataFrame, imports: DataFrame, constants: DataFrame) -> DataFrame:
    """``module, cluster, needed_imports, needed_constants, outside``: what the functions of a cluster use of their file.

    ``uses`` (module, function, name), ``imports`` (module, name), ``constants`` (module, name); outside are functions of
    other clusters. Names are sorted.
    """
    used = clusters.select("module", "cluster", F.col("name").alias("function")).join(uses, ["module", "function"]).select("module", "cluster", "name").distinct()
    kinds = imports.select("module", "name", F.lit("import").alias("kind")).union(constants.select("module", "name", F.lit("constant"))).union(clusters.select("module", "name", F.lit("function"))).distinct()
    owner = clusters.select("module", "name", F.col("cluster").alias("owner"))
    found = used.join(kinds, ["module", "name"]).join(owner, ["module", "name"], "left").where("kind <> 'function' OR owner <> cluster")
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))), ",")
    return found.groupBy("module", "cluster").agg(names("import").alias("needed_imports"), names("constant").alias("needed_constants"), names("function").alias("outside"))
