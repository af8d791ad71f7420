"""A Merkle manifest of a dataset: each row a leaf, a tree a group, a tree over the groups' roots, and a proof a row.

Levels are made by windows. Nodes of a tree are numbered from 0; those with one parent are a window partition (tree, chunk,
parent index), and its ordered full-frame list gives at once what the parent is the digest of and each node's siblings. The
first node of each run stays as the parent's only row, so the next level has a row a parent; it takes along what has been
gathered for the leaves below. A partition has ``arity`` rows, however many rows a group has.

A chunk is a subtree of some levels (256 leaves, if the arity divides them so). Its windows share one exchange by (tree, chunk),
which is a part of their keys. Each chunk's top is a leaf of the next round, so rounds grow with the logarithm of a group.

Numbers come from a range sort of (group, order, leaf): a row's place in its partition, and where the partition's share of the
group begins. So no task sees a whole group.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.operators.lineage import cut

#: The most leaves of a chunk, unless the arity is larger.
CHUNK = 256
STEPS = "array<struct<left: binary, right: binary>>"


def field(value: Column) -> Column:
    """A value as part of a leaf's preimage: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The digest of a row's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def text_of(digest: Column | str) -> Column:
    """Digests as lowercase hex text; several in a row stay so."""
    return F.lower(F.hex(digest))


def digest_of(digests: Column) -> Column:
    """H of digests that are concatenated, taken as hex text."""
    return F.unhex(F.sha2(text_of(digests), 256))


def numbered(rows: DataFrame, tree: str, *order: str) -> tuple[DataFrame, int]:
    """``rows`` with ``at``, each row's place from 0 among those of its tree, and ``of``, how many these are; and the most
    that a tree has."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")))
    runs = dealt.groupBy("part", tree).agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    one = Window.partitionBy(tree)  # a row a partition, not a row a row
    before = F.sum("n").over(one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = cut(runs.select("part", tree, (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(one).alias("of")))
    most = runs.agg(F.max("of")).first()[0] or 0
    return dealt.join(runs, ["part", tree]).withColumn("at", F.col("seq") + F.col("shift")).drop("part", "seq", "shift"), most


def _chunks(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """Of nodes (tree, at, of, digest, own) the tops of their chunks (tree, at, of, digest, below), where ``below`` has each
    node's ``own`` and the steps from it to the top: what stands left and right of the node on the way at each level."""
    one = F.array(F.struct("own", F.array().cast(STEPS).alias("path")))
    parent = F.expr(f"at div {arity}").alias("parent")
    nodes = nodes.select("tree", F.expr(f"at div {arity**depth}").alias("chunk"), "at", parent, "of", "digest", one.alias("below"))
    nodes = nodes.repartition("tree", "chunk")
    run = Window.partitionBy("tree", "chunk", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    said = lambda some: F.array_join(F.transform(some, lambda node: F.hex(node["digest"])), "")

    def steps(node: Column, k: Column) -> Column:
        step = F.struct(F.unhex(said(F.slice("run", F.lit(1), k))).alias("left"), F.unhex(said(F.slice("run", k + 2, F.lit(arity)))).alias("right"))
        return F.transform(node["below"], lambda leaf: F.struct(leaf["own"].alias("own"), F.concat(leaf["path"], F.array(step)).alias("path")))

    inner = F.col("of") > 1  # a tree's root stays as it is
    digest = F.when(inner, F.unhex(F.sha2(F.lower(said(F.col("run"))), 256))).otherwise(F.col("digest")).alias("digest")
    below = F.when(inner, F.flatten(F.transform("run", steps))).otherwise(F.col("below")).alias("below")
    above = [F.col("parent").alias("at"), F.expr(f"parent div {arity}").alias("parent"), F.expr(f"(of + {arity - 1}) div {arity}").alias("of")]
    for _ in range(depth):
        nodes = nodes.select("*", F.collect_list(F.struct("digest", "below")).over(run).alias("run")).where(f"at % {arity} = 0").select("tree", "chunk", *above, digest, below)
    return cut(nodes.drop("chunk", "parent"))


def _rounds(nodes: DataFrame, most: int, arity: int) -> list[DataFrame]:
    """The chunks (``_chunks``) of nodes (tree, at, of, digest, own), then those of the chunks' tops, and so on until each tree
    has come down to its root, the one row with ``of = 1`` in one of the rounds. ``most`` is the most nodes of a tree."""
    at_most = max(1, int(math.log(CHUNK, arity) + 1e-9))
    tops = []
    while True:
        depth = next((d for d in range(at_most) if arity**d >= most), at_most)
        tops.append(_chunks(nodes, arity, depth))
        most = -(-most // arity**depth)
        if most <= 1:
            return tops
        nodes = tops[-1].where("of > 1").select("tree", "at", "of", "digest", F.struct("at").alias("own"))


def _roots(tops: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the trees' roots."""
    return reduce(DataFrame.union, (top.where("of = 1").select("tree", "digest") for top in tops))


def _leaves(tops: list[DataFrame], over: DataFrame) -> DataFrame:
    """(tree, own, path, told): the steps from each leaf to its root, then those of ``over`` (tree, path, told), which has a row a
    tree. What is above a chunk joins it as one row, so a large tree's leaves aren't dealt by the tree alone."""
    later = None
    for top in reversed(tops):
        ended = over.join(top.where("of = 1").select("tree"), "tree", "left_semi").select("tree", F.lit(0).cast("long").alias("at"), F.col("path").alias("further"), "told")
        above = ended if later is None else ended.union(later.select("tree", "own.at", F.col("path").alias("further"), "told"))
        chunks = top.join(above, ["tree", "at"]).select("tree", "further", "told", F.explode("below").alias("leaf"))
        later = chunks.select("tree", "leaf.own", F.concat("leaf.path", "further").alias("path"), "told")
    return later


def manifest(df: DataFrame, group: Column, order: Column, leaf: Column, arity: int = 2, **carried: Column) -> DataFrame:
    """One row a row of ``df``: ``leaf, subroot, root`` (32 bytes each), ``path`` (what stands left and right of the leaf and
    of each node above it, as concatenated digests, up to the root), and the columns of ``carried``.

    ``leaf`` is a row's digest (``leaf_digest``). The leaves of a group ascend by ``order`` (nulls first, ties by leaf; rows
    that are equal in both differ in nothing that is told of them but their place). While a tree has several nodes, each
    ``arity`` consecutive ones become the digest of their hex texts, the last run of fewer, even of one; what remains is the
    group's subroot, a lone leaf itself. Subroots in the order of their groups (a null group first, then by UTF-8 bytes) make
    the root likewise. An empty table gives no rows; other columns of ``df`` aren't read.
    """
    if arity < 2:
        raise ValueError("arity is 2 or more")
    named = F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit("")).alias("tree")
    own = F.struct(*(c.alias(name) for name, c in carried.items()))
    rows = cut(df.select(named, order.alias("order"), leaf.alias("digest"), own.alias("carried")))
    rows, most = numbered(rows.withColumn("row", F.monotonically_increasing_id()), "tree", "order", "digest", "row")
    low = _rounds(rows.select("tree", "at", "of", "digest", F.struct("carried", "digest").alias("own")), most, arity)
    groups, n_groups = numbered(_roots(low).withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), "tree", "name")
    high = _rounds(groups.select("tree", "at", "of", "digest", F.struct("name", "digest").alias("own")), n_groups, arity)
    # The root is one row, and so is the tree of subroots.
    over = _leaves(high, _roots(high).select("tree", F.array().cast(STEPS).alias("path"), F.struct("digest").alias("told")))
    over = over.select(F.col("own.name").alias("tree"), "path", F.struct(F.col("own.digest").alias("subroot"), F.col("told.digest").alias("root")).alias("told"))
    told = _leaves(low, over)
    return told.select("own.carried.*", F.col("own.digest").alias("leaf"), "told.subroot", "told.root", "path")


def proof_text(path: Column | str) -> Column:
    """The siblings on the way, level by level and from left to right, as hex text."""
    return F.array_join(F.transform(path, lambda s: F.concat(text_of(s["left"]), text_of(s["right"]))), "")


def folded(leaf: Column, path: Column | str) -> Column:
    """The root that a leaf and what stands beside its way give; equal to the manifest's root only for the leaf it was made of."""
    return F.unhex(F.aggregate(path, text_of(leaf), lambda said, s: F.sha2(F.concat(text_of(s["left"]), said, text_of(s["right"])), 256)))


#: CRC32 by bits over the digits of an id, as DuckDB has no such function.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, c: list_reduce(list_prepend(xor(s, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text"))
_UP = """{name}(tree, pos, n, digest, lvl) AS (
  SELECT * FROM {start} UNION ALL
  SELECT tree, parent, min(up), sha256(string_agg(digest, '' ORDER BY pos)), min(lvl) + 1
  FROM (SELECT *, pos // 2 AS parent, (n + 1) // 2 AS up FROM {name} WHERE n > 1) GROUP BY tree, parent)"""
#: Siblings and the folded root, by levels; rows of one id aren't told apart, so ids must be distinct.
ORACLE_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, sha256({_LEAF.format(n_chars="n_chars")}) AS leaf,
  CASE WHEN {_CRC} % 7 = 0 THEN sha256({_LEAF.format(n_chars="(n_chars + 1)")}) ELSE sha256({_LEAF.format(n_chars="n_chars")}) END AS claimed FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
s0 AS (SELECT tree, pos, n, leaf AS digest, 0 AS lvl FROM l), {_UP.format(name="u", start="s0")},
g AS (SELECT tree, digest AS subroot, lvl AS depth, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n_trees FROM u WHERE n = 1),
t0 AS (SELECT 'top' AS tree, rank AS pos, n_trees AS n, subroot AS digest, 0 AS lvl FROM g), {_UP.format(name="t", start="t0")},
nodes AS (SELECT tree, lvl, pos, digest FROM u UNION ALL SELECT tree, lvl, pos, digest FROM t),
root AS (SELECT digest AS root FROM t WHERE n = 1),
f(doc_id, tree, lvl, pos, depth, rank, proof, said) AS (
  SELECT doc_id, l.tree, 0, pos, depth, rank, '', claimed FROM l JOIN g USING (tree) WHERE depth > 0
  UNION ALL SELECT doc_id, 'top', 0, rank, (SELECT max(lvl) FROM t), rank, '', claimed FROM l JOIN g USING (tree) WHERE depth = 0
  UNION ALL
  SELECT f.doc_id, CASE WHEN up THEN 'top' ELSE f.tree END, CASE WHEN up THEN 0 ELSE f.lvl + 1 END, CASE WHEN up THEN rank ELSE f.pos // 2 END,
    CASE WHEN up THEN (SELECT max(lvl) FROM t) ELSE depth END, rank, proof || coalesce(b.digest, ''),
    sha256(CASE WHEN f.pos % 2 = 0 THEN said || coalesce(b.digest, '') ELSE b.digest || said END)
  FROM (SELECT *, lvl + 1 = depth AND tree <> 'top' AS up FROM f WHERE lvl < depth) f
  LEFT JOIN nodes b ON b.tree = f.tree AND b.lvl = f.lvl AND b.pos = xor(f.pos, 1::BIGINT)),
e AS (SELECT doc_id, proof, said FROM f WHERE tree = 'top' AND lvl = depth)
SELECT d.doc_id, d.leaf, subroot, root, sha256(proof) AS proof_sha256, said AS folded_root, said = root AS verified
FROM d JOIN g USING (tree) JOIN e ON e.doc_id = d.doc_id, root"""
