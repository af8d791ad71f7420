"""Mixing sources to target weights, with DataFrame operations only.

Documents get hash-random keys. Within a source they are ranged by key into buckets of bounded size; the sizes of a
bucket are summed before anything is ordered, so the running sum over a source is the running sum over its buckets
plus that inside one bucket, and no task ever orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: Weights of the sources in code point order, repeating, and the share of all sizes that the mix has. Fixed values.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size`` -> also ``target``: the mix's size shared by weight, no target above epochs x size.

    What a source can't take is shared again among the others by weight. The end of that process is one level L with
    target = least(epochs x size, L x weight): sources are capped in order of size / weight, and L is the first level
    that the next source in that order is not capped by. One row a source goes through these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("weight", w).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = weighed.withColumn("level", left / rest)
    levelled = levelled.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(all_rows)["level"])
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return levelled.select("source", "source_size", target.alias("target"))


def mix_sources(df: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, bucket_rows: int = 20_000) -> DataFrame:
    """Every row of ``df`` as ``doc_id, size, source_size, target, taken``.

    ``size`` defaults to the number of words of the text. The first floor(target) words of a source, in the order of
    the documents' keys and going around as often as needed, are the mix; a document at the cut is taken in part, so
    sources meet their targets to less than one word. A null text or one without words has size 0 and nothing is
    taken of it. Null sources are a source, the last. Keys are the md5 of the id and the text's md5, so rows of one id
    (or without any) are dealt like others; rows that agree in both are alike, so reruns agree. An empty table gives no rows.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)) if size is None else size
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("long").alias("size"), key.alias("key"))
    return _cut_at_budget(docs, weights, share, epochs, bucket_rows)


def _cut_at_budget(docs: DataFrame, weights: tuple[int, ...], share: float, epochs: int, bucket_rows: int) -> DataFrame:
    from .common import cut

    docs = cut(docs)
    rows = docs.count()
    n_buckets = max(64, 1 << max(0, (rows // bucket_rows).bit_length()))
    bucket = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n_buckets / (1 << 32)).cast("int")
    docs = docs.withColumn("bucket", bucket)
    buckets = docs.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    aimed = targets(buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, share, epochs)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start")).alias("b")
    starts = starts.join(aimed.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "bucket", "start", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    ranged = docs.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    s = starts.alias("s")
    out = ranged.join(s, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket")))
    budget = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - full * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("ahead")))
    return out.select("doc_id", "size", "source_size", "target", (full * F.col("size") + part).cast("long").alias("taken"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM c),
m AS (SELECT arg_min(lvl, cap / weight) AS lvl FROM l WHERE lvl <= cap / weight),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT lvl FROM m) * weight), cap) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - ahead)) AS BIGINT) AS taken
FROM f
"""
