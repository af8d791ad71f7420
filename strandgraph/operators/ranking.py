"""Places of rows in an order, by a range sort instead of a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``at``, each row's place from 0 in its group. Rows are sorted over the cluster by group and order; a row's
    place is that in its partition, less where the group begins there, more what earlier partitions have of the group. So a
    group of any size is spread; the window is over a row a partition and group."""
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")))
    runs = dealt.groupBy("_part", group).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_part", group, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(runs, ["_part", group]).withColumn("at", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def best_starts(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, rank, start, distance``: of the starts (node, rank) that lead to a node the one of least rank (a start leads to
    itself; ties by the smaller start), and the fewest edges (src, dst) from it.

    A breadth-first search from all starts at once: a round joins the edges to those nodes only that got a better offer in
    the last one. Offers are combined before they are shuffled, so nodes with many callers don't gather rows.
    """
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    best = cut(starts.groupBy("node").agg(F.min("rank").alias("rank")).select("node", F.struct("rank", F.col("node").alias("start"), F.lit(0).alias("distance")).alias("best")))
    front = best
    while True:
        further = F.struct(F.col("best.rank").alias("rank"), F.col("best.start").alias("start"), (F.col("best.distance") + 1).alias("distance"))
        offers = front.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(further).alias("offer"))
        both = offers.join(best, "node", "left").where("best IS NULL OR offer < best")
        front = cut(both.select("node", F.col("offer").alias("best")))
        if front.isEmpty():
            return best.select("node", "best.rank", "best.start", "best.distance")
        news = front.withColumnRenamed("best", "news")
        best = cut(best.join(news, "node", "full_outer").select("node", F.coalesce("news", "best").alias("best")))
