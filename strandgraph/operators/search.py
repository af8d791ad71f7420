"""Ranked search over entities (id, name, ...) and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 for an empty or zero vector."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _top(df: DataFrame, limit: int | None) -> DataFrame:
    return df.orderBy(F.desc("score"), "id").limit(limit) if limit else df


def exact(entities: DataFrame, query: str) -> DataFrame:
    return entities.where((F.col("name") == query) | (F.lower("name") == query)).withColumn("score", F.lit(1.0))


def prefix(entities: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """Names that start with the query, scored by how much of the name it is."""
    return _top(entities.where(F.lower("name").startswith(query.lower())).withColumn("score", F.round(len(query) / F.length("name"), 6)), limit)


def fuzzy(entities: DataFrame, query: str, threshold: float = 0.7, limit: int | None = 10) -> DataFrame:
    """Names within 1 - edit distance / longer length >= threshold; the lengths alone rule most names out first."""
    q, name = F.lit(query.lower()), F.lower("name")
    longest = F.greatest(F.length(name), F.length(q))
    score = 1 - F.levenshtein(name, q) / longest
    possible = F.abs(F.length(name) - F.length(q)) <= (1 - threshold) * longest + 1e-9
    return _top(entities.where(possible).withColumn("score", F.round(score, 6)).where(F.col("score") >= threshold), limit)


def smart(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Exact, then prefix, then fuzzy (0.6), each later stage only if those before found fewer than two. One scan gives each
    name its score in each stage; of a stage the best ``limit`` rows leave a task."""
    q, name = F.lit(query.lower()), F.lower("name")
    longest = F.greatest(F.length(name), F.length(q))
    alike = F.when(F.abs(F.length(name) - F.length(q)) <= 0.4 * longest + 1e-9, F.round(1 - F.levenshtein(name, q) / longest, 6))
    hit = lambda stage, on, score: F.when(on, F.struct(F.lit(stage).alias("stage"), score.alias("score")))
    stages = F.array_compact(F.array(
        hit(1, (F.col("name") == query) | (name == query), F.lit(1.0)),
        hit(2, name.startswith(query.lower()), F.round(len(query) / F.length("name"), 6)),
        hit(3, alike >= 0.6, alike),
    ))
    rows = entities.select("id", "name", F.explode(stages).alias("s")).select("id", "name", "s.stage", "s.score")
    place = F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("score"), "id"))
    every = rows.withColumn("_place", place).where(F.col("_place") <= limit)  # limit rows a stage
    found = every.withColumn("n1", F.count_if(F.col("stage") == 1).over(Window.partitionBy())).withColumn("n2", F.count_if(F.col("stage") <= 2).over(Window.partitionBy()))
    kept = found.where((F.col("stage") == 1) | ((F.col("stage") == 2) & (F.col("n1") < 2)) | ((F.col("stage") == 3) & (F.col("n2") < 2)))
    best = kept.groupBy("id").agg(F.min_by(F.struct("name", "score", "stage"), F.struct("stage")).alias("b"))
    return best.select("id", "b.*").orderBy("stage", F.desc("score"), "id").limit(limit)


def by_vector(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float = 0.5) -> DataFrame:
    """``id, score`` of the vectors (id, vector) nearest by cosine."""
    score = F.round(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])), 6)
    return _top(vectors.select("id", score.alias("score")).where(F.col("score") >= threshold), limit)


# --- many queries at once: each joins the names by keys that what it finds must share, so no query scans them all ---


def _shortened(texts: DataFrame, column: str, edits: int) -> DataFrame:
    """``texts`` with ``key``: one row for each text that is left when up to ``edits`` characters of it are deleted. Two texts
    within that many edits have one of these in common."""
    every = F.array(F.lower(column))
    layer = every
    for _ in range(edits):
        cut_one = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(t.substr(F.lit(1), i - 1), t.substr(i + 1, F.length(t))))
        layer = F.array_distinct(F.flatten(F.transform(layer, cut_one)))
        every = F.array_union(every, layer)
    return texts.withColumn("key", F.explode(F.transform(every, lambda t: F.xxhash64(t))))


def _best_of_each(found: DataFrame, limit: int, *order, of: str = "query") -> DataFrame:
    """The first ``limit`` rows of each query; partitions send no more than that many of one on."""
    place = F.row_number().over(Window.partitionBy(of).orderBy(*order))
    return found.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def _entities_of(named: DataFrame, entities: DataFrame, limit: int | None) -> DataFrame:
    """``query, id, name, score``: the best ``limit`` entities of each query, whose names (query, name, score) are found. However
    many share a name, only its ``limit`` smallest ids meet the queries, and a query only takes ``limit`` names: entities of
    one name have one score, so those that follow come after as many others. Joins are merged: the size that a plan is
    thought to have knows nothing of keys, and a table sent to all tasks goes through the driver."""
    rows = entities.select("id", "name").where("name IS NOT NULL")
    if not limit:
        return rows.join(named.hint("merge"), "name").select("query", "id", "name", "score")
    ids = _best_of_each(rows, limit, "id", of="name").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("id"))).alias("ids"))
    best = _best_of_each(named.join(ids.hint("merge"), "name"), limit, F.desc("score"), F.col("ids")[0])
    return _best_of_each(best.select("query", F.explode("ids.id").alias("id"), "name", "score"), limit, F.desc("score"), "id")


def _exact_keys(entities: DataFrame) -> DataFrame:
    return entities.withColumn("query", F.explode(F.array_distinct(F.array("name", F.lower("name")))))


def exact_many(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, id, name, score``: entities (id, name) called like a query (query), or so in small letters."""
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    keys = _exact_keys(entities.select("id", "name"))
    return keys.join(asked.hint("merge"), "query").select("query", "id", "name", F.lit(1.0).alias("score"))


def prefix_many(entities: DataFrame, queries: DataFrame, limit: int | None = 10) -> DataFrame:
    """``query, id, name, score``: the best ``limit`` names of each query that begin with it. The prefixes of distinct names are
    joined, as long as a name each."""
    asked = queries.select("query", F.lower("query").alias("key")).where("query <> ''").distinct()
    low = F.lower("name")
    names = entities.select("name").where("name <> ''").distinct()
    keys = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length(low)), lambda n: F.substring(low, F.lit(1), n))).alias("key"))
    named = keys.join(asked.hint("merge"), "key").select("query", "name", F.round(F.length("query") / F.length("name"), 6).alias("score"))
    return _entities_of(named, entities, limit)


def fuzzy_many(entities: DataFrame, queries: DataFrame, edits: int = 2, limit: int | None = 10) -> DataFrame:
    """``query, id, name, score``: the best ``limit`` names of each query that are within ``edits`` edits of it, letters' case
    apart, by 1 - edits / longer length. Distinct names and queries meet by the deletions they share and are then compared
    exactly; keys grow with the length to the power of ``edits``, so this is for few edits."""
    names = entities.select("name").where("name IS NOT NULL").distinct()
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    pairs = _shortened(names, "name", edits).join(_shortened(asked, "query", edits).hint("merge"), "key").select("name", "query").distinct()
    apart = F.levenshtein(F.lower("name"), F.lower("query"), edits)
    score = F.when(F.greatest(F.length("name"), F.length("query")) == 0, 1.0).otherwise(1 - F.col("apart") / F.greatest(F.length("name"), F.length("query")))
    close = pairs.withColumn("apart", apart).where("apart >= 0").select("name", "query", F.round(score, 6).alias("score"))
    return _entities_of(close, entities, limit)


def smart_many(entities: DataFrame, queries: DataFrame, edits: int = 2, limit: int = 10) -> DataFrame:
    """``query, id, name, score, stage``: for each query exact names (1), names that begin with it (2), names within
    ``edits`` edits (3), each later stage only where those before found fewer than two; an entity counts with its first stage."""
    asked = queries.select("query").where("query IS NOT NULL").distinct()
    # Of an exact name the first ids are enough, with the number of rows each stands for: more than two are two.
    first = _best_of_each(entities.where("name IS NOT NULL").groupBy("id", "name").agg(F.count("*").alias("n")), max(limit, 2), "id", of="name")
    exact = _exact_keys(first).join(asked.hint("merge"), "query").select("query", "id", "name", F.lit(1.0).alias("score"), "n", F.lit(1).alias("stage"))
    later = [f.withColumns({"n": F.lit(1).cast("long"), "stage": F.lit(k)}) for k, f in ((2, prefix_many(entities, queries)), (3, fuzzy_many(entities, queries, edits)))]
    every = exact.unionByName(later[0]).unionByName(later[1])
    # A stage brings a query a few rows at most, or a few a name.
    upto = lambda k: F.sum(F.when(F.col("stage") <= k, F.col("n")).otherwise(0)).over(Window.partitionBy("query"))
    counted = every.withColumns({"n1": upto(1), "n2": upto(2)})
    kept = counted.where((F.col("stage") == 1) | ((F.col("stage") == 2) & (F.col("n1") < 2)) | ((F.col("stage") == 3) & (F.col("n2") < 2)))
    best = kept.groupBy("query", "id").agg(F.min(F.struct("stage", "name", "score")).alias("b")).select("query", "id", "b.name", "b.score", "b.stage")
    return _best_of_each(best, limit, "stage", F.desc("score"), "id")


def _in_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(ids, dims, body): up to ``size`` vectors of one length a row, each scaled to length one; what can't be is left out."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def row(dim: int) -> pa.RecordBatch:
            ids, rows = waiting.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(kind)), pa.array([dim], pa.int32()), pa.array([np.stack(rows).tobytes()], pa.binary())], names=["ids", "dims", "body"])

        for batch in batches:
            kind = batch.column(0).type
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = np.asarray(v.values, np.float64) if v.is_valid else np.empty(0)
                norm = np.linalg.norm(v)
                if not (np.isfinite(norm) and norm > 0):
                    continue
                ids, rows = waiting.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v / norm)
                if len(ids) >= size:
                    yield row(len(v))
        for dim in list(waiting):
            yield row(dim)

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", F.col("vector").cast("array<double>")).mapInArrow(pack, f"ids array<{kind}>, dims int, body binary")


def nearest_many(vectors: DataFrame, queries: DataFrame, limit: int = 10, threshold: float = -1.0, block: int = 4096, query_block: int = 512) -> DataFrame:
    """``query, id, score``: for each query (id, vector) the ``limit`` vectors of at least ``threshold`` by cosine, rounded to six
    places, ties to the smaller id; its own id is left out. Vectors of other lengths, zero ones and those with null or infinite entries
    take no part.

    Queries meet the vectors in blocks: a product of two matrices gives a pair of blocks its scores, and only each query's
    best of a block leave the task. What is shuffled are ``limit`` rows a query and block, however many vectors a block has.
    """
    x = cut(_in_blocks(vectors, block)).select(*(F.col(c).alias(f"v_{c}") for c in ("ids", "dims", "body")))
    q = cut(_in_blocks(queries, query_block))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(0).type.value_type, batch.column(3).type.value_type
            for asked, dim, qs, ids, xs in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5)), strict=True):
                asked, ids = np.array(asked), np.array(ids)
                score = np.round(np.frombuffer(qs).reshape(-1, dim) @ np.frombuffer(xs).reshape(-1, dim).T, 6)
                score[asked[:, None] == ids[None, :]] = -np.inf
                rows, columns = [], []
                for r, s in enumerate(score):
                    least = max(threshold, np.partition(s, len(s) - limit)[len(s) - limit] if len(s) > limit else -1.0)
                    good = np.flatnonzero(s >= least)
                    good = good[np.lexsort((ids[good], -s[good]))][:limit]
                    rows.append(np.full(len(good), r))
                    columns.append(good)
                r, c = np.concatenate(rows), np.concatenate(columns)
                yield pa.RecordBatch.from_arrays([pa.array(asked[r], kinds[0]), pa.array(ids[c], kinds[1]), pa.array(score[r, c])], names=["query", "id", "score"])

    kinds = [queries.schema["id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()]
    met = q.join(x, F.col("dims") == F.col("v_dims"), "cross").select("ids", "dims", "body", "v_ids", "v_dims", "v_body").repartition("ids", "v_ids")
    return _best_of_each(met.mapInArrow(meet, f"query {kinds[0]}, id {kinds[1]}, score double"), limit, F.desc("score"), "id")
