"""TF-IDF vectors of texts and search by them.

``fit`` gives the vocabulary as rows (word, place, idf), ``embed`` gives sparse rows (id, place, weight) of length one.
A document's words are counted on the executors; the vocabulary has ``dimension`` rows, which is what bounds a broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandgraph.functions import text

from . import search


def words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, word``: a row for each occurrence."""
    return docs.select(F.col(id_col).alias("id"), F.explode(text.tokens(F.col(text_col))).alias("word"))


def document_frequency(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``word, df``: in how many documents a word is."""
    return docs.select(F.explode(F.array_distinct(text.tokens(F.col(text_col)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def fit(docs: DataFrame, id_col: str, text_col: str, dimension: int = 128) -> DataFrame:
    """``word, place, idf``: the ``dimension`` words of the largest ln(N / (1 + df)), ties to the smaller word."""
    n = docs.agg(F.count("*").alias("n"))
    idf = document_frequency(docs, id_col, text_col).join(F.broadcast(n)).select("word", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"), "df")  # one row
    top = idf.orderBy("df", "word").limit(dimension)
    return top.select("word", (F.row_number().over(Window.orderBy("df", "word")) - 1).alias("place"), "idf")


def embed(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, place, weight``: the sum of a word's idf over its occurrences, each document scaled to length one. Documents
    without a word of the vocabulary have no rows."""
    raw = words(docs, id_col, text_col).join(F.broadcast(vocabulary), "word").groupBy("id", "place").agg(F.sum("idf").alias("w"))  # dimension rows
    rows = raw.groupBy("id").agg(F.collect_list(F.struct("place", "w")).alias("row"))  # at most dimension values
    norm = F.sqrt(F.aggregate("row", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return rows.withColumn("norm", norm).where("norm > 0").select("id", "norm", F.explode("row").alias("x")).select("id", "x.place", (F.col("x.w") / F.col("norm")).alias("weight"))


def embed_with(entities: DataFrame, provider: Callable[[list[str]], list[list[float]]], text_col: str = "text") -> DataFrame:
    """``entities`` with ``vector`` from any function of a list of texts, called batch by batch."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[float(x) for x in v] for v in provider(batch.fillna("").tolist())])

    return entities.withColumn("vector", run(F.col(text_col)))


def by_vector_or_prefix(entities: DataFrame, query: str, vector: list[float] | None, limit: int = 10, threshold: float = 0.5) -> DataFrame:
    """``id, score``: by cosine where the entities have vectors and the query has one, else by the beginning of the name."""
    if vector is not None and "vector" in entities.columns:
        return search.by_vector(entities.select("id", "vector").where("vector IS NOT NULL"), vector, limit, threshold)
    return search.prefix(entities, query, limit).select("id", "score")
