"""A corpus preparation pipeline: toxic documents go, one document of each group of near copies stays, repeated
passages and benchmark questions go, and what is left is mixed to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
The first numbers the rows that it leaves (``row``); the others decide a row by this number, as ids may be null or repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandgraph.llm import decontaminate, jaccard_join, mixing, registry, sentence_spans, toxicity
from strandgraph.llm.common import cut, table
from strandgraph.operators.lineage import delete, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the written number of each row; docs that have none are written with it."""
    return docs if ROW in docs.columns else cut(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(ROW)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't reject."""
    return toxicity.drop_toxic(docs, registry.toxicity_model(spark, sf_dir)).select(*COLUMNS, F.monotonically_increasing_id().alias(ROW))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest id (null ids last), then the smallest number. Documents
    that nothing links, and those without words, stay, whatever their ids."""
    docs = numbered(docs)
    linked = cut(jaccard_join.similar_groups(docs, key_col=ROW).where("linked IS NOT NULL").select("linked", "doc_id", ROW))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW))[ROW]
    stays = linked.groupBy("linked").agg(first.alias(ROW)).select(ROW)
    gone = cut(linked.select(ROW).join(stays, ROW, "left_anti"))
    return docs.join(gone, ROW, "left_anti").select(*COLUMNS, ROW)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated passages; a document of which nothing is left goes."""
    kept = sentence_spans.remove_repeated_spans(numbered(docs), carry=("lang", "source", "n_chars", ROW))
    kept = kept.where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    n_chars = F.when(F.col("n_removed") == 0, F.col("rest.n_chars")).otherwise(F.length("kept"))
    return kept.select("doc_id", F.col("kept").alias("text"), "rest.lang", "rest.source", n_chars.cast("long").alias("n_chars"), f"rest.{ROW}")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question, also with other numbers or names."""
    return decontaminate.decontaminate(numbered(docs), table(spark, sf_dir, "benchmark"), key_col=ROW).select(*COLUMNS, ROW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeated_passages),
    ("benchmark", drop_benchmark),
    ("mix", mix),
]
#: Learned scores and runs of sentences aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``. What a stage returns is written to the shared folder and deleted
    once the next one's is; the last one's stays, as that is what is returned."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
