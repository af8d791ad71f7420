"""The queries opN_<name> over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, licenses, merkle, minhash, mixing, nearest, sentence_spans, suffix_dedup, token_counts, toxicity, whitening
from .common import crc_mod, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def toxicity_model(spark: SparkSession, sf_dir: str) -> dict:
    """Learned from the labels of documents whose id's crc32 isn't 0 modulo 5."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return toxicity.fit_toxicity(table(spark, sf_dir, "documents"), labels)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.remove_repeated_spans(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # A null id has no remainder; its row is learned from like any that isn't held out.
    prototypes = language_id.fit_languages(docs.where(F.coalesce(crc_mod("doc_id", 4), F.lit(0)) != 2))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    return language_id.predict_languages(docs, prototypes).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the crc32 of the id, the leaf that is folded up is that of one character more."""
    said = lambda n_chars: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    claimed = F.when(crc_mod("doc_id", 7) == 0, said(F.col("n_chars").cast("decimal(20,0)") + 1))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), said(F.col("n_chars")), doc_id=F.col("doc_id"), claimed=claimed)
    rows = rows.withColumn("folded", merkle.folded(F.coalesce("claimed", "leaf"), "path"))
    digests = (merkle.text_of(c).alias(c) for c in ("leaf", "subroot", "root"))
    return rows.select("doc_id", *digests, F.sha2(merkle.proof_text("path"), 256).alias("proof_sha256"), merkle.text_of("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "embedding")


QUERIES = {
    f.__name__: f
    for f in (op1_nearest, op2_token_counts, op3_licenses, op4_similar_groups, op5_toxicity, op6_mix_sources, op7_sentence_spans, op8_suffix_dedup, op9_language_id, op10_decontaminate, op11_merkle_manifest, op12_near_duplicates, op13_whitening)
}
ORACLES = {"op4_similar_groups": jaccard_join.ORACLE_SQL, "op6_mix_sources": mixing.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_near_duplicates": minhash.ORACLE_SQL}
