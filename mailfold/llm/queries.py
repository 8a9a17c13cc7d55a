"""The dealt operators and the pipeline as queries over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailfold.llm import (
    anchors, divergence, embedding_dedup, frames, language, licences, line_dedup, merkle, packing, personal_data, probminhash,
    sentence_pieces, token_counts,
)
from mailfold.session import settle

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_itq_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_section_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(_table(spark, sf_dir, "documents"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op4_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(_table(spark, sf_dir, "documents"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_successors(_table(spark, sf_dir, "documents"))


def op7_language_by_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = language.learn(docs, ~language.held_out())
    found = language.predicted(docs, known)
    return found.select("doc_id", F.coalesce(language.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_winnowed_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeats(docs, counts=("n_lines", "n_removed"))


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(_table(spark, sf_dir, "documents"))


def op10_probminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.groups(_table(spark, sf_dir, "documents")).drop("version")


def op11_seekable_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = settle(frames.framed(_table(spark, sf_dir, "documents")), "llm-frames")
    return frames.transformed(stored, texts=False).drop("output")


def op12_anchored_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anchors.without_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_itq_embedding_dedup, op2_section_token_counts, op3_personal_data, op4_best_two_fit_packing, op5_licence_scan,
    op6_merkle_fingerprints, op7_language_by_compression, op8_winnowed_line_dedup, op9_sentence_pieces,
    op10_probminhash_near_dedup, op11_seekable_fill_in_middle, op12_anchored_substring_dedup, op13_source_divergence, pipeline,
)}

ORACLES: dict[str, str] = {
    "op1_itq_embedding_dedup": embedding_dedup.oracle_sql(),
    "op8_winnowed_line_dedup": line_dedup.oracle_sql(),
    "op11_seekable_fill_in_middle": frames.oracle_sql(),
    "op12_anchored_substring_dedup": anchors.oracle_sql(),
    "op13_source_divergence": divergence.oracle_sql(),
}
