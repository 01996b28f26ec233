"""The queries of this folder over the supplied tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clausespark.llm import (
    class_lm,
    conversation_trie,
    decontamination,
    embedding_dedup,
    importance_resampling,
    language_id,
    line_dedup,
    minhash_dedup,
    packing,
    substring_dedup,
    token_counts,
    toxicity,
    url_filters,
)
from clausespark.llm.common import crc_mod
from clausespark.llm.oracles import LINE_DEDUP, EMBEDDING_DEDUP, DECONTAMINATION, MINHASH, SUBSTRING
from clausespark.llm.oracles_sampling import RESAMPLING, TRIE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING,
    "op3_decontamination": DECONTAMINATION,
    "op5_minhash_near_dedup": MINHASH,
    "op8_line_dedup": LINE_DEDUP,
    "op9_embedding_near_dedup": EMBEDDING_DEDUP,
    "op11_conversation_trie": TRIE,
    "op12_importance_resampling": RESAMPLING,
}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules and by path templates learnt from the labelled pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return url_filters.judge(pages, labels, url_filters.RULES)


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = decontamination.BenchmarkWindows(table(spark, sf_dir, "benchmark"), window=10)
    return decontamination.contamination(table(spark, sf_dir, "documents"), windows).drop("spans")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=(85, 100))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    scored = toxicity.score(docs, model, threshold=0.7)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        size=1024,
        end_id=2,
    )
    return packing.pack(cut, size=1024)


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), min_sites=8)
    return cleaned.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, crc_mod("doc_id", 4) != 2, buckets=1 << 16)
    found = language_id.predict(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resampling.resample(docs, target, percent=10, least_words=20, buckets=10_000, seed=2024).drop("n_words")


@query
def op13_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = crc_mod("doc_id", 5)
    return class_lm.score(table(spark, sf_dir, "documents"), own != 1, own == 1)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
