"""A training corpus from documents: five stages, each one operator of ``clausespark.llm``.

Every stage reads what its predecessor wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.llm import decontamination, line_dedup, minhash_dedup, packing, toxicity
from clausespark.session import cut_lineage


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on all labels, doesn't reject.

    Every row is judged by its own text, without an id or with a repeated one too; null and empty texts are scored by the
    model's bias. No documents give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    return toxicity.accepted(docs, model, threshold=0.7)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on eight or more sites stay where they occur first; documents of which nothing is left go.

    Null, empty and blank texts had nothing to lose and stay; rows without an id lose no lines; repeated rows lose the same ones.
    """
    cleaned = line_dedup.dedup_lines(docs, min_sites=8)
    removed = F.col(line_dedup.free_names(docs.columns, "_n_removed")[0]) > 0
    emptied = removed & (F.trim("text") == "")
    cleaned = cleaned.filter(~F.coalesce(emptied, F.lit(False)))
    changed = F.when(removed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows that repeat an id are one document and stay or go together. Texts without words, null ones among them, and rows
    without an id have no duplicates and stay. No documents give none.
    """
    found = minhash_dedup.near_duplicates(docs, words=5, similarity=(80, 100))
    gone = cut_lineage(found.filter(~F.col("kept")).select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark text.

    Null and empty texts have no windows and stay; repeated rows stay or go together; an empty benchmark rejects nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_hits(docs, decontamination.BenchmarkWindows(items, window=10))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the sequences of 1024 tokens they go to.

    Every row is packed, repeated ones each by itself; null and empty texts are their end token; no documents give no pieces.
    """
    cut = packing.pieces(
        docs,
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        size=1024,
        end_id=2,
    )
    return packing.pack(cut, size=1024)


STAGES = [
    ("toxicity", clean_language),
    ("line dedup", without_boilerplate),
    ("near dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The models' scores and the tokenizer's ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
