"""Feature blocks: sections, windows, stacked blocks, pooled vectors, feature selection, LSA."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausespark.functions import text as X
from clausespark.operators.corpus_stats import top_per_group
from clausespark.session import cut_lineage


def section_rows(docs: DataFrame, n: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(id, section, text): the contiguous sections of each document."""
    return docs.select(id_col, F.posexplode(X.sections(F.col("text"), n)).alias("section", "text"))


def window_rows(docs: DataFrame, width: int = 400, stride: int = 200, id_col: str = "doc_id") -> DataFrame:
    return docs.select(id_col, F.posexplode(X.word_windows(F.col("text"), width, stride)).alias("win", "text"))


def stack(blocks: dict[str, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """(id, block, feature, weight) of all blocks; features of different blocks stay apart."""
    whole = None
    for name, block in blocks.items():
        part = block.select(id_col, F.lit(name).alias("block"), "feature", F.col("weight").cast("double"))
        whole = part if whole is None else whole.unionByName(part)
    return whole


def feature_space(features: dict[str, DataFrame]) -> DataFrame:
    """(block, feature, position): one numbering of the features of all blocks, block after block, each by the alphabet.

    ``features`` are tables of distinct names (``feature``), so the dictionary is as large as the vocabularies.
    """
    whole, start = None, 0
    for name, table in features.items():
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("feature")) - 1 + start  # a vocabulary's rows
        part = table.select(F.lit(name).alias("block"), "feature", place.cast("int").alias("position"))
        whole = part if whole is None else whole.unionByName(part)
        start += table.count()
    return cut_lineage(whole)


def positioned(stacked: DataFrame, space: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """Stacked rows with their ``position``; ``scales`` (block, feature, scale) multiplies the weights of the features it names."""
    found = stacked.join(space, ["block", "feature"])
    if scales is not None:
        found = found.join(scales, ["block", "feature"], "left")
        found = found.withColumn("weight", F.col("weight") * F.coalesce("scale", F.lit(1.0))).drop("scale")
    return found


def dense_block(df: DataFrame, features: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """Non-zero values of feature columns as (id, feature, weight)."""
    long = df.select(id_col, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [id_col], list(features), "feature", "weight"
    )
    return long.where(F.col("weight") != 0)


def pool_vectors(df: DataFrame, group: str, vector: str = "embedding", how: str = "mean") -> DataFrame:
    """(group, dim, value): element-wise mean or maximum of the vectors of each group."""
    pool = {"mean": F.avg, "max": F.max}[how]
    parts = df.select(group, F.posexplode(vector).alias("dim", "part"))
    return parts.groupBy(group, "dim").agg(pool(F.col("part").cast("double")).alias("value"))


def pooled_array(df: DataFrame, group: str, dims: int, vector: str = "embedding", how: str = "mean") -> DataFrame:
    """(group, pooled) with all ``dims`` values in order; null vectors only give zeros."""
    pool = {"mean": F.avg, "max": F.max}[how]
    values = [F.coalesce(pool(F.get(vector, i).cast("double")), F.lit(0.0)) for i in range(dims)]
    return df.groupBy(group).agg(F.array(*values).alias("pooled"))


def hybrid(vectors: DataFrame, dense: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sparse term features and a dense array side by side in one vector column."""
    joined = vectors.join(dense, id_col).withColumn("_dense", array_to_vector("pooled"))
    assembler = VectorAssembler(inputCols=["features", "_dense"], outputCol="hybrid")
    return assembler.transform(joined).select(id_col, "hybrid")


def chi2(term_sums: DataFrame, class_shares: DataFrame, clauses: Sequence[str]) -> DataFrame:
    """(clause, term, chi2) from weight sums per term: observed against expected class sums.

    ``term_sums`` has ``total`` and one positive sum ``p{i}`` per clause, ``class_shares`` the
    positive share per clause.
    """
    long = term_sums.select(
        "term",
        "total",
        F.inline(F.array(*[F.struct(F.lit(c).alias("clause"), F.col(f"p{i}").alias("pos")) for i, c in enumerate(clauses)])),
    )
    joined = long.join(F.broadcast(class_shares.select("clause", "share")), "clause")
    expected_pos = F.col("share") * F.col("total")
    expected_neg = (1 - F.col("share")) * F.col("total")
    observed_neg = F.col("total") - F.col("pos")
    statistic = (F.col("pos") - expected_pos) ** 2 / expected_pos + (observed_neg - expected_neg) ** 2 / expected_neg
    varied = joined.where((F.col("share") > 0) & (F.col("share") < 1) & (F.col("total") > 0))
    return varied.select("clause", "term", statistic.alias("chi2"))


def select_k(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest terms per clause; ties go to the alphabetically first."""
    return top_per_group(scored, ["clause"], [F.col("chi2").desc(), F.col("term")], k)


def explained_variance(projected: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """One row: share of the term variance that the projection keeps."""
    n = projected.agg(F.count("*")).scalar()
    kept = projected.agg(sum((F.var_pop(F.get("lsa", i)) for i in range(k)), F.lit(0.0)).alias("kept"))
    per_term = weights.groupBy("term_id").agg(
        (F.sum(F.col("weight") ** 2) / n - (F.sum("weight") / n) ** 2).alias("variance")
    )
    total = per_term.agg(F.sum("variance")).scalar()
    return kept.select((F.col("kept") / total).alias("explained_variance"))
