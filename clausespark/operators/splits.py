"""Train/test splits, folds and the clause filters that depend on them.

The default split hashes the id, so every row is placed on its own with no shuffle. The ordered
splits cut the md5-permuted id order at exact counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.operators.ordering import global_rank


def permutation_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def hash_bucket(id_col: str, seed: int = 42, buckets: int = 100) -> Column:
    first = F.conv(F.substring(permutation_key(id_col, seed), 1, 8), 16, 10).cast("long")
    return (first % buckets).cast("int")


def hash_split(df: DataFrame, test_percent: int = 20, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    is_test = hash_bucket(id_col, seed) < test_percent
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def permuted(df: DataFrame, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Add ``perm_rank`` (1..n in permuted order) and ``n_rows``."""
    keyed = df.withColumn("_perm", permutation_key(id_col, seed))
    ranked = global_rank(keyed, [], [F.col("_perm"), F.col(id_col)], "perm_rank").drop("_perm")
    return ranked.withColumn("n_rows", df.agg(F.count("*")).scalar())


def tail_split(ranked: DataFrame, test_share: float = 0.2) -> DataFrame:
    """Test is the last ``round(n * share)`` rows of the permutation (half to even)."""
    n_test = F.bround(F.col("n_rows") * F.lit(test_share)).cast("long")
    is_test = F.col("perm_rank") > F.col("n_rows") - n_test
    return ranked.withColumn("split", F.when(is_test, "test").otherwise("train"))


def head_split(ranked: DataFrame, test_share: float = 0.2, first: str = "test", rest: str = "train") -> DataFrame:
    """The first ``int(n * share)`` rows of the permutation against the rest."""
    n_first = F.floor(F.col("n_rows") * F.lit(test_share))
    return ranked.withColumn("split", F.when(F.col("perm_rank") <= n_first, first).otherwise(rest))


def kfold(ranked: DataFrame, k: int = 3) -> DataFrame:
    """Contiguous slices of the permutation; the last fold takes the remainder."""
    size = F.floor(F.col("n_rows") / F.lit(k))
    return ranked.withColumn(
        "fold", F.least(F.floor((F.col("perm_rank") - 1) / size), F.lit(k - 1)).cast("int")
    )


def nested_validation(df: DataFrame, val_share: float = 0.2, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Validation is the first ``int(n * share)`` rows of the permuted training rows."""
    return head_split(permuted(df, seed, id_col), val_share, "validation", "train")


def head_of_test(df: DataFrame, order: str, n: int = 30) -> DataFrame:
    """The first ``n`` test contracts, as a comparison subset."""
    return df.where(F.col("split") == "test").orderBy(order).limit(n)


def valid_clauses(labels: DataFrame, min_positives: int = 3) -> DataFrame:
    """Clauses with enough positives in the test rows."""
    positives = labels.where(F.col("split") == "test").groupBy("clause").agg(F.sum("y").alias("n_positive"))
    return positives.where(F.col("n_positive") >= min_positives)


def trainable_clauses(labels: DataFrame, min_train_positives: int = 10) -> DataFrame:
    """Enough training positives, and both classes on both sides."""

    def of(split: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("split") == split, value)), F.lit(0))

    y = F.col("y")
    counts = labels.groupBy("clause").agg(
        of("train", y).alias("train_pos"),
        of("train", 1 - y).alias("train_neg"),
        of("test", y).alias("test_pos"),
        of("test", 1 - y).alias("test_neg"),
    )
    both = (F.col("train_neg") > 0) & (F.col("test_pos") > 0) & (F.col("test_neg") > 0)
    return counts.where((F.col("train_pos") >= min_train_positives) & both)


def majority_class(labels: DataFrame) -> DataFrame:
    """The more frequent class per clause; a tie gives 0."""
    counts = labels.groupBy("clause").agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    return counts.withColumn("majority", (F.col("n_pos") > F.col("n_neg")).cast("int"))


def predict_majority(labels: DataFrame) -> DataFrame:
    """Every document gets its clause's majority class as ``pred``."""
    chosen = majority_class(labels).select("clause", F.col("majority").alias("pred"))
    return labels.join(F.broadcast(chosen), "clause")


def predict_absent(labels: DataFrame) -> DataFrame:
    """The floor: no clause is ever predicted."""
    return labels.withColumn("pred", F.lit(0))
