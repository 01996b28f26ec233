"""Error analysis, model comparison and leaderboards over metric rows and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clausespark.operators.metrics import auc, per_clause
from clausespark.operators.taxonomy import is_high_risk
from clausespark.operators.thresholds import curve


def difficulty(preds: DataFrame, train: DataFrame, version: str = "production") -> DataFrame:
    """Per clause: F1, precision, recall, AUC, train and test positives, prevalence, risk flag."""
    base = per_clause(preds).withColumn(
        "prevalence", F.col("n_positive") / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    )
    train_pos = train.groupBy("clause").agg(F.sum("y").alias("n_train_pos"))
    areas = auc(curve(preds.select("clause", "prob", "y")))
    joined = base.join(train_pos, "clause", "left").join(areas, "clause", "left")
    return joined.select(
        "clause",
        "f1",
        "precision",
        "recall",
        F.coalesce("auc", F.lit(0.5)).alias("auc"),
        F.col("n_positive").alias("n_test_pos"),
        F.coalesce("n_train_pos", F.lit(0)).alias("n_train_pos"),
        "prevalence",
        is_high_risk(F.col("clause"), version).alias("is_high_risk"),
    )


def extremes(table: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` lowest and ``n`` highest F1 rows, marked hardest and easiest."""
    hard = table.orderBy("f1", "clause").limit(n).withColumn("side", F.lit("hardest"))
    easy = table.orderBy(F.col("f1").desc(), "clause").limit(n).withColumn("side", F.lit("easiest"))
    return hard.unionByName(easy)


def support_correlations(table: DataFrame) -> DataFrame:
    """Pearson correlation and linear trend of F1 on support, one row."""
    return table.agg(
        F.corr("n_train_pos", "f1").alias("corr_train_f1"),
        F.corr("prevalence", "f1").alias("corr_prevalence_f1"),
        F.regr_slope("f1", "n_train_pos").alias("slope"),
        F.regr_intercept("f1", "n_train_pos").alias("intercept"),
    )


def hard_and_easy(table: DataFrame, hard: float = 0.40, easy: float = 0.70) -> DataFrame:
    is_hard, is_easy = F.col("f1") < hard, F.col("f1") >= easy
    return table.agg(
        F.sum(is_hard.cast("long")).alias("n_hard"),
        F.coalesce(F.avg(F.when(is_hard, F.col("n_train_pos"))), F.lit(0.0)).alias("hard_mean_train_pos"),
        F.sum(is_easy.cast("long")).alias("n_easy"),
        F.coalesce(F.avg(F.when(is_easy, F.col("n_train_pos"))), F.lit(0.0)).alias("easy_mean_train_pos"),
    )


def document_errors(preds: DataFrame, docs: DataFrame, version: str = "production", id_col: str = "doc_id") -> DataFrame:
    """Per document: true and predicted labels, false positives and negatives, high-risk misses."""
    y, p = F.col("y"), F.col("pred")
    missed = y * (1 - p)
    counted = preds.groupBy(id_col).agg(
        F.sum(y).alias("n_true_labels"),
        F.sum(p).alias("n_predicted"),
        F.sum((1 - y) * p).alias("false_positives"),
        F.sum(missed).alias("false_negatives"),
        F.sum(F.when(is_high_risk(F.col("clause"), version), missed).otherwise(0)).alias("hr_false_negatives"),
    )
    total = F.col("false_positives") + F.col("false_negatives")
    return counted.withColumn("total_errors", total).join(docs.select(id_col, "word_count"), id_col)


def worst_documents(errors: DataFrame, n: int = 10, id_col: str = "doc_id") -> DataFrame:
    return errors.orderBy(F.col("total_errors").desc(), id_col).limit(n)


def error_summary(errors: DataFrame) -> DataFrame:
    """Perfect documents, documents missing a high-risk clause, and errors against length."""
    histogram = errors.groupBy("word_count").agg(F.count("*").alias("n"))
    median = histogram.agg(F.percentile("word_count", F.lit(0.5), F.col("n"))).scalar()
    long = F.col("word_count") > median
    return errors.agg(
        F.count("*").alias("n_docs"),
        F.sum((F.col("total_errors") == 0).cast("long")).alias("n_perfect"),
        F.sum((F.col("hr_false_negatives") > 0).cast("long")).alias("n_missing_high_risk"),
        F.corr("word_count", "total_errors").alias("corr_length_errors"),
        F.avg(F.when(long, F.col("total_errors"))).alias("mean_errors_long"),
        F.avg(F.when(~long, F.col("total_errors"))).alias("mean_errors_short"),
        F.regr_slope("total_errors", "word_count").alias("slope"),
        F.regr_intercept("total_errors", "word_count").alias("intercept"),
    )


def error_rates(preds: DataFrame) -> DataFrame:
    """Missed positives and false alarms per clause with their shares."""
    y, p = F.col("y"), F.col("pred")
    counted = preds.groupBy("clause").agg(
        F.sum(y).alias("n_pos"),
        F.sum(1 - y).alias("n_neg"),
        F.sum(y * (1 - p)).alias("n_missed"),
        F.sum((1 - y) * p).alias("n_false_alarms"),
    )
    return counted.select(
        "*",
        F.when(F.col("n_pos") > 0, F.col("n_missed") / F.col("n_pos")).alias("missed_share"),
        F.when(F.col("n_neg") > 0, F.col("n_false_alarms") / F.col("n_neg")).alias("false_alarm_share"),
    )


def first_missed(preds: DataFrame, docs: DataFrame, chars: int = 200, id_col: str = "doc_id") -> DataFrame:
    missed = preds.where((F.col("y") == 1) & (F.col("pred") == 0)).groupBy("clause").agg(F.min(id_col).alias(id_col))
    chosen = docs.join(F.broadcast(missed), id_col)  # one row per clause
    return chosen.select("clause", id_col, F.substring("text", 1, chars).alias("excerpt"))


# ---- comparisons -----------------------------------------------------------------------


def compare(a: DataFrame, b: DataFrame, name_a: str = "A", name_b: str = "B", version: str = "production") -> DataFrame:
    """Per clause F1 of two systems (clause, f1), the difference and the winner."""
    left = a.select("clause", F.col("f1").alias("f1_a"))
    right = b.select("clause", F.col("f1").alias("f1_b"))
    joined = left.join(right, "clause", "full_outer").fillna(0.0, ["f1_a", "f1_b"])
    winner = F.when(F.col("f1_b") > F.col("f1_a"), name_b).when(F.col("f1_a") > F.col("f1_b"), name_a).otherwise("tie")
    return joined.select(
        "clause",
        "f1_a",
        "f1_b",
        (F.col("f1_b") - F.col("f1_a")).alias("delta"),
        winner.alias("winner"),
        is_high_risk(F.col("clause"), version).alias("is_high_risk"),
    )


def win_tally(compared: DataFrame) -> DataFrame:
    return compared.groupBy("is_high_risk", "winner").agg(F.count("*").alias("n_clauses"))


def compare_configs(base: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Per clause F1 of a base and of each other configuration with its difference to the base."""
    table = base.select("clause", F.col("f1").alias("base"))
    for name, other in others.items():
        table = table.join(other.select("clause", F.col("f1").alias(name)), "clause", "full_outer")
    table = table.fillna(0.0)
    return table.select("*", *[(F.col(n) - F.col("base")).alias(f"d_{n}") for n in others])


def largest_swings(compared: DataFrame, delta: str, n: int = 5) -> DataFrame:
    return compared.orderBy(F.abs(F.col(delta)).desc(), "clause").limit(n)


def winner_of_three(first: Column, second: Column, third: Column, names: Sequence[str]) -> Column:
    """The first system wins ties against both; the third wins a tie with the second."""
    return (
        F.when(first >= F.greatest(second, third), names[0]).when(third >= second, names[2]).otherwise(names[1])
    )


# ---- leaderboards over metric rows, one per system --------------------------------------


def leaderboard(rows: DataFrame, metric: str = "macro_f1", baseline: float | Column = 0.0) -> DataFrame:
    """Systems ranked by a metric, with the difference to a baseline value.

    The table holds one row per system, so one task ranks it.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.round(F.col(metric), 9).desc_nulls_last(), "model")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("delta", F.col(metric) - baseline)


def champions(rows: DataFrame) -> DataFrame:
    """The best system by macro-F1 and by high-risk F1, one row."""
    return rows.agg(
        F.max_by("model", F.struct(F.round("macro_f1", 9), "model")).alias("macro_champion"),
        F.max("macro_f1").alias("macro_f1"),
        F.max_by("model", F.struct(F.round("hr_f1", 9), "model")).alias("hr_champion"),
        F.max("hr_f1").alias("hr_f1"),
    )


def best_of_family(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family").agg(
        F.max_by("model", F.struct(F.round("macro_f1", 9), "model")).alias("model"), F.max("macro_f1").alias("macro_f1")
    )


def union_metrics(*tables: DataFrame) -> DataFrame:
    """Stored and live metric rows together; columns one side lacks are null."""
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole


def running_best(trials: DataFrame, order: str = "trial", value: str = "score") -> DataFrame:
    """Best value so far over trials in order; one row per trial."""
    window = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.max(value).over(window))


def lift(rows: DataFrame, base: str, ceiling: str) -> DataFrame:
    """Share of the gap between two systems that each system closes, in percent."""
    at = rows.agg(
        F.struct(
            F.max(F.when(F.col("model") == base, F.col("macro_f1"))).alias("base"),
            F.max(F.when(F.col("model") == ceiling, F.col("macro_f1"))).alias("ceiling"),
        )
    ).scalar()
    gap = at["ceiling"] - at["base"]
    captured = F.when(gap != 0, (F.col("macro_f1") - at["base"]) / gap * 100).otherwise(F.lit(0.0))
    return rows.select("model", "macro_f1", (F.col("macro_f1") - at["base"]).alias("delta"), captured.alias("captured_pct"))
