"""Multi-label metrics over (doc_id, clause, y, pred) and (doc_id, clause, prob, y) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark.fixed import prompts
from clausespark.operators.ordering import exact_percentiles
from clausespark.operators.taxonomy import is_high_risk, risk_level
from clausespark.operators.thresholds import curve, f1_of


def confusion(preds: DataFrame, keys: Sequence[str] = ("clause",)) -> DataFrame:
    y, p = F.col("y"), F.col("pred")
    return preds.groupBy(*keys).agg(
        F.sum(y * p).cast("long").alias("tp"),
        F.sum((1 - y) * p).cast("long").alias("fp"),
        F.sum(y * (1 - p)).cast("long").alias("fn"),
        F.sum((1 - y) * (1 - p)).cast("long").alias("tn"),
    )


def scores_of(counts: DataFrame) -> DataFrame:
    """Add precision, recall and F1; an undefined ratio is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
        (tp + fn).alias("n_positive"),
    )


def per_clause(preds: DataFrame, active_only: bool = True) -> DataFrame:
    """Precision, recall, F1 and support; clauses without positives are left out when active only."""
    scored = scores_of(confusion(preds))
    return scored.where(F.col("n_positive") > 0) if active_only else scored


def summary(clause_metrics: DataFrame, version: str = "production", keys: Sequence[str] = ()) -> DataFrame:
    """Macro, micro and high-risk figures from per-clause rows, one row per group of ``keys``."""
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    high = F.avg(F.when(is_high_risk(F.col("clause"), version) & (F.col("n_positive") > 0), F.col("f1")))
    return clause_metrics.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        f1_of(tp, fp, fn).alias("micro_f1"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("micro_precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0)).alias("micro_recall"),
        F.coalesce(high, F.lit(0.0)).alias("hr_f1"),
        F.count("*").alias("n_clauses"),
    )


def by_risk_level(clause_metrics: DataFrame, version: str = "production") -> DataFrame:
    levelled = clause_metrics.withColumn("risk_level", risk_level(F.col("clause"), version))
    return levelled.groupBy("risk_level").agg(F.avg("f1").alias("mean_f1"), F.count("*").alias("n_clauses"))


def auc(points: DataFrame) -> DataFrame:
    """ROC area per two-class clause from its curve; equal scores count half."""
    n_neg = F.col("n_all") - F.col("n_pos")
    below = n_neg - (F.col("flagged") - F.col("tp"))
    own = F.col("n") - F.col("pos")
    won = F.col("pos") * (below + own / F.lit(2.0))
    two = points.where((F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_all")))
    return two.groupBy("clause").agg(
        (F.sum(won) / (F.max("n_pos").cast("double") * F.max(n_neg))).alias("auc")
    )


def evaluate(preds: DataFrame, version: str = "production") -> DataFrame:
    """The production record: macro, micro, HR-F1 and macro AUC over active clauses, one row."""
    areas = auc(curve(preds.select("clause", "prob", "y")))
    one = summary(per_clause(preds), version)
    return one.withColumn("macro_auc", areas.agg(F.avg("auc")).scalar())


def timing_summary(timings: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean and exact median of timings, and the number that fits into a thousand units."""
    keyed = timings.withColumn("_all", F.lit(0))
    groups = [*keys, "_all"]
    sums = keyed.groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.count(value) * 1000 / F.sum(value)).alias("per_thousand")
    )
    medians = exact_percentiles(keyed, groups, value, {"median": 0.5})
    return sums.join(medians, groups).select(*keys, "n", "mean", "median", "per_thousand")


def token_cost(tokens: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Price of (input_tokens, output_tokens) rows and of a thousand such rows."""
    price_in = F.sum("input_tokens") / 1e6 * prompts.INPUT_PRICE_PER_MILLION
    price_out = F.sum("output_tokens") / 1e6 * prompts.OUTPUT_PRICE_PER_MILLION
    return tokens.groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        (price_in + price_out).alias("cost"),
        ((price_in + price_out) / F.count("*") * 1000).alias("cost_per_1k"),
    )
