"""Per-clause decision thresholds over (doc_id, clause, prob, y) scores.

Grid policies never join scores with a grid: each score is placed between two grid values, counted,
and the small table of counts is summed upwards. Curve policies use exact running totals. Policies
that look at the labels they are judged on are marked diagnostic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.operators.ordering import global_rank, running_totals
from clausespark.operators.taxonomy import is_high_risk

# --- fixed values: threshold grids and prior scales -------------------------------------
SCUT_GRID = [float(t) for t in np.arange(0.05, 0.95, 0.02)]
GLOBAL_GRID = [float(t) for t in np.arange(0.20, 0.55, 0.025)]
VALIDATION_SCALES = [0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.5, 2.0]
DIAGNOSTIC_SCALES = [0.3, 0.5, 0.7, 0.9, 1.0, 1.1, 1.3, 1.5, 2.0, 3.0]
DEFAULT_THRESHOLD = 0.5
RARE_RATE = 0.10
RECALL_FLOOR = 0.80


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))


def class_prior(train: DataFrame) -> DataFrame:
    """Threshold = positive rate in the training labels."""
    return train.groupBy("clause").agg(F.avg("y").alias("thr"))


def apply_thresholds(scores: DataFrame, thresholds: DataFrame, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Add ``thr`` and ``pred``; a clause without a threshold uses the default."""
    small = F.broadcast(thresholds.select("clause", "thr"))  # one row per clause
    joined = scores.join(small, "clause", "left").withColumn("thr", F.coalesce("thr", F.lit(default)))
    return joined.withColumn("pred", (F.col("prob") >= F.col("thr")).cast("int"))


def fixed_threshold(scores: DataFrame, value: float = DEFAULT_THRESHOLD) -> DataFrame:
    return scores.withColumn("thr", F.lit(value)).withColumn("pred", (F.col("prob") >= value).cast("int"))


# ---- counts at given thresholds --------------------------------------------------------


def _upward_counts(placed: DataFrame, thresholds: Column, n: int) -> DataFrame:
    """(clause, pos, thr, tp, fp, fn) from scores carrying ``_at``, the thresholds they reach."""
    cells = placed.groupBy("clause", "_at").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    per_clause = cells.groupBy("clause").agg(
        F.collect_list(F.struct("_at", "pos", "n")).alias("cells"), F.sum("pos").alias("n_pos")
    )  # at most n + 1 cells per clause

    def total(field: str, reached: Column) -> Column:
        above = F.filter("cells", lambda c: c["_at"] > reached)
        return F.aggregate(above, F.lit(0).cast("long"), lambda acc, c: acc + c[field])

    expanded = per_clause.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    counted = expanded.select(
        "clause",
        "pos",
        F.get(thresholds, F.col("pos")).alias("thr"),
        total("pos", F.col("pos")).alias("tp"),
        total("n", F.col("pos")).alias("_flagged"),
        "n_pos",
    )
    return counted.select(
        "clause", "pos", "thr", "tp", (F.col("_flagged") - F.col("tp")).alias("fp"), (F.col("n_pos") - F.col("tp")).alias("fn")
    )


def counts_on_grid(scores: DataFrame, grid: Sequence[float]) -> DataFrame:
    """Confusion counts of every clause at every value of an ascending grid."""
    at = F.lit(0)
    for value in grid:
        at = at + (F.col("prob") >= value).cast("int")
    values = F.array(*[F.lit(float(v)) for v in grid])
    return _upward_counts(scores.select("clause", "y", at.alias("_at")), values, len(grid))


def counts_on_scaled_prior(scores: DataFrame, rates: DataFrame, scales: Sequence[float]) -> DataFrame:
    """Confusion counts at ``scale * rate`` of each clause; adds ``scale``."""
    small = F.broadcast(rates.select("clause", F.col("thr").alias("_rate")))
    at = F.lit(0)
    for scale in scales:
        at = at + (F.col("prob") >= F.lit(float(scale)) * F.col("_rate")).cast("int")
    placed = scores.join(small, "clause").select("clause", "y", at.alias("_at"))
    values = F.array(*[F.lit(float(s)) for s in scales])
    return _upward_counts(placed, values, len(scales)).withColumnRenamed("thr", "scale")


def _best_on_grid(counts: DataFrame, start: Column | None) -> DataFrame:
    """The threshold of the highest F1; on ties the start value, then the lowest grid value."""
    scored = counts.withColumn("f1", f1_of(F.col("tp"), F.col("fp"), F.col("fn")))
    order = F.col("pos")
    if start is not None:
        order = F.when(start, -1).otherwise(F.col("pos"))
    best = scored.groupBy("clause").agg(
        F.max_by(F.struct("thr", "f1"), F.struct(F.col("f1"), (-order).alias("o"))).alias("b")
    )
    return best.select("clause", F.col("b.thr").alias("thr"), F.col("b.f1").alias("f1"))


def scut(scores: DataFrame, grid: Sequence[float] = SCUT_GRID) -> DataFrame:
    """Best F1 on out-of-fold scores; 0.5 stands unless a grid value is strictly better."""
    values = sorted([*grid, DEFAULT_THRESHOLD])
    return _best_on_grid(counts_on_grid(scores, values), F.col("thr") == DEFAULT_THRESHOLD)


def best_threshold(scores: DataFrame, grid: Sequence[float] = SCUT_GRID) -> DataFrame:
    """Diagnostic upper bound: best F1 on the evaluated labels, 0.5 where nothing is found."""
    best = _best_on_grid(counts_on_grid(scores, grid), None)
    thr = F.when(F.col("f1") > 0, F.col("thr")).otherwise(F.lit(DEFAULT_THRESHOLD))
    return best.select("clause", thr.alias("thr"), "f1")


# ---- share-based policies --------------------------------------------------------------


def pcut(scores: DataFrame, rates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ``max(1, round(rate * n))`` highest scores of each clause are positive.

    Equal scores are taken in id order. The rank is global, so no task holds a whole clause.
    """
    sizes = scores.groupBy("clause").agg(F.count("*").alias("_n"))
    cuts = rates.join(sizes, "clause").select(
        "clause",
        F.least(F.greatest(F.lit(1), F.bround(F.col("thr") * F.col("_n")).cast("long")), F.col("_n")).alias("_k"),
    )
    ranked = global_rank(scores, ["clause"], [F.col("prob").desc(), F.col(id_col)], "_rank")
    joined = ranked.join(F.broadcast(cuts), "clause", "left")
    flagged = F.coalesce((F.col("_rank") <= F.col("_k")).cast("int"), F.lit(0))
    return joined.withColumn("pred", flagged).drop("_rank", "_k")


def adaptive(
    scores: DataFrame, rates: DataFrame, frequent: DataFrame, rare: float = RARE_RATE, id_col: str = "doc_id"
) -> DataFrame:
    """Share-based cut for rare clauses, the given thresholds for the others."""
    by_share = pcut(scores, rates, id_col).withColumnRenamed("pred", "_share")
    both = apply_thresholds(by_share, frequent).drop("thr")
    named = both.join(F.broadcast(rates.select("clause", F.col("thr").alias("_rate"))), "clause", "left")
    chosen = F.when(F.col("_rate") < rare, F.col("_share")).otherwise(F.col("pred"))
    return named.withColumn("pred", chosen).drop("_share", "_rate")


def scaled_prior(rates: DataFrame, picked: DataFrame) -> DataFrame:
    """Every rate times the scale in the one-row table ``picked``."""
    return rates.join(F.broadcast(picked)).select("clause", "scale", (F.col("thr") * F.col("scale")).alias("thr"))


def scale_sweep(scores: DataFrame, rates: DataFrame, scales: Sequence[float]) -> DataFrame:
    """(scale, macro_f1, hr_f1) over clauses with positives. On test labels it is diagnostic."""
    counts = counts_on_scaled_prior(scores, rates, scales)
    f1 = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    active = counts.where(F.col("tp") + F.col("fn") > 0).withColumn("f1", f1)
    return active.groupBy("scale").agg(
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.avg(F.when(is_high_risk(F.col("clause")), F.col("f1"))), F.lit(0.0)).alias("hr_f1"),
    )


def pick_scale(sweep: DataFrame) -> DataFrame:
    """The scale of the highest macro-F1 (to nine places, as sums have no fixed order), the smallest on ties: one row."""
    return sweep.agg(F.max_by("scale", F.struct(F.round("macro_f1", 9), -F.col("scale"))).alias("scale"))


def global_sweep(scores: DataFrame, grid: Sequence[float] = GLOBAL_GRID) -> DataFrame:
    """Macro F1, HR-F1, recall and precision over all clauses at one threshold for all."""
    counts = counts_on_grid(scores, grid)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    high = is_high_risk(F.col("clause"))
    f1 = f1_of(tp, fp, fn)
    return counts.groupBy("thr").agg(
        F.avg(f1).alias("macro_f1"),
        F.coalesce(F.avg(F.when(high, f1)), F.lit(0.0)).alias("hr_f1"),
        F.avg(F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))).alias("recall"),
        F.avg(F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))).alias("precision"),
    )


# ---- curve-based policies --------------------------------------------------------------


def curve(scores: DataFrame) -> DataFrame:
    """(clause, prob, pos, n, tp, flagged, n_pos, n_all) per distinct score, from the highest."""
    points = scores.groupBy("clause", "prob").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    summed = running_totals(points, ["clause"], [F.col("prob").desc()], {"tp": "pos", "flagged": "n"})
    totals = summed.groupBy("clause").agg(F.max("tp").alias("n_pos"), F.max("flagged").alias("n_all"))
    return summed.join(F.broadcast(totals), "clause")


def roc_youden(points: DataFrame) -> DataFrame:
    """First maximum of true minus false positive rate; 0.5 for a clause with one class.

    Where no score beats predicting nothing the threshold is infinite.
    """
    n_neg = F.col("n_all") - F.col("n_pos")
    gain = F.col("tp") / F.col("n_pos") - (F.col("flagged") - F.col("tp")) / n_neg
    two = (F.col("n_pos") > 0) & (n_neg > 0)
    scored = points.withColumn("_gain", F.when(two, gain))
    best = scored.groupBy("clause").agg(
        F.max_by("prob", F.struct("_gain", "prob")).alias("thr"), F.max("_gain").alias("gain")
    )
    thr = F.when(F.col("gain").isNull(), F.lit(DEFAULT_THRESHOLD)).when(F.col("gain") > 0, F.col("thr"))
    return best.select("clause", thr.otherwise(F.lit(float("inf"))).alias("thr"))


def pr_youden(points: DataFrame) -> DataFrame:
    """Lowest threshold that maximises precision + recall - 1, for clauses with positives."""
    quality = F.col("tp") / F.col("flagged") + F.col("tp") / F.col("n_pos") - 1
    scored = points.where(F.col("n_pos") > 0).withColumn("_quality", quality)
    return scored.groupBy("clause").agg(
        F.max_by("prob", F.struct(F.col("_quality"), -F.col("prob"))).alias("thr")
    )


def recall_floor(points: DataFrame, floor: float = RECALL_FLOOR, version: str = "production") -> DataFrame:
    """High-risk clauses: best F1 among thresholds with enough recall, 0.5 where there is none."""
    precision, recall = F.col("tp") / F.col("flagged"), F.col("tp") / F.col("n_pos")
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    high = points.where(is_high_risk(F.col("clause"), version) & (F.col("n_pos") > 0))
    scored = high.withColumn("_f1", F.when((recall >= floor) & (f1 > 0), f1))
    best = scored.groupBy("clause").agg(
        F.max_by("prob", F.when(F.col("_f1").isNotNull(), F.struct(F.col("_f1"), -F.col("prob")))).alias("thr")
    )
    return best.select("clause", F.coalesce("thr", F.lit(DEFAULT_THRESHOLD)).alias("thr"))


def override(base: DataFrame, preferred: DataFrame) -> DataFrame:
    """Thresholds of ``preferred`` where it has them, of ``base`` otherwise."""
    other = preferred.select("clause", F.col("thr").alias("_preferred"))
    joined = base.join(other, "clause", "full_outer")
    return joined.select("clause", F.coalesce("_preferred", "thr").alias("thr"))
