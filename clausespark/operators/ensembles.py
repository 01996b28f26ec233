"""Blending and per-clause routing of two score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark.operators.thresholds import best_threshold


def blend(a: DataFrame, b: DataFrame, alpha: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """alpha * a + (1 - alpha) * b; where one model is missing the other's score stands."""
    both = pair(a, b, id_col)
    mixed = F.lit(alpha) * F.col("prob_a") + F.lit(1 - alpha) * F.col("prob_b")
    return both.select(id_col, "clause", F.coalesce(mixed, "prob_a", "prob_b", F.lit(0.0)).alias("prob"))


def pair(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    left = a.select(id_col, "clause", F.col("prob").alias("prob_a"))
    right = b.select(id_col, "clause", F.col("prob").alias("prob_b"))
    return left.join(right, [id_col, "clause"], "full_outer")


def blend_sweep(a: DataFrame, b: DataFrame, alphas: Sequence[float], id_col: str = "doc_id") -> DataFrame:
    """(alpha, id, clause, prob) for every alpha, from one join."""
    both = pair(a, b, id_col).withColumn("alpha", F.explode(F.array(*[F.lit(float(x)) for x in alphas])))
    mixed = F.col("alpha") * F.col("prob_a") + (1 - F.col("alpha")) * F.col("prob_b")
    return both.select("alpha", id_col, "clause", F.coalesce(mixed, "prob_a", "prob_b", F.lit(0.0)).alias("prob"))


def route(
    validation: dict[str, DataFrame], default: str, preferred: str, min_positives: int = 2
) -> DataFrame:
    """(clause, config, thr): per clause the configuration with the higher validation F1.

    ``preferred`` wins ties; clauses with too few validation positives take ``default`` at 0.5.
    """
    table = None
    for name, scores in validation.items():
        best = best_threshold(scores).select("clause", F.lit(name).alias("config"), "thr", "f1")
        table = best if table is None else table.unionByName(best)
    positives = next(iter(validation.values())).groupBy("clause").agg(F.sum("y").alias("n_pos"))
    order = F.struct(F.col("f1"), (F.col("config") == preferred).alias("first"), F.col("config"))
    chosen = table.groupBy("clause").agg(F.max_by(F.struct("config", "thr"), order).alias("c"))
    joined = chosen.join(positives, "clause")
    few = F.col("n_pos") < min_positives
    return joined.select(
        "clause",
        F.when(few, F.lit(default)).otherwise(F.col("c.config")).alias("config"),
        F.when(few, F.lit(0.5)).otherwise(F.col("c.thr")).alias("thr"),
    )


def routed_scores(tables: dict[str, DataFrame], routes: DataFrame) -> DataFrame:
    """The scores of each clause's chosen configuration, with ``thr`` and ``pred``."""
    whole = None
    for name, scores in tables.items():
        part = scores.withColumn("config", F.lit(name))
        whole = part if whole is None else whole.unionByName(part)
    joined = whole.join(F.broadcast(routes), ["clause", "config"])  # one route per clause
    return joined.withColumn("pred", (F.col("prob") >= F.col("thr")).cast("int"))


def oracle_route(f1_tables: dict[str, DataFrame]) -> DataFrame:
    """Diagnostic upper bound: the higher test F1 per clause, ties to the first configuration."""
    names = list(f1_tables)
    table = None
    for i, (name, f1) in enumerate(f1_tables.items()):
        part = f1.select("clause", F.lit(name).alias("config"), F.lit(-i).alias("o"), "f1")
        table = part if table is None else table.unionByName(part)
    best = table.groupBy("clause").agg(F.max_by("config", F.struct("f1", "o")).alias("config"), F.max("f1").alias("f1"))
    return best.where(F.col("config").isin(names))
