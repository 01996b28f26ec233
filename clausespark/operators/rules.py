"""Rule classifiers: keyword phrases per clause and boolean combinations of text flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark.fixed.keyword_rules import KEYWORD_RULES
from clausespark.fixed.taxonomy import UNFAIR_TERM_LABELS
from clausespark.functions import text as X


def keyword_predictions(
    docs: DataFrame, rules: dict[str, list[str]] = KEYWORD_RULES, id_col: str = "doc_id"
) -> DataFrame:
    """(id, clause, pred): 1 when any phrase of the clause occurs; one pass, no join."""
    lowered = docs.select(id_col, F.lower(F.col("text")).alias("_lowered"))
    hits = [
        F.struct(F.lit(clause).alias("clause"), X.contains_any(F.col("_lowered"), phrases).cast("int").alias("pred"))
        for clause, phrases in rules.items()
    ]
    return lowered.select(id_col, F.inline(F.array(*hits)))


def boolean_predictions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, clause, pred) for the eight unfair-term labels."""
    flags = X.unfair_terms_flags(F.col("text"))
    table = docs.select(id_col, *[c.cast("boolean").alias(n) for n, c in flags.items()])
    has = {n: F.col(n) for n in flags}
    decided = dict(
        zip(
            UNFAIR_TERM_LABELS,
            [
                has["has_not_liable"] | has["has_limitation"] | has["has_disclaimer"],
                has["has_terminate"] & (has["has_any_time"] | has["has_sole_discretion"] | has["has_right_to"]),
                has["has_modify_terms"] | (has["has_right_to"] & has["has_any_time"]),
                has["has_terminate"] & has["has_we_may"] & ~has["has_governing_law"],
                has["has_by_using"] | has["has_agree"],
                has["has_governing_law"],
                has["has_jurisdiction"] & ~has["has_arbitration"],
                has["has_arbitration"],
            ],
        )
    )
    rows = [F.struct(F.lit(n).alias("clause"), c.cast("int").alias("pred")) for n, c in decided.items()]
    return table.select(id_col, F.inline(F.array(*rows)))
