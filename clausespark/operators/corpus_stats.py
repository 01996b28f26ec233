"""Corpus statistics over documents and long (doc_id, clause, y) labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clausespark.operators.taxonomy import risk_level
from clausespark.session import cut_lineage


def describe(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of whole-number measures.

    Works on the histogram of each measure, whose size is the number of distinct values.
    """
    long = df.unpivot([], [F.col(m).cast("long").alias(m) for m in measures], "measure", "value")
    histogram = long.groupBy("measure", "value").agg(F.count("*").alias("n"))
    v, n = F.col("value"), F.col("n")
    quartiles = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), n)
    sums = histogram.groupBy("measure").agg(
        F.sum(n).alias("count"),
        F.sum(v * n).cast("double").alias("_s1"),
        F.sum(v.cast("double") * v * n).alias("_s2"),
        F.min(v).alias("min"),
        quartiles.alias("_q"),
        F.max(v).alias("max"),
    )
    spread = (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("count")) / (F.col("count") - 1)
    return sums.select(
        "measure",
        "count",
        (F.col("_s1") / F.col("count")).alias("mean"),
        F.when(F.col("count") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("std"),
        "min",
        *[F.get("_q", i).alias(name) for i, name in enumerate(["p25", "p50", "p75"])],
        "max",
    )


def prevalence(labels: DataFrame) -> DataFrame:
    """Positive rate and count per clause, most frequent first."""
    rates = labels.groupBy("clause").agg(F.avg("y").alias("rate"), F.sum("y").alias("n_positive"))
    return rates.orderBy(F.col("rate").desc(), "clause")


def prevalence_by_risk(labels: DataFrame, version: str = "production") -> DataFrame:
    """Prevalence of the HIGH and MEDIUM clauses with the number of documents."""
    rates = labels.groupBy("clause").agg(
        F.avg("y").alias("rate"), F.sum("y").alias("n_positive"), F.count("*").alias("n_docs")
    )
    return rates.withColumn("risk_level", risk_level(F.col("clause"), version)).where(
        F.col("risk_level").isin("HIGH", "MEDIUM")
    )


def label_counts(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return labels.groupBy(id_col).agg(F.sum("y").cast("long").alias("n_labels"))


def label_count_distribution(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = label_counts(labels, id_col)
    return counts.groupBy("n_labels").agg(F.count("*").alias("n_docs")).orderBy("n_labels")


def clauses_per_document(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Description of the label count per document, with its mode (smallest on ties)."""
    counts = label_counts(labels, id_col)
    histogram = counts.groupBy("n_labels").agg(F.count("*").alias("n"))
    mode = histogram.agg(F.max_by("n_labels", F.struct("n", -F.col("n_labels"))))
    return describe(counts, ["n_labels"]).withColumn("mode", mode.scalar())


def label_sets(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Distinct label sets (the empty one too) with their document counts."""
    positive = F.collect_set(F.when(F.col("y") == 1, F.col("clause")))
    sets = labels.groupBy(id_col).agg(F.sort_array(positive).alias("labels"))
    return sets.groupBy("labels").agg(F.count("*").alias("n"))


def set_cooccurrence(sets: DataFrame) -> DataFrame:
    left = sets.select("labels", "n", F.explode("labels").alias("clause_a"))
    both = left.select("clause_a", F.explode("labels").alias("clause_b"), "n")
    return both.groupBy("clause_a", "clause_b").agg(F.sum("n").alias("n_docs"))


def cooccurrence(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents carrying both labels, for every ordered pair including the diagonal.

    Documents are first folded into distinct label sets, so pairs arise per set, not per document.
    """
    return set_cooccurrence(label_sets(labels, id_col))


def label_correlation(labels: DataFrame, top: int = 12, id_col: str = "doc_id") -> DataFrame:
    """Pearson correlation among the most frequent labels, from label-set counts.

    The sets are written out: the counts, the choice of labels and the pairs all read them.
    """
    sets = cut_lineage(label_sets(labels, id_col))
    pairs_counted = set_cooccurrence(sets)
    n = sets.agg(F.sum("n")).scalar()
    diagonal = pairs_counted.where(F.col("clause_a") == F.col("clause_b"))
    kept = diagonal.select(F.col("clause_a").alias("clause"), F.col("n_docs").alias("s"))
    kept = kept.orderBy(F.col("s").desc(), "clause").limit(top)
    listed = kept.agg(F.collect_list(F.struct("clause", "s")).alias("kept"))  # one row of ``top`` entries
    pairs = listed.select("kept", F.inline("kept").alias("clause_a", "sa")).select(
        "clause_a", "sa", F.inline("kept").alias("clause_b", "sb")
    )
    counted = pairs.join(pairs_counted, ["clause_a", "clause_b"], "left").fillna(0, ["n_docs"])
    spread = F.sqrt((n * F.col("sa") - F.col("sa") ** 2) * (n * F.col("sb") - F.col("sb") ** 2))
    return counted.select(
        "clause_a",
        "clause_b",
        F.when(spread > 0, (n * F.col("n_docs") - F.col("sa") * F.col("sb")) / spread).alias("corr"),
    )


def split_distribution(labels: DataFrame, splits: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """Positives per label and split with totals, plus documents with any and with no label.

    The label rows are written out: both counts read them.
    """
    labels = cut_lineage(labels.select(id_col, "split", "clause", "y"))

    def per_split(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
        counted = df.groupBy(*keys).agg(
            *[F.sum(F.when(F.col("split") == s, value).otherwise(0)).cast("long").alias(s) for s in splits],
            F.sum(value).cast("long").alias("total"),
        )
        return counted

    by_label = per_split(labels, ["clause"], F.col("y"))
    docs = labels.groupBy(id_col, "split").agg(F.max("y").alias("any"))
    flagged = docs.withColumn("clause", F.when(F.col("any") == 1, "ANY LABEL").otherwise("NO LABEL"))
    return by_label.unionByName(per_split(flagged, ["clause"], F.lit(1)))


def positives_rollup(labels: DataFrame) -> DataFrame:
    """Positives by clause and split with subtotals and the grand total."""
    return labels.rollup("clause", "split").agg(F.sum("y").cast("long").alias("n_positive"))


def overview(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: sizes, imbalance, multi-label share and word-count statistics.

    ``docs`` carries ``text_len`` and ``n_words``.
    """
    counts = label_counts(labels, id_col)
    joined = docs.join(counts, id_col, "left").fillna(0, ["n_labels"])
    histogram = docs.groupBy("n_words").agg(F.count("*").alias("n"))
    median = histogram.agg(F.percentile("n_words", F.lit(0.5), F.col("n")))
    any_label = (F.col("n_labels") > 0).cast("long")
    one = joined.agg(
        F.count("*").alias("n_docs"),
        F.sum(any_label).alias("n_with_label"),
        F.sum(1 - any_label).alias("n_without_label"),
        F.sum((F.col("n_labels") > 1).cast("long")).alias("n_multi_label"),
        F.avg("text_len").alias("mean_chars"),
        F.avg("n_words").alias("mean_words"),
        F.max("n_words").alias("max_words"),
        F.min("n_words").alias("min_words"),
    )
    return one.select(
        "*",
        (F.col("n_without_label") / F.greatest(F.col("n_with_label"), F.lit(1))).alias("imbalance_ratio"),
        (F.col("n_multi_label") / F.col("n_docs")).alias("multi_label_share"),
        median.scalar().alias("median_words"),
    )


def length_by_group(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Count, mean and median of a whole-number measure per group, from its histogram."""
    histogram = df.groupBy(*keys, measure).agg(F.count("*").alias("n"))
    return histogram.groupBy(*keys).agg(
        F.sum("n").alias("n_docs"),
        (F.sum(F.col(measure) * F.col("n")) / F.sum("n")).alias("mean_words"),
        F.percentile(measure, F.lit(0.5), F.col("n")).alias("median_words"),
    )


def histogram(df: DataFrame, measure: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and the largest value, the last one closed."""
    ends = df.agg(F.struct(F.min(measure).alias("lo"), F.max(measure).alias("hi")))
    lo, hi = ends.scalar()["lo"], ends.scalar()["hi"]
    width = (hi - lo) / F.lit(float(bins))
    position = F.floor((F.col(measure) - lo) * bins / F.greatest(hi - lo, F.lit(1)))
    at = F.least(position, F.lit(bins - 1)).cast("int")
    counts = df.groupBy(at.alias("bin")).agg(F.count("*").alias("n_docs"))
    return counts.select("bin", (lo + width * F.col("bin")).alias("bin_start"), "n_docs")


def discriminative_power(df: DataFrame, flags: Sequence[str], positive: str = "positive") -> DataFrame:
    """Share of each flag among negatives and positives in percent, their ratio and a verdict."""
    shares = df.agg(
        *[F.avg(F.when(F.col(positive) == 0, F.col(f))).alias(f"n_{f}") for f in flags],
        *[F.avg(F.when(F.col(positive) == 1, F.col(f))).alias(f"p_{f}") for f in flags],
    )
    rows = shares.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("feature"),
                        (F.col(f"n_{f}") * 100).alias("negative_pct"),
                        (F.col(f"p_{f}") * 100).alias("positive_pct"),
                    )
                    for f in flags
                ]
            )
        )
    )
    ratio = F.col("positive_pct") / F.greatest(F.col("negative_pct"), F.lit(0.1))
    return rows.withColumn("ratio", ratio).withColumn(
        "useful", F.when((F.col("ratio") > 2.0) | (F.col("ratio") < 0.5), "YES").otherwise("marginal")
    )


def first_examples(labels: DataFrame, docs: DataFrame, order: str = "doc_id", chars: int = 200) -> DataFrame:
    """The first positive document per clause and the beginning of its text."""
    first = labels.where(F.col("y") == 1).groupBy("clause").agg(F.min(order).alias(order))
    chosen = docs.join(F.broadcast(first), order)
    return chosen.select("clause", order, F.substring("text", 1, chars).alias("excerpt"))


def rarity_summary(labels: DataFrame, rare: float = 0.10, frequent: float = 0.30) -> DataFrame:
    """One row over clauses: positives min, max, mean; rare and frequent clause counts."""
    per_clause = labels.groupBy("clause").agg(F.sum("y").alias("n"), F.avg("y").alias("rate"))
    return per_clause.agg(
        F.min("n").alias("min_positives"),
        F.max("n").alias("max_positives"),
        F.avg("n").alias("mean_positives"),
        F.sum((F.col("rate") < rare).cast("long")).alias("n_rare"),
        F.sum((F.col("rate") >= frequent).cast("long")).alias("n_frequent"),
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows per group; ``k`` is small, so each task sends on at most ``k`` per group."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("position", at).where(F.col("position") <= k)
