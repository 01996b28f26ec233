"""Document records, risk bands, review tables and explanations of per-clause models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.fixed.patterns import EXPECTED_PHRASES
from clausespark.fixed.taxonomy import CLAUSE_DESCRIPTIONS, RISK_SCORE_CAP, RISK_VERSIONS, RISK_WEIGHTS
from clausespark.functions import text as X
from clausespark.operators.corpus_stats import top_per_group
from clausespark.operators.ordering import exact_percentiles
from clausespark.operators.taxonomy import clause_order, risk_level
from clausespark.session import cut_lineage



def clause_results(
    preds: DataFrame, version: str = "production", absent: str | None = None, carry: Sequence[str] = ()
) -> DataFrame:
    """Rounded probability and threshold, detection and risk level per document and clause.

    Detection was decided on unrounded values. With ``absent`` a clause not detected gets that
    level instead of its own.
    """
    level = risk_level(F.col("clause"), version, "STANDARD")
    if absent is not None:
        level = F.when(F.col("pred") == 1, level).otherwise(absent)
    return preds.select(
        "doc_id",
        "clause",
        clause_order(F.col("clause")).alias("ord"),
        F.round("prob", 4).alias("probability"),
        (F.col("pred") == 1).alias("detected"),
        F.round("thr", 4).alias("threshold"),
        level.alias("risk_level"),
        *carry,
    )


def _band(detected_level: Column) -> Column:
    """HIGH if any detected clause is HIGH, else MEDIUM if any is, else LOW."""
    at = F.max(detected_level)
    return F.when(at == 3, "HIGH").when(at == 2, "MEDIUM").otherwise("LOW")


def records(preds: DataFrame, docs: DataFrame | None = None, version: str = "production") -> DataFrame:
    """One nested record per document; at most one entry per clause is collected.

    Without ``docs`` the predictions carry a ``word_count``, and no text is read again.
    """
    carried = ["word_count"] if docs is None else []
    results = clause_results(preds, version, carry=carried)
    level = F.when(F.col("detected"), F.when(F.col("risk_level") == "HIGH", 3).when(F.col("risk_level") == "MEDIUM", 2))
    entry = F.struct("ord", "clause", F.struct("probability", "detected", "threshold", "risk_level").alias("v"))
    high = F.when(F.col("detected") & (F.col("risk_level") == "HIGH"), F.struct("ord", "clause"))
    grouped = results.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(entry)).alias("_entries"),
        F.sum(F.col("detected").cast("int")).alias("detected_count"),
        F.sort_array(F.collect_list(high)).alias("_high"),
        _band(level).alias("overall_risk"),
        *[F.max(c).alias(c) for c in carried],
    )
    named = grouped.select(
        "doc_id",
        F.map_from_entries(F.transform("_entries", lambda e: F.struct(e["clause"], e["v"]))).alias("clauses"),
        "detected_count",
        F.transform("_high", lambda e: e["clause"]).alias("high_risk_detected"),
        "overall_risk",
        *carried,
    )
    if docs is None:
        return named
    return named.join(docs.select("doc_id", X.word_count(F.col("text")).alias("word_count")), "doc_id")


def risk_score(preds: DataFrame, version: str = "production") -> DataFrame:
    """Weighted count of detected clauses per document, capped."""
    level = risk_level(F.col("clause"), version)
    weight = F.lit(RISK_WEIGHTS["LOW"])
    for name in ("HIGH", "MEDIUM"):
        weight = F.when(level == name, RISK_WEIGHTS[name]).otherwise(weight)
    total = F.sum(F.when(F.col("pred") == 1, weight).otherwise(0))
    return preds.groupBy("doc_id").agg(F.least(F.lit(RISK_SCORE_CAP), total).alias("risk_score"))


def description(clause: Column) -> Column:
    pairs = [F.lit(part) for item in CLAUSE_DESCRIPTIONS.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), clause), F.lit(""))


def absent_high_risk(preds: DataFrame, docs: DataFrame, version: str = "production") -> DataFrame:
    """High-risk clauses a document was not found to contain, also those without a model."""
    high = F.array(*[F.lit(c) for c in RISK_VERSIONS[version]["HIGH"]])
    expected = docs.select("doc_id", F.explode(high).alias("clause"))
    found = preds.where(F.col("pred") == 1).select("doc_id", "clause")
    missing = expected.join(found, ["doc_id", "clause"], "left_anti")
    return missing.withColumn("description", description(F.col("clause")))


def review_table(results: DataFrame, section: str) -> DataFrame:
    """The rows of one screen section: all HIGH, detected MEDIUM, or other detected clauses."""
    level, found = F.col("risk_level"), F.col("detected")
    wanted = {
        "high": level == "HIGH",
        "medium": (level == "MEDIUM") & found,
        "other": ~level.isin("HIGH", "MEDIUM") & found,
    }[section]
    return results.where(wanted).withColumn("description", description(F.col("clause")))


# ---- explanations: (clause, term, weight) rows of at most one row per vocabulary term ----


def long_weights(table: DataFrame, clauses: Sequence[str]) -> DataFrame:
    """(term, w0..wk) to (clause, term, weight)."""
    rows = [F.struct(F.lit(c).alias("clause"), F.col(f"w{i}").alias("weight")) for i, c in enumerate(clauses)]
    return table.select("term", F.inline(F.array(*rows)))


def top_importances(weights: DataFrame, k: int = 20) -> DataFrame:
    positive = weights.where(F.col("weight") > 0)
    return top_per_group(positive, ["clause"], [F.col("weight").desc(), F.col("term")], k)


def top_signed(weights: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most positive and most negative terms per clause, of their own sign only."""
    up = top_per_group(weights.where("weight > 0"), ["clause"], [F.col("weight").desc(), F.col("term")], k)
    down = top_per_group(weights.where("weight < 0"), ["clause"], [F.col("weight"), F.col("term")], k)
    return up.withColumn("side", F.lit("positive")).unionByName(down.withColumn("side", F.lit("negative")))


def overlap(a: DataFrame, b: DataFrame, shown: int = 10) -> DataFrame:
    """Shared terms of two per-clause term lists, their Jaccard ratio and the first shared terms."""
    left = a.groupBy("clause").agg(F.collect_set("term").alias("a"))
    right = b.groupBy("clause").agg(F.collect_set("term").alias("b"))
    joined = left.join(right, "clause", "full_outer")
    empty = F.array().cast("array<string>")
    both = joined.select("clause", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    shared = F.array_intersect("a", "b")
    return both.select(
        "clause",
        F.size("a").alias("n_a"),
        F.size("b").alias("n_b"),
        F.size(shared).alias("n_shared"),
        F.round(F.size(shared) / F.greatest(F.lit(1), F.size(F.array_union("a", "b"))), 3).alias("ratio"),
        F.slice(F.sort_array(shared), 1, shown).alias("shared"),
    )


def mean_absolute(weights: DataFrame, k: int = 30) -> DataFrame:
    """Terms with the largest mean absolute weight over clauses."""
    mean = weights.groupBy("term").agg(F.avg(F.abs("weight")).alias("mean_abs"))
    return mean.orderBy(F.col("mean_abs").desc(), "term").limit(k)


def position_analysis(
    docs: DataFrame, labels: DataFrame, terms: dict[str, Sequence[str]], max_docs: int | None = None
) -> DataFrame:
    """Where each clause's terms first occur in its positive documents.

    Median position in percent and share of positions beyond the middle, one decimal each. All
    positive documents count unless ``max_docs`` names how many to take, in id order. The positive
    label rows and the positions are written out, as each is read twice.
    """
    positive = labels.where(F.col("y") == 1).where(F.col("clause").isin(list(terms))).select("doc_id", "clause")
    if max_docs is not None:
        positive = top_per_group(positive, ["clause"], [F.col("doc_id")], max_docs).drop("position")
    positive = cut_lineage(positive)
    distinct = sorted({t for listed in terms.values() for t in listed})
    kept = docs.join(positive.select("doc_id").distinct(), "doc_id", "left_semi")
    padded = kept.select("doc_id", X.padded_words(F.col("text")).alias("padded"))  # once for all terms
    place = lambda t: F.struct(t.alias("term"), X.first_position_in(F.col("padded"), t).alias("position"))
    listed = F.array(*map(F.lit, distinct)).cast("array<string>")
    found = padded.select("doc_id", F.inline(F.transform(listed, place))).where(F.col("position").isNotNull())
    wanted = docs.sparkSession.createDataFrame(
        [(c, t) for c, listed in terms.items() for t in listed], "clause string, term string"
    )
    placed = found.join(F.broadcast(wanted), "term").join(positive, ["doc_id", "clause"])
    placed = cut_lineage(placed.select("clause", "position"))
    tails = placed.groupBy("clause").agg(
        F.count("*").alias("n_positions"),
        F.round(F.avg((F.col("position") > 0.5).cast("int")) * 100, 1).alias("in_second_half"),
    )
    medians = exact_percentiles(placed, ["clause"], "position", {"median": 0.5})
    return tails.join(medians, "clause").select(
        "clause", "n_positions", F.round(F.col("median") * 100, 1).alias("median_position_pct"), "in_second_half"
    )


def domain_coverage(top_terms: DataFrame, expected: dict[str, list[str]] = EXPECTED_PHRASES) -> DataFrame:
    """Expected phrases that occur inside any of a clause's top terms, and a verdict."""
    spark = top_terms.sparkSession
    rows = [(c, p, i) for c, phrases in expected.items() for i, p in enumerate(phrases)]
    wanted = spark.createDataFrame(rows, "clause string, phrase string, at int")
    listed = top_terms.groupBy("clause").agg(F.collect_set(F.lower("term")).alias("terms"))
    joined = wanted.join(listed, "clause", "left")
    hit = F.exists("terms", lambda t: F.contains(t, F.lower(F.col("phrase"))))
    matched = joined.withColumn("hit", F.coalesce(hit, F.lit(False)))
    grouped = matched.groupBy("clause").agg(
        F.sort_array(F.collect_list(F.when(F.col("hit"), F.struct("at", "phrase")))).alias("m"),
        F.avg(F.col("hit").cast("int")).alias("share"),
    )
    verdict = F.when(F.col("share") >= 0.6, "VALIDATED").when(F.col("share") >= 0.3, "PARTIAL").otherwise("GAP")
    return grouped.select(
        "clause",
        F.array_join(F.transform("m", lambda x: x["phrase"]), "|").alias("matched"),
        F.round(F.col("share") * 100, 1).alias("coverage_pct"),
        verdict.alias("verdict"),
    )


def format_report(record: DataFrame, version: str = "production") -> DataFrame:
    """The plain-text report of each record."""
    rule = "=" * 60
    lists = RISK_VERSIONS[version]
    parts = [
        F.lit(rule),
        F.concat(F.lit("Overall Risk: "), F.col("overall_risk")),
        F.concat(
            F.lit("Clauses detected: "), F.col("detected_count").cast("string"), F.lit(" / "), F.size("clauses").cast("string")
        ),
        F.concat(F.lit("High-risk clauses: "), F.size("high_risk_detected").cast("string")),
        F.concat(F.lit("Words: "), F.col("word_count").cast("string")),
        F.lit(rule),
    ]
    for title, level in (("HIGH-RISK CLAUSES:", "HIGH"), ("MEDIUM-RISK CLAUSES:", "MEDIUM")):
        parts.append(F.lit("\n" + title))
        for clause in lists[level]:
            value = F.try_element_at("clauses", F.lit(clause))
            line = F.format_string(
                f"  %s {clause:<35} prob=%s  thr=%s",
                F.when(value["detected"], "[DETECTED]").otherwise("[absent]  "),
                F.format_number(value["probability"], 3),
                F.format_number(value["threshold"], 3),
            )
            parts.append(F.when(value.isNotNull(), line))
    actions = F.array_join(F.transform("high_risk_detected", lambda c: F.concat(F.lit("  !  "), c)), "\n")
    parts.append(
        F.when(
            F.size("high_risk_detected") > 0,
            F.concat(F.lit("\nACTION REQUIRED: review the following high-risk clauses before signing:\n"), actions),
        )
    )
    return record.select("doc_id", F.concat_ws("\n", *parts, F.lit("\n" + rule)).alias("report"))
