import pytest
from pyspark.sql import functions as F

from clausespark.fixed import keyword_rules, patterns, taxonomy
from clausespark.operators import taxonomy as T
from clausespark.sources.qa_json import question_clause

KNOWN = [
    ("non-compete", "Non-Compete"), ("governing law", "Governing Law"), ("indemnification", "Indemnification"),
    ("uncapped liability", "Uncapped Liability"), ("liquidated damages", "Liquidated Damages"),
    ("change of control", "Change Of Control"), ("termination for convenience", "Termination For Convenience"),
    ("exclusivity", "Exclusivity"), ("audit rights", "Audit Rights"), ("non-disparagement", "Non-Disparagement"),
    ("NON-COMPETE", "Non-Compete"), ("  Governing Law ", "Governing Law"),
    ("does the contract have a unicorn clause?", None), ("which parties are insured by insurance?", "Parties"),
]


def test_names_and_risk_lists(spark):
    assert len(taxonomy.CLAUSES) == 41 and len(set(taxonomy.CLAUSES)) == 41
    assert len(set(taxonomy.CLAUSES) - set(taxonomy.METADATA_CLAUSES)) == 36
    assert len(taxonomy.RISK_VERSIONS) == 4
    for version, lists in taxonomy.RISK_VERSIONS.items():
        assert not set(lists["HIGH"]) & set(lists["MEDIUM"])
        known = {c.lower() for c in taxonomy.CLAUSES} | ({"limitation of liability"} if version == "configuration" else set())
        assert {c.lower() for c in lists["HIGH"] + lists["MEDIUM"]} <= known
    levels = {(r["clause"], r["version"]): r["level"] for r in T.risk_versions(T.taxonomy_table(spark).select("clause")).collect()}
    assert len(levels) == 4 * 41 and levels["Change Of Control", "configuration"] == "HIGH"
    assert levels["Most Favored Nation", "first_pipeline"] == "LOW" and levels["Most Favored Nation", "production"] == "MEDIUM"
    table = T.taxonomy_table(spark)
    assert table.count() == 41 and table.where("is_metadata").count() == 5
    assert T.drop_metadata(table.select("clause")).count() == 36


def test_fixed_tables_are_complete():
    assert len(keyword_rules.KEYWORD_RULES) == 35
    assert len(patterns.SYNTAX_PATTERNS) == 36 and len(patterns.HIGHLIGHT_PATTERNS) == 18
    assert len(patterns.ENHANCED_ORDER) == 51 and len(patterns.UNFAIR_FLAGS) == 21
    assert set(patterns.LEGAL_SIGNAL_FLAGS) <= set(patterns.UNFAIR_FLAGS) and len(patterns.LEGAL_SIGNAL_FLAGS) == 10


def test_question_to_clause(spark):
    rows = spark.createDataFrame(KNOWN, "question string, want string")
    for row in rows.select("question", "want", question_clause(F.col("question")).alias("got")).collect():
        assert row["got"] == row["want"], row


@pytest.mark.parametrize("version, level", [("production", "HIGH"), ("review_screen", "LOW")])
def test_risk_level_depends_on_version(spark, version, level):
    row = spark.createDataFrame([("Joint IP Ownership",)], "clause string")
    assert row.select(T.risk_level(F.col("clause"), version)).first()[0] == level
