"""Cheaper steps against the plain ones: phrases found in one pass, counts made once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clausespark.catalog import evaluation, inputs, terms
from clausespark.fixed.keyword_rules import KEYWORD_RULES
from clausespark.fixed.patterns import HIGHLIGHT_PATTERNS
from clausespark.functions import terms as N
from clausespark.functions import text as X


def _texts(spark, pool, n=300):
    draw = random.Random(3)
    rows = [(i, draw.choice([" ", "  "]).join(draw.choice(pool) for _ in range(draw.randint(0, 30)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string")


def test_words_are_replaced_in_one_pass(spark):
    words = [w for w, _ in inputs.PHRASES]
    docs = _texts(spark, [*words, *words[:3] * 20, "x", "", "\n", "thth\nthth"])
    plain = F.col("text")
    for word, phrase in inputs.PHRASES:
        plain = F.replace(plain, F.lit(f" {word} "), F.lit(f" {phrase} "))
    both = docs.select("text", plain.alias("plain"), inputs.contract_text(F.col("text")).alias("once"))
    assert both.where(~F.col("plain").eqNullSafe(F.col("once"))).count() == 0
    assert both.where("text <> once").count() > 100
    # a chain of replacements reads the text once for every word
    assert "replace(" not in both._jdf.queryExecution().analyzed().toString().split("AS once")[0].split("AS plain")[1]


def test_phrases_are_counted_without_the_whole_text(spark):
    phrases = ["rofr", "right", "right of", "terminat", "of"]
    docs = _texts(spark, ["rofrofr", "rofr", "right of", "rights", "terminaterminat", "terminat", "of", "a"])
    met = docs.withColumn("met", X.phrases_met(F.col("text"), phrases))
    for phrase in phrases:
        plain, looked_up = X.count_literal(F.col("text"), phrase), X.count_met(F.col("met"), F.col("text"), phrase)
        assert met.where(~plain.eqNullSafe(looked_up)).count() == 0


def test_patterns_skip_only_texts_they_cannot_match(spark):
    pool = sorted({w for p in HIGHLIGHT_PATTERNS.values() for w in re.findall("[a-z]+", p)})
    pool += [*HIGHLIGHT_PATTERNS, *(p for c in inputs.CLAUSE_NAMES for p in KEYWORD_RULES[c])]
    pool += ["not aſſign", "İnsurance", "ı", "K", "indemnified", "hereby grants", "12 months"]
    docs = _texts(spark, pool)
    found = inputs.score_rows(docs)
    assert found.where("y = 1").count() > 300
    for clause in inputs.CLAUSE_NAMES:
        y = X.has_match(F.col("text"), HIGHLIGHT_PATTERNS[clause], ignore_case=True).alias("plain")
        both = found.where(F.col("clause") == clause).join(docs.select("doc_id", y), "doc_id")
        assert both.count() == 302 and both.where(~F.col("y").eqNullSafe(F.col("plain"))).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of 200 documents with words that become contract phrases."""
    path = tmp_path_factory.mktemp("documents")
    words = [w for w, _ in inputs.PHRASES]
    docs = _texts(spark, [*words, "a1", "b2", "c3"], 200).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source")
    docs.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("systems", [evaluation.two_systems, evaluation.compared, evaluation.configs])
def test_systems_score_and_count_the_texts_once(spark, folder, monkeypatch, systems):
    calls = {"counted": 0, "score_rows": 0}

    def watch(name, *owners):
        plain = getattr(owners[0], name)

        def run(*args):
            calls[name] += 1
            return plain(*args)

        for owner in owners:
            monkeypatch.setattr(owner, name, run)

    watch("counted", N)
    watch("score_rows", inputs, terms)
    systems(spark, folder)
    assert calls == {"counted": 1, "score_rows": 1}
