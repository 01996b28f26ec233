"""Fits on larger tables: labels stay out of the driver, texts are counted once."""

import random

import pytest

from clausespark.catalog import inputs, models
from clausespark.functions import terms as N
from clausespark.operators import linear
from clausespark.operators import vocabulary as V
from clausespark.plans import experiments as X
from clausespark.session import cut_lineage


def texts(spark, n=120):
    draw = random.Random(5)
    pool = [*[w for w, _ in inputs.PHRASES], "a1", "b2", "c3"]
    rows = [(i, " ".join(draw.choice(pool) for _ in range(draw.randint(0, 30)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("documents")
    texts(spark).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_labels_are_not_broadcast(spark, folder):
    scores = cut_lineage(inputs.clause_scores(spark, folder))  # a small file
    joined = linear.judged(scores.select("doc_id", "clause", "prob"), scores.select("doc_id", "clause", "y"))
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert joined.count() == scores.count()


@pytest.mark.parametrize("query", [models.experiment_out_of_fold, models.experiment_cross_validated_thresholds])
def test_folds_read_the_same_counts(spark, folder, monkeypatch, query):
    calls, plain = [], N.counted
    monkeypatch.setattr(N, "counted", lambda terms: calls.append(1) or plain(terms))
    query(spark, folder)
    assert len(calls) == (1 if query is models.experiment_out_of_fold else 2)  # training and test documents


def test_counted_documents_score_as_texts_do(spark):
    docs, spec = texts(spark), V.TermSpec(hi=2, max_features=500)
    labels = inputs.score_rows(docs).select("doc_id", "clause", "y")
    clauses = inputs.CLAUSE_NAMES[:4]
    plain = X.naive_bayes(clauses, spec)(docs, labels, docs)
    counted = V.counted_texts(docs, spec)
    once = X.naive_bayes(clauses, spec, counted=True)(counted, labels, counted)
    both = plain.join(once.withColumnRenamed("prob", "other"), ["doc_id", "clause"])
    assert both.count() == 122 * 4 and both.where("abs(prob - other) > 1e-9").count() == 0
