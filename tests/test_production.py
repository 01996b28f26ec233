"""The production run end to end on a small corpus, and the invariants of its records."""

import pytest
from pyspark.sql import functions as F

from clausespark.operators import classifiers as C
from clausespark.operators import reports
from clausespark.operators import vocabulary as V
from clausespark.plans import experiments, production
from clausespark.streaming import analyze_stream, read_arriving

RISKY = "Vendor shall not compete with Customer. Non-compete. Upon change of control either party may terminate."
PLAIN = "Each party keeps information confidential and returns documents on request."
CLAUSES = ["Non-Compete", "Change Of Control", "Insurance"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, (RISKY if i % 3 == 0 else PLAIN) + f" Section {i % 7} and {i % 5}.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    labels = spark.createDataFrame(
        [(i, c, int(c != "Insurance" and i % 3 == 0)) for i in range(60) for c in CLAUSES], "doc_id long, clause string, y int"
    ).cache()
    return docs, labels


@pytest.fixture(scope="module")
def bundle(corpus):
    docs, labels = corpus
    return production.train(docs, labels, CLAUSES, V.TermSpec(max_features=200), C.boosted_trees(trees=5, min_rows=1))


@pytest.fixture(scope="module")
def unseen(spark):
    rows = [(100, RISKY), (101, PLAIN), (102, ""), (103, "One short sentence.")]
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def test_records(bundle, unseen):
    records = {r["doc_id"]: r for r in production.analyze(bundle, unseen).collect()}
    assert set(records) == {100, 101, 102, 103}
    for doc, record in records.items():
        assert set(record["clauses"]) == set(CLAUSES)
        for clause, v in record["clauses"].items():
            assert 0 <= v["probability"] <= 1 and 0 <= v["threshold"] <= 1
            assert v["risk_level"] in {"HIGH", "MEDIUM", "STANDARD"}
        detected = [c for c, v in record["clauses"].items() if v["detected"]]
        assert record["detected_count"] == len(detected)
        assert set(record["high_risk_detected"]) <= set(detected)
        assert record["overall_risk"] in {"HIGH", "MEDIUM", "LOW"}
    assert records[102]["word_count"] == 0 and records[103]["word_count"] == 3
    assert records[100]["overall_risk"] == "HIGH"
    assert records[100]["clauses"]["Non-Compete"]["probability"] > records[101]["clauses"]["Non-Compete"]["probability"]


def test_detection_is_decided_on_unrounded_values(bundle, unseen):
    for r in production.score(bundle, unseen).collect():
        assert r["pred"] == int(r["prob"] >= r["thr"])


def test_same_input_same_output(bundle, unseen):
    first, second = (sorted(map(str, production.score(bundle, unseen).collect())) for _ in range(2))
    assert first == second


def test_saved_bundle_scores_alike(spark, bundle, unseen, tmp_path):
    production.save(bundle, str(tmp_path / "model"))
    loaded = production.load(spark, str(tmp_path / "model"))
    assert loaded.models.constants == {"Insurance": 0.0}
    want = sorted(map(str, production.score(bundle, unseen).collect()))
    assert sorted(map(str, production.score(loaded, unseen).collect())) == want


@pytest.fixture(scope="module")
def linear_bundle(corpus):
    docs, labels = corpus
    return production.train_linear(docs, labels, CLAUSES, V.TermSpec(hi=2, max_features=200, sublinear=False))


def test_linear_bundle_records(linear_bundle, unseen):
    records = {r["doc_id"]: r for r in production.analyze(linear_bundle, unseen).collect()}
    assert set(records) == {100, 101, 102, 103}
    assert [records[d]["word_count"] for d in (102, 103)] == [0, 3]
    assert all(set(r["clauses"]) == set(CLAUSES) for r in records.values())
    assert "Non-Compete" in records[100]["high_risk_detected"] and records[101]["high_risk_detected"] == []
    assert all(r["clauses"]["Insurance"]["probability"] == 0.0 for r in records.values())  # never seen in training
    # a text without known terms has the prior: 20 of 60
    assert records[102]["clauses"]["Non-Compete"]["probability"] == pytest.approx(1 / 3, abs=1e-4)


def test_saved_linear_bundle_scores_arriving_documents_alike(spark, linear_bundle, unseen, tmp_path):
    production.save(linear_bundle, str(tmp_path / "model"))
    loaded = production.load(spark, str(tmp_path / "model"))
    assert loaded.models.biases == linear_bundle.models.biases and loaded.spec == linear_bundle.spec
    unseen.repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = read_arriving(spark, str(tmp_path / "in"), "doc_id long, text string", files_per_batch=1)
    query = analyze_stream(arriving, lambda b: production.analyze(loaded, b), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    want = production.analyze(linear_bundle, unseen)
    out = spark.read.parquet(str(tmp_path / "out")).select(*want.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))


def test_linear_scoring_moves_no_text(linear_bundle, unseen):
    plan = production.score(linear_bundle, unseen)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_saved_calibrated_models_score_alike(spark, corpus, unseen, tmp_path):
    docs, labels = corpus
    spec = V.TermSpec(hi=1, max_features=100)
    vocabulary = V.fit(docs, spec)
    table = C.training_table(V.to_vectors(V.transform(docs, vocabulary, spec), docs, 100), labels, CLAUSES)
    models = C.fit_calibrated_svm(table, labels, CLAUSES, (F.col("doc_id") % 5 % 3).cast("int"), max_iter=3)
    bundle = production.Bundle(spec, vocabulary, models, labels.groupBy("clause").agg(F.avg("y").alias("thr")))
    production.save(bundle, str(tmp_path / "model"))
    loaded = production.load(spark, str(tmp_path / "model"))
    want = sorted(map(str, production.score(bundle, unseen).collect()))
    assert sorted(map(str, production.score(loaded, unseen).collect())) == want


def test_evaluation_on_training_documents(bundle, corpus):
    row = production.evaluate(bundle, *corpus).first()
    assert row["macro_f1"] == pytest.approx(1.0) and row["macro_auc"] == pytest.approx(1.0)


def test_arriving_documents_score_like_a_batch(spark, bundle, unseen, tmp_path):
    unseen.repartition(3).write.parquet(str(tmp_path / "in"))
    arriving = read_arriving(spark, str(tmp_path / "in"), "doc_id long, text string", files_per_batch=1)
    query = analyze_stream(arriving, lambda b: production.analyze(bundle, b), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = sorted(map(str, production.analyze(bundle, unseen).collect()))
    assert sorted(map(str, out.select(*production.analyze(bundle, unseen).columns).collect())) == want


def test_report_text(bundle, unseen):
    text = reports.format_report(production.analyze(bundle, unseen)).where("doc_id = 100").first()["report"]
    assert "Overall Risk: HIGH" in text and "[DETECTED] Non-Compete" in text and "ACTION REQUIRED" in text


def test_linear_models_and_calibrated_svm(corpus):
    docs, labels = corpus
    spec = V.TermSpec(hi=1, max_features=100)
    vocabulary = V.fit(docs, spec)
    vectors = V.to_vectors(V.transform(docs, vocabulary, spec), docs, 100)
    table = C.training_table(vectors, labels, CLAUSES)
    for models in (
        C.fit_per_clause(table, labels, CLAUSES, C.logistic()),
        C.fit_calibrated_svm(table, labels, CLAUSES, (F.col("doc_id") % 5 % 3).cast("int")),
    ):
        scored = C.score(models, vectors).join(labels, ["doc_id", "clause"])
        assert scored.where("prob < 0 OR prob > 1").count() == 0
        assert scored.where("clause <> 'Insurance' AND y <> CAST(prob >= 0.5 AS INT)").count() == 0
        assert scored.where("clause = 'Insurance' AND prob <> 0").count() == 0
    weights = C.coefficients(C.fit_per_clause(table, labels, CLAUSES, C.logistic()), vocabulary)
    top = {r["term"] for r in reports.top_signed(weights, 5).where("side = 'positive'").collect()}
    assert "compete" in top or "control" in top or "change" in top


def test_sliced_models_name_their_own_terms(corpus):
    docs, labels = corpus
    spec = V.TermSpec(hi=1, max_features=100)
    vocabulary = V.fit(docs, spec)
    ids = {r["term"]: r["term_id"] for r in vocabulary.collect()}
    table = C.training_table(V.to_vectors(V.transform(docs, vocabulary, spec), docs, 100), labels, CLAUSES)
    kept = {c: [ids["compete"], ids["returns"]] for c in CLAUSES}
    weights = C.coefficients(C.fit_per_clause(table, labels, CLAUSES, C.on_terms(C.logistic(), kept)), vocabulary)
    got = {(r["clause"], r["term"]): r["weight"] for r in weights.collect()}
    assert {t for _, t in got} <= {"compete", "returns"}
    assert got[("Non-Compete", "compete")] > 0 > got[("Non-Compete", "returns")]


def test_timing_summary_without_groups(spark):
    from clausespark.operators.metrics import timing_summary

    row = timing_summary(spark.createDataFrame([(1,), (2,), (9,)], "ms long"), "ms").first()
    assert (row["n"], row["mean"], row["median"], row["per_thousand"]) == (3, 4.0, 2.0, 250.0)


def test_out_of_fold_scores_cover_every_document_once(corpus):
    docs, labels = corpus
    oof = experiments.out_of_fold(docs, labels, experiments.naive_bayes(CLAUSES, V.TermSpec(hi=1, max_features=100)), 3)
    assert oof.count() == 60 * 3 and oof.select("doc_id", "clause").distinct().count() == 180
    assert oof.where("clause <> 'Insurance' AND y <> CAST(prob >= 0.5 AS INT)").count() == 0


def test_trials_are_seeded():
    assert experiments.draw_trials(3) == experiments.draw_trials(3)
    assert all(3 <= t.depth <= 8 and 0.04 <= t.rate <= 0.30 for t in experiments.draw_trials(20))
