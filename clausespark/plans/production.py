"""The production run: fit, thresholds, evaluation, saved model, scoring of new documents.

A bundle holds ML models per clause, or one linear model of all clauses. The linear one is fitted by
sums and scores a document from its term counts in one pass, so it is the one for large corpora.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.functions import text as X
from clausespark.operators import boosting as B
from clausespark.operators import classifiers as C
from clausespark.operators import linear, reports
from clausespark.operators import metrics as M
from clausespark.operators import thresholds as T
from clausespark.operators import vocabulary as V
from clausespark.session import cut_lineage

MODEL_CLASSES = {
    c.__name__: c
    for c in (
        GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel, PipelineModel, C.CalibratedModel
    )
}
LINEAR, BOOSTED = "linear", "boosted"
#: Raw counts of one and two words, the terms of naive Bayes.
COUNTS = V.TermSpec(hi=2, max_features=50_000, sublinear=False)


@dataclass
class Bundle:
    """Everything scoring needs: vocabulary, models, thresholds, clause order."""

    spec: V.TermSpec
    vocabulary: DataFrame
    models: C.ClauseModels | linear.LinearModel | B.BoostedModel
    thresholds: DataFrame


def train(
    docs: DataFrame, labels: DataFrame, clauses: Sequence[str], spec: V.TermSpec = V.PRODUCTION,
    make: C.MakeEstimator | None = None,
) -> Bundle:
    """Vocabulary and models from the training documents, thresholds from their label rates."""
    if spec.max_features is None:
        raise ValueError("feature vectors need a vocabulary with max_features")
    vocabulary = V.fit(docs, spec)
    vectors = V.to_vectors(V.transform(docs, vocabulary, spec), docs, spec.max_features)
    table = C.training_table(vectors, labels, clauses)
    models = C.fit_per_clause(table, labels, clauses, make or C.boosted_trees())
    return Bundle(spec, vocabulary, models, cut_lineage(T.class_prior(labels)))


def train_boosted(
    docs: DataFrame, labels: DataFrame, clauses: Sequence[str], spec: V.TermSpec = V.PRODUCTION,
    settings: B.Boosting = B.Boosting(), bins: int = 32,
) -> Bundle:
    """The same with boosted trees of all clauses, grown together on histograms."""
    vocabulary = V.fit(docs, spec)
    rows = cut_lineage(V.packed(docs, vocabulary, spec, linear.label_table(labels, clauses)))
    edges = B.Bins.of(B.bin_edges(B.unpacked(rows), bins, settings.min_rows))
    counts = linear.positives_and_negatives(labels, clauses)
    model = B.fit(B.binned_blocks(rows, edges, len(clauses)), edges, counts, clauses, settings)
    return Bundle(spec, vocabulary, model, cut_lineage(T.class_prior(labels)))


def train_linear(
    docs: DataFrame, labels: DataFrame, clauses: Sequence[str], spec: V.TermSpec = COUNTS,
    fit: Callable[[DataFrame, DataFrame, Sequence[str]], linear.LinearModel] = linear.multinomial_nb, counted: bool = False,
) -> Bundle:
    """The same with one linear model over term counts; ``fit`` makes it from sums, labels and clauses.

    ``counted`` documents are those of ``vocabulary.counted_texts``.
    """
    vocabulary = V.fit(docs, spec, counted=counted)
    labelled = linear.with_labels(docs, labels, clauses)
    counts = V.count_terms(labelled, spec, vocabulary=vocabulary, carry=linear.mask_names(len(clauses)), counted=counted)
    model = fit(cut_lineage(linear.term_sums(counts, len(clauses))), labels, clauses)
    model = linear.LinearModel(cut_lineage(model.table), model.biases, model.clauses, spec)
    return Bundle(spec, vocabulary, model, cut_lineage(T.class_prior(labels)))


def score(bundle: Bundle, docs: DataFrame) -> DataFrame:
    """(doc_id, clause, prob, thr, pred); a linear model's rows also carry the document's word count."""
    if isinstance(bundle.models, linear.LinearModel):
        counted = docs.withColumn("word_count", X.word_count(F.col("text")))
        return T.apply_thresholds(linear.score_counts(counted, bundle.models, bundle.spec, carry=["word_count"]), bundle.thresholds)
    if isinstance(bundle.models, B.BoostedModel):
        return T.apply_thresholds(B.score(bundle.models, V.packed(docs, bundle.vocabulary, bundle.spec)), bundle.thresholds)
    weights = V.transform(docs, bundle.vocabulary, bundle.spec)
    scores = C.score(bundle.models, V.to_vectors(weights, docs, bundle.spec.max_features))
    return T.apply_thresholds(scores, bundle.thresholds)


def analyze(bundle: Bundle, docs: DataFrame) -> DataFrame:
    """One record per document."""
    preds = score(bundle, docs)
    return reports.records(preds, None if "word_count" in preds.columns else docs)


def evaluate(bundle: Bundle, docs: DataFrame, labels: DataFrame) -> DataFrame:
    preds = linear.judged(score(bundle, docs), labels.select("doc_id", "clause", "y"))
    return M.evaluate(cut_lineage(preds))


def save(bundle: Bundle, path: str) -> None:
    spark = bundle.vocabulary.sparkSession
    bundle.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    bundle.thresholds.write.mode("overwrite").json(f"{path}/thresholds")
    rows = []
    if isinstance(bundle.models, linear.LinearModel):
        bundle.models.table.write.mode("overwrite").parquet(f"{path}/{LINEAR}")
        rows = [(i, *x) for i, x in enumerate(zip(bundle.models.clauses, [LINEAR] * len(bundle.models.clauses), bundle.models.biases))]
    elif isinstance(bundle.models, B.BoostedModel):
        B.save(bundle.models, f"{path}/{BOOSTED}")
        rows = [(i, clause, BOOSTED, None) for i, clause in enumerate(bundle.models.clauses)]
    else:
        for i, clause in enumerate(bundle.models.clauses):
            model = bundle.models.models.get(clause)
            if isinstance(model, C.CalibratedModel):
                model.save(f"{path}/models/{i}")
            elif model is not None:
                model.write().overwrite().save(f"{path}/models/{i}")
            rows.append((i, clause, type(model).__name__ if model is not None else None, bundle.models.constants.get(clause)))
    manifest = spark.createDataFrame(rows, "ord int, clause string, kind string, constant double")
    manifest.withColumn("spec", F.lit(json.dumps(asdict(bundle.spec)))).write.mode("overwrite").json(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> Bundle:
    manifest = spark.read.schema("ord int, clause string, kind string, constant double, spec string").json(f"{path}/manifest")
    rows = manifest.orderBy("ord").collect()
    settings = json.loads(rows[0]["spec"])
    settings["keys"] = tuple(settings["keys"])
    clauses = [r["clause"] for r in rows]
    if rows[0]["kind"] == LINEAR:
        models = linear.LinearModel(spark.read.parquet(f"{path}/{LINEAR}"), [r["constant"] for r in rows], clauses, V.TermSpec(**settings))
    elif rows[0]["kind"] == BOOSTED:
        models = B.load(spark, f"{path}/{BOOSTED}")
    else:
        models = C.ClauseModels(clauses)
        for r in rows:
            if r["kind"] is not None:
                models.models[r["clause"]] = MODEL_CLASSES[r["kind"]].load(f"{path}/models/{r['ord']}")
            elif r["constant"] is not None:
                models.constants[r["clause"]] = r["constant"]
    return Bundle(
        V.TermSpec(**settings),
        spark.read.parquet(f"{path}/vocabulary"),
        models,
        spark.read.schema("clause string, thr double").json(f"{path}/thresholds"),
    )
