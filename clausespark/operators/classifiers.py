"""Fitted per-clause binary classifiers on ML vectors: one estimator per clause, one feature table.

The feature table is written once and shared by all fits. Eight fits run at a time from driver
threads; each is itself a distributed job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.operators.linear import label_table, positives_and_negatives
from clausespark.session import cut_lineage


@dataclass(frozen=True)
class ClauseStats:
    """What an estimator factory may know about a clause."""

    index: int
    clause: str
    n_pos: float
    n_neg: float

    @property
    def scale_pos(self) -> float:
        return max(1.0, self.n_neg / max(self.n_pos, 1.0))


@dataclass(frozen=True)
class Spec:
    """An estimator for a clause and the weight of its positive and negative rows."""

    estimator: Estimator
    weight_pos: float = 1.0
    weight_neg: float = 1.0


MakeEstimator = Callable[[ClauseStats], Spec]


@dataclass
class ClauseModels:
    """Per clause a fitted model, or the constant probability of an untrainable clause."""

    clauses: list[str]
    models: dict[str, Model] = field(default_factory=dict)
    constants: dict[str, float] = field(default_factory=dict)


# ---- estimator factories ---------------------------------------------------------------


def balanced(stats: ClauseStats) -> tuple[float, float]:
    n = stats.n_pos + stats.n_neg
    return n / (2 * max(stats.n_pos, 1.0)), n / (2 * max(stats.n_neg, 1.0))


def boosted_trees(
    trees: int = 50, depth: int = 4, rate: float = 0.15, columns: float = 0.4, min_rows: int = 20,
    weighted: bool = True, pos_weight_mult: float = 1.0, seed: int = 42,
) -> MakeEstimator:
    """Boosted trees with the production settings; positives weigh negatives / positives."""

    def make(stats: ClauseStats) -> Spec:
        trained = GBTClassifier(
            labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate,
            featureSubsetStrategy=str(columns), minInstancesPerNode=min_rows, minWeightFractionPerNode=0.0,
            maxMemoryInMB=512, seed=seed,
        )
        return Spec(trained, stats.scale_pos * pos_weight_mult if weighted else 1.0)

    return make


def larger_boosted_trees(seed: int = 42) -> MakeEstimator:
    """200 trees of depth 6 with at least five rows per leaf."""
    return boosted_trees(trees=200, depth=6, rate=0.1, columns=1.0, min_rows=5, seed=seed)


def histogram_boosted_trees(trees: int = 100, depth: int = 5, rate: float = 0.1, columns: float = 0.3) -> MakeEstimator:
    """The depth-wise boosting variant."""
    return boosted_trees(trees, depth, rate, columns, min_rows=1)


def logistic(c: float = 1.0, small_c: float | None = None, small_below: int = 10, max_iter: int = 300) -> MakeEstimator:
    """Balanced logistic regression; ``c`` is the inverse penalty per summed row weight."""

    def make(stats: ClauseStats) -> Spec:
        own = small_c if small_c is not None and stats.n_pos < small_below else c
        n = stats.n_pos + stats.n_neg
        fitted = LogisticRegression(
            labelCol="label", weightCol="weight", regParam=1.0 / (own * n), elasticNetParam=0.0,
            standardization=False, maxIter=max_iter,
        )
        return Spec(fitted, *balanced(stats))

    return make


def random_forest(trees: int = 200, depth: int = 8, min_rows: int = 2, seed: int = 42) -> MakeEstimator:
    def make(stats: ClauseStats) -> Spec:
        forest = RandomForestClassifier(
            labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed
        )
        return Spec(forest, *balanced(stats))

    return make


def on_terms(make: MakeEstimator, indices: dict[str, list[int]]) -> MakeEstimator:
    """The same estimator on a clause's own feature positions only."""

    def sliced(stats: ClauseStats) -> Spec:
        spec = make(stats)
        slicer = VectorSlicer(inputCol="features", outputCol="own_features", indices=sorted(indices[stats.clause]))
        spec.estimator.setFeaturesCol("own_features")
        return Spec(Pipeline(stages=[slicer, spec.estimator]), spec.weight_pos, spec.weight_neg)

    return sliced


# ---- fitting and scoring ---------------------------------------------------------------


def training_table(vectors: DataFrame, labels: DataFrame, clauses: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """(id, features, y0..yk), written once for all fits."""
    return cut_lineage(vectors.join(label_table(labels, clauses, id_col), id_col))


def fit_per_clause(
    table: DataFrame, labels: DataFrame, clauses: Sequence[str], make: MakeEstimator,
    min_positives: int = 2, constant_labels: bool = False, parallel: int = 8,
) -> ClauseModels:
    """Fit every trainable clause.

    A clause with one class or too few positives gets no model and scores 0, or with
    ``constant_labels`` scores its only label.
    """
    fitted = ClauseModels(list(clauses))
    counts = positives_and_negatives(labels, clauses)
    stats = [ClauseStats(i, c, *counts[i]) for i, c in enumerate(clauses)]
    trainable = [s for s in stats if s.n_pos >= min_positives and s.n_neg > 0]
    for s in stats:
        if s not in trainable:
            fitted.constants[s.clause] = 1.0 if constant_labels and s.n_neg == 0 and s.n_pos > 0 else 0.0

    def fit_one(s: ClauseStats) -> tuple[str, Model]:
        spec = make(s)
        y = F.col(f"y{s.index}")
        rows = table.select(
            "features", y.cast("double").alias("label"), F.when(y == 1, spec.weight_pos).otherwise(spec.weight_neg).alias("weight")
        )
        return s.clause, spec.estimator.fit(rows)

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        fitted.models.update(pool.map(fit_one, trainable))
    return fitted


def score(models: ClauseModels, vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, clause, prob): every model applied in one pass over the vectors."""
    wide = vectors.select(id_col, "features")
    parts = []
    for i, clause in enumerate(models.clauses):
        if clause in models.models:
            wide = _with_probability(models.models[clause], wide, f"_p{i}")
            prob = F.get(vector_to_array(f"_p{i}"), 1)
        else:
            prob = F.lit(models.constants.get(clause, 0.0))
        parts.append(F.struct(F.lit(clause).alias("clause"), prob.cast("double").alias("prob")))
    return wide.select(id_col, F.inline(F.array(*parts)))


def _with_probability(model: Model, df: DataFrame, name: str) -> DataFrame:
    keep = df.columns
    return model.transform(df).withColumnRenamed("probability", name).select(*keep, name)


@dataclass
class CalibratedModel:
    """Linear SVMs of the folds with their sigmoid calibrations; the mean probability counts."""

    pairs: list[tuple[Model, Model]]

    def transform(self, df: DataFrame) -> DataFrame:
        total = F.lit(0.0)
        out = df
        for i, (svm, sigmoid) in enumerate(self.pairs):
            margin = F.get(vector_to_array("rawPrediction"), 1)
            out = svm.transform(out).withColumn(f"_m{i}", margin).drop("rawPrediction", "prediction")
            total = total + 1.0 / (1.0 + F.exp(-(F.lit(float(sigmoid.coefficients[0])) * F.col(f"_m{i}") + F.lit(float(sigmoid.intercept)))))
        prob = total / F.lit(float(len(self.pairs)))
        return out.withColumn("probability", array_to_vector(F.array(1.0 - prob, prob))).drop(
            *[f"_m{i}" for i in range(len(self.pairs))]
        )

    def save(self, path: str) -> None:
        for i, (svm, sigmoid) in enumerate(self.pairs):
            svm.write().overwrite().save(f"{path}/svm{i}")
            sigmoid.write().overwrite().save(f"{path}/sigmoid{i}")

    @classmethod
    def load(cls, path: str, folds: int = 3) -> CalibratedModel:
        return cls(
            [(LinearSVCModel.load(f"{path}/svm{i}"), LogisticRegressionModel.load(f"{path}/sigmoid{i}")) for i in range(folds)]
        )


def fit_calibrated_svm(
    table: DataFrame, labels: DataFrame, clauses: Sequence[str], fold: Column, folds: int = 3,
    c: float = 1.0, max_iter: int = 100, parallel: int = 8,
) -> ClauseModels:
    """Balanced linear SVM per clause, calibrated on the fold left out of each of three fits.

    ``fold`` numbers the rows of ``table`` from 0 to ``folds - 1``.
    """
    numbered = table.withColumn("_fold", fold)
    fitted = ClauseModels(list(clauses))
    counts = positives_and_negatives(labels, clauses)

    def fit_one(s: ClauseStats) -> tuple[str, CalibratedModel]:
        weight_pos, weight_neg = balanced(s)
        y = F.col(f"y{s.index}")
        rows = numbered.select(
            "features", "_fold", y.cast("double").alias("label"), F.when(y == 1, weight_pos).otherwise(weight_neg).alias("weight")
        )
        pairs = []
        for k in range(folds):
            n = (s.n_pos + s.n_neg) * (folds - 1) / folds
            svm = LinearSVC(labelCol="label", weightCol="weight", regParam=1.0 / (c * n), standardization=False, maxIter=max_iter)
            model = svm.fit(rows.where(F.col("_fold") != k))
            held = model.transform(rows.where(F.col("_fold") == k))
            margins = held.select(
                array_to_vector(F.array(F.get(vector_to_array("rawPrediction"), 1))).alias("features"), "label"
            )
            pairs.append((model, LogisticRegression(labelCol="label").fit(margins)))
        return s.clause, CalibratedModel(pairs)

    stats = [ClauseStats(i, c_, *counts[i]) for i, c_ in enumerate(clauses)]
    trainable = [s for s in stats if s.n_pos >= folds and s.n_neg >= folds]
    fitted.constants.update({s.clause: 0.0 for s in stats if s not in trainable})
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        fitted.models.update(pool.map(fit_one, trainable))
    return fitted


# ---- explanations ----------------------------------------------------------------------


def _last_stage(model: Model) -> Model:
    return model.stages[-1] if hasattr(model, "stages") else model


def _feature_places(model: Model) -> list[int] | None:
    """Positions in the full vector of a model that saw a slice of it."""
    stages = getattr(model, "stages", [])
    return stages[0].getIndices() if stages and isinstance(stages[0], VectorSlicer) else None


def importances(models: ClauseModels, vocabulary: DataFrame, top: int | None = 20) -> DataFrame:
    """(clause, term, weight): the largest positive tree importances of each clause, or all named ones."""
    return _named(models, vocabulary, lambda m: m.featureImportances, top)


def coefficients(models: ClauseModels, vocabulary: DataFrame) -> DataFrame:
    """(clause, term, weight): all non-zero linear coefficients."""
    return _named(models, vocabulary, lambda m: m.coefficients, None)


def _named(models: ClauseModels, vocabulary: DataFrame, vector: Callable[[Model], object], top: int | None) -> DataFrame:
    rows = []
    for clause, model in models.models.items():
        values = vector(_last_stage(model)).toArray()
        places = _feature_places(model)
        at = [int(i) for i in values.nonzero()[0]]
        if top is not None:
            at = sorted(at, key=lambda i: (-values[i], i))[:top]
        rows += [(clause, places[i] if places else i, float(values[i])) for i in at]
    table = vocabulary.sparkSession.createDataFrame(rows, "clause string, term_id int, weight double")
    return table.join(F.broadcast(vocabulary.select("term_id", "term")), "term_id").select("clause", "term", "weight")
