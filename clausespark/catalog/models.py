"""Fitted models and experiment runs. Fits have no SQL; tests hold their invariants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from clausespark.catalog import register
from clausespark.catalog.inputs import CLAUSE_NAMES, CONTRACTS_SQL, SCORES_SQL, contracts, hash_bucket_sql, quoted, score_rows, with_scores
from clausespark.catalog.terms import counts_cte, grams_sql, stacked_blocks, vocab_cte
from clausespark.fixed.taxonomy import RISK_VERSIONS
from clausespark.operators import blocks, linear, reports
from clausespark.operators import boosting as B
from clausespark.operators import classifiers as C
from clausespark.operators import solver as S
from clausespark.operators import vocabulary as V
from clausespark.operators.splits import hash_bucket, hash_split
from clausespark.operators.thresholds import class_prior
from clausespark.plans import experiments as X
from clausespark.plans import production
from clausespark.session import cut_lineage

# Every model takes every clause and the whole vocabulary.
WHOLE = (CLAUSE_NAMES, V.BIGRAMS_20K)


class Data:
    """Training and test documents with their labels, and their TF-IDF weights."""

    def __init__(self, spark, sf_dir, clauses, spec):
        docs = cut_lineage(hash_split(contracts(spark, sf_dir).select("doc_id", "text")))
        labels = cut_lineage(score_rows(docs.drop("split")).where(F.col("clause").isin(clauses)).select("doc_id", "clause", "y", "split"))
        self.clauses, self.spec = clauses, spec
        self.train, self.test = (docs.where(F.col("split") == s).drop("split") for s in ("train", "test"))
        self.train_labels, self.test_labels = (labels.where(F.col("split") == s).drop("split") for s in ("train", "test"))

    def hold_out(self):
        """A fifth of the training documents takes the place of the test documents."""
        held = hash_bucket("doc_id", 11, 5) == 0
        self.test, self.test_labels = self.train.where(held), self.train_labels.where(held)
        self.train, self.train_labels = self.train.where(~held), self.train_labels.where(~held)
        return self

    def vectors(self):
        self.vocabulary = V.fit(self.train, self.spec)
        self.weights = V.transform(self.train, self.vocabulary, self.spec)
        train = V.to_vectors(self.weights, self.train, self.spec.max_features)
        test = V.to_vectors(V.transform(self.test, self.vocabulary, self.spec), self.test, self.spec.max_features)
        self.table = C.training_table(train, self.train_labels, self.clauses)
        self.test_vectors = cut_lineage(test)
        return self

    def packed(self, vocabulary=None):
        """Weights of all documents as arrays, the training ones with labels, each written once."""
        self.vocabulary = V.fit(self.train, self.spec) if vocabulary is None else vocabulary
        self.weights = V.transform(self.train, self.vocabulary, self.spec)
        self.rows = cut_lineage(V.packed(self.train, self.vocabulary, self.spec, linear.label_table(self.train_labels, self.clauses)))
        self.test_rows = cut_lineage(V.packed(self.test, self.vocabulary, self.spec))
        self.counts = linear.positives_and_negatives(self.train_labels, self.clauses)
        return self

    def boosted(self, settings, min_positives=2, **options):
        """Boosted trees of every clause on the bins of the packed rows."""
        bins = B.Bins.of(B.bin_edges(B.unpacked(self.rows), min_rows=settings.min_rows, **options))
        blocks = B.binned_blocks(self.rows, bins, len(self.clauses))
        return B.fit(blocks, bins, self.counts, self.clauses, settings, min_positives)

    def judged(self, model):
        return linear.judged(B.score(model, self.test_rows), self.test_labels)

    def scored(self, models):
        return linear.judged(C.score(models, self.test_vectors), self.test_labels)

    def counted(self):
        """Training and test documents with their term counts, each text counted once."""
        return V.counted_texts(self.train, self.spec), V.counted_texts(self.test, self.spec)


@register("model_boosted_trees")
def model_boosted_trees(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE).packed()
    return data.judged(data.boosted(B.Boosting()))


STUMP = B.Boosting(trees=1, depth=1, columns=1.0)

_STUMP_SQL = f"""WITH {SCORES_SQL},
labels AS (SELECT doc_id, clause, y FROM scores WHERE split = 'train'),
train AS (SELECT doc_id, text FROM contracts WHERE {hash_bucket_sql()} >= 20),
{counts_cte(grams_sql(1, 2, 'train'))}, {vocab_cte(20000, '(SELECT count(*) FROM train)')},
n AS (SELECT clause, n1, n0, greatest(1.0::DOUBLE, n0 / n1) AS w, n1 * greatest(1.0::DOUBLE, n0 / n1) / n0 AS odds
  FROM (SELECT clause, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM labels GROUP BY clause) WHERE n1 >= 2 AND n0 > 0),
start AS (SELECT *, (odds / (1 + odds) - 1) * w AS g1, odds / (1 + odds) AS g0, odds / (1 + odds) * (1 - odds / (1 + odds)) AS h FROM n),
met AS (SELECT clause, term, sum(y)::DOUBLE AS a, sum(1 - y)::DOUBLE AS b FROM counts SEMI JOIN vocab USING (term) JOIN labels USING (doc_id) GROUP BY 1, 2),
sums AS (SELECT clause, term, a + b AS n_right, n1 + n0 AS n_all, a * g1 + b * g0 AS gr, h * (a * w + b) AS hr, n1 * g1 + n0 * g0 AS g, h * (n1 * w + n0) AS hh
  FROM met JOIN start USING (clause)),
gains AS (SELECT *, gr * gr / hr + (g - gr) * (g - gr) / (hh - hr) - g * g / hh AS gain FROM sums
  WHERE n_right >= {STUMP.min_rows} AND n_all - n_right >= {STUMP.min_rows} AND hr >= {STUMP.min_hessian} AND hh - hr >= {STUMP.min_hessian})
SELECT clause, term, round(gain, 5) AS gain, round(-{STUMP.rate} * (g - gr) / (hh - hr), 6) AS without_term, round(-{STUMP.rate} * gr / hr, 6) AS with_term
FROM gains WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY clause
  ORDER BY round(gain * 10.0::DOUBLE ** (8 - floor(log10(gain)))) / 10.0::DOUBLE ** (8 - floor(log10(gain))) DESC, term) = 1"""


@register("model_first_stumps", _STUMP_SQL)
def model_first_stumps(spark, sf_dir):
    """The first split of every clause where terms are present or absent: its term, gain and leaf values."""
    data = Data(spark, sf_dir, *WHOLE).packed()
    nodes = B.table(data.boosted(STUMP, bins=1), data.vocabulary)
    at = lambda node, column: F.max(F.when(F.col("node") == node, F.col(column)))
    found = nodes.groupBy("clause").agg(
        at(0, "term").alias("term"), F.round(at(0, "gain"), 5).alias("gain"),
        F.round(at(1, "value"), 6).alias("without_term"), F.round(at(2, "value"), 6).alias("with_term"),
    )
    return found.where("term is not null")


@register("model_larger_boosted_trees")
def model_larger_boosted_trees(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE).packed()
    return data.judged(data.boosted(B.LARGER, min_positives=3))


@register("model_histogram_boosted_trees")
def model_histogram_boosted_trees(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE).packed()
    return data.judged(data.boosted(B.HESSIAN))


def logistic_columns(data, **options):
    """One column per clause with both classes; a clause that is always or never met scores its only label."""
    return [S.balanced(i, c, **options) for i, c in enumerate(data.counts) if min(c) > 0]


def fitted_linear(data, columns, mask=None, **options):
    """Coefficients, intercepts and the largest entries of the gradients of columns over the training rows."""
    return S.minimise(S.row_blocks(data.rows, len(data.clauses), **options), data.spec.max_features, columns, mask)


def linear_scores_of(data, rows, columns, weights, bias):
    """(doc_id, clause, prob) of one column per clause, and the constant of the clauses without one."""
    found = S.margins(rows, weights, bias).withColumn("prob", S.probability()).drop("margin")
    found = S.named(found, {k: (data.clauses[c.clause],) for k, c in enumerate(columns)}, "clause string")
    fitted = {c.clause for c in columns}
    for i, (n1, _) in enumerate(data.counts):
        if i not in fitted:
            constant = F.lit(1.0 if n1 else 0.0)
            found = found.unionByName(rows.select("doc_id", constant.alias("prob"), F.lit(data.clauses[i]).alias("clause")))
    return found.select("doc_id", "clause", "prob")


def coefficient_rows(data, columns, weights):
    """(clause, term, weight) of all coefficients that aren't 0; terms x clauses numbers."""
    term_ids, which = weights.nonzero()
    names = [data.clauses[c.clause] for c in columns]
    rows = pd.DataFrame({"term_id": term_ids.astype("int32"), "clause": [names[k] for k in which], "weight": weights[term_ids, which]})
    table = data.vocabulary.sparkSession.createDataFrame(rows, "term_id int, clause string, weight double")
    return table.join(data.vocabulary.select("term_id", "term"), "term_id").select("clause", "term", "weight")


@register("model_logistic")
def model_logistic(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE).packed()
    columns = logistic_columns(data)
    weights, bias, _ = fitted_linear(data, columns)
    return linear.judged(linear_scores_of(data, data.test_rows, columns, weights, bias), data.test_labels)


@register(
    "model_logistic_stationarity",
    with_scores("""SELECT clause, true AS stationary, count(*)::BIGINT AS n_train, sum(y)::BIGINT AS n_pos FROM scores
WHERE split = 'train' GROUP BY clause HAVING sum(y) > 0 AND sum(1 - y) > 0"""),
)
def model_logistic_stationarity(spark, sf_dir):
    """The gradient of the fitted coefficients, worked out anew from the term weights by joins and sums: none is above 0.0001."""
    data = Data(spark, sf_dir, *WHOLE).packed()
    columns = logistic_columns(data)
    weights, bias, _ = fitted_linear(data, columns)
    coefficients = cut_lineage(coefficient_rows(data, columns, weights))
    known = [(data.clauses[c.clause], float(bias[k]), c.weight_pos / c.n, c.weight_neg / c.n, 1.0 / (c.c * c.n)) for k, c in enumerate(columns)]
    known = spark.createDataFrame(known, "clause string, bias double, pos double, neg double, penalty double")
    entries = data.weights.select("doc_id", "term", F.col("weight").alias("x"))
    margin = entries.join(coefficients, "term").groupBy("doc_id", "clause").agg(F.sum(F.col("x") * F.col("weight")).alias("margin"))
    rows = data.train_labels.select("doc_id", "clause", "y").join(F.broadcast(known), "clause").join(margin, ["doc_id", "clause"], "left")
    z = F.coalesce("margin", F.lit(0.0)) + F.col("bias")
    push = F.when(F.col("y") == 1, -F.col("pos") / (1 + F.exp(z))).otherwise(F.col("neg") / (1 + F.exp(-z)))
    rows = cut_lineage(rows.select("doc_id", "clause", "y", push.alias("push")))
    of_terms = entries.join(rows, "doc_id").groupBy("clause", "term").agg(F.sum(F.col("x") * F.col("push")).alias("slope"))
    of_terms = of_terms.join(coefficients, ["clause", "term"], "left").join(F.broadcast(known), "clause")
    slope = F.abs(F.col("slope") + F.coalesce("weight", F.lit(0.0)) * F.col("penalty"))
    largest = of_terms.groupBy("clause").agg(F.max(slope).alias("largest"))
    sums = rows.groupBy("clause").agg(F.abs(F.sum("push")).alias("of_bias"), F.count("*").alias("n_train"), F.sum("y").cast("long").alias("n_pos"))
    stationary = (F.col("largest") < 1e-4) & (F.col("of_bias") < 1e-4)
    return sums.join(largest, "clause").select("clause", stationary.alias("stationary"), "n_train", "n_pos")


@register("model_calibrated_svm")
def model_calibrated_svm(spark, sf_dir):
    """Squared-hinge columns of every clause and fold in one fit; each fold's margins calibrate the column that didn't see it."""
    data = Data(spark, sf_dir, *WHOLE).packed()
    return linear.judged(calibrated_svm(data), data.test_labels)


FOLDS = 3


def calibrated_svm(data):
    folds = data.rows.withColumn("fold", hash_bucket("doc_id", 7, FOLDS))
    usable = [i for i, c in enumerate(data.counts) if min(c) >= FOLDS]
    columns = [S.balanced(i, data.counts[i], without_fold=k, loss="squared hinge") for i in usable for k in range(FOLDS)]
    weights, bias, _ = S.minimise(S.row_blocks(folds, len(data.clauses), "fold"), data.spec.max_features, columns)
    of_column = {k: (data.clauses[c.clause], c.clause, c.without_fold) for k, c in enumerate(columns)}
    names = "clause string, number int, fold int"
    held = S.named(S.margins(data.rows, weights, bias), of_column, names).where(F.col("fold") == hash_bucket("doc_id", 7, FOLDS))
    held = linear.judged(held, data.train_labels.select("doc_id", "clause", "y"))
    fitted = S.platt(held.select(F.col("number").alias("clause"), "fold", "margin", "y"))
    sigmoids = {k: (*of_column[k], *fitted.get((c.clause, c.without_fold), (0.0, 0.0))) for k, c in enumerate(columns)}
    scores = S.named(S.margins(data.test_rows, weights, bias), sigmoids, names + ", a double, b double")
    prob = F.avg(1 / (1 + F.exp(-(F.col("a") * F.col("margin") + F.col("b"))))).alias("prob")
    scores = scores.groupBy("doc_id", "clause").agg(prob)
    rest = [c for i, c in enumerate(data.clauses) if i not in usable]
    if rest:
        zeros = data.test_rows.select("doc_id", F.explode(F.array(*map(F.lit, rest))).alias("clause"), F.lit(0.0).alias("prob"))
        scores = scores.unionByName(zeros)
    return scores


LSA_DIMS = 256


def lsa_tables(data):
    """Training and test documents on the first singular vectors of the training documents, each written once."""
    basis, _ = S.singular_vectors(S.row_blocks(data.rows, len(data.clauses)), data.spec.max_features, LSA_DIMS)
    return tuple(cut_lineage(S.projected(rows, basis)) for rows in (data.rows, data.test_rows))


@register("model_lsa_random_forest")
def model_lsa_random_forest(spark, sf_dir):
    """Forests of 200 trees of every clause on 256 dimensions."""
    data = Data(spark, sf_dir, *WHOLE).packed()
    train, test = (t.select("doc_id", array_to_vector("lsa").alias("features")) for t in lsa_tables(data))
    table = C.training_table(train, data.train_labels, data.clauses)
    models = C.fit_per_clause(table, data.train_labels, data.clauses, C.random_forest())
    return linear.judged(C.score(models, test), data.test_labels)


@register("lsa_explained_variance")
def lsa_explained_variance(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE).packed()
    train, _ = lsa_tables(data)
    return blocks.explained_variance(train, data.weights, LSA_DIMS)


@register("model_selected_terms_logistic")
def model_selected_terms_logistic(spark, sf_dir):
    """Logistic regression on each clause's own chi-square terms."""
    data = Data(spark, sf_dir, *WHOLE).packed()
    labelled = linear.with_labels(V.by_document(data.train), data.train_labels, data.clauses)
    weights = V.transform(labelled, data.vocabulary, data.spec, carry=linear.mask_names(len(data.clauses)), placed=True)
    sums = linear.term_sums(weights, len(data.clauses), "weight")
    shares = data.train_labels.groupBy("clause").agg(F.avg("y").alias("share"))
    chosen = blocks.select_k(blocks.chi2(sums, shares, data.clauses), 100).join(data.vocabulary.select("term", "term_id"), "term")
    place = {c: i for i, c in enumerate(data.clauses)}
    columns = [S.balanced(i, c, c=0.5 if c[0] < 10 else 1.0) for i, c in enumerate(data.counts) if min(c) > 0]
    of_clause = {c.clause: k for k, c in enumerate(columns)}
    mask = np.zeros((data.spec.max_features, len(columns)))
    for r in chosen.select("clause", "term_id").collect():  # clauses x k rows
        if place[r["clause"]] in of_clause:
            mask[r["term_id"], of_clause[place[r["clause"]]]] = 1.0
    fitted, bias, _ = fitted_linear(data, columns, mask)
    return linear.judged(linear_scores_of(data, data.test_rows, columns, fitted, bias), data.test_labels)


@register("model_hybrid_vectors")
def model_hybrid_vectors(spark, sf_dir):
    """TF-IDF next to the mean-pooled vectors of the document's group."""
    data = Data(spark, sf_dir, *WHOLE).vectors()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pooled = blocks.pooled_array(vectors.withColumn("group_id", F.col("label")), "group_id", 64)

    def joined(sparse):
        dense = sparse.select("doc_id", (F.col("doc_id") % 10).cast("int").alias("group_id")).join(F.broadcast(pooled), "group_id")
        return blocks.hybrid(sparse, dense.select("doc_id", "pooled")).withColumnRenamed("hybrid", "features")

    table = C.training_table(joined(data.table.select("doc_id", "features")), data.train_labels, data.clauses)
    models = C.fit_per_clause(table, data.train_labels, data.clauses, C.logistic())
    return linear.judged(C.score(models, joined(data.test_vectors)), data.test_labels)


@register("model_feature_importances")
def model_feature_importances(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE).packed()
    return reports.top_importances(B.importances(data.boosted(B.Boosting()), data.vocabulary), 20)


@register("model_signed_coefficients")
def model_signed_coefficients(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE).packed()
    columns = logistic_columns(data)
    return reports.top_signed(coefficient_rows(data, columns, fitted_linear(data, columns)[0]), 15)


@register("production_evaluation")
def production_evaluation(spark, sf_dir):
    """The fitted trees of all clauses, class-prior thresholds and the evaluation record on the test documents."""
    data = Data(spark, sf_dir, *WHOLE)
    bundle = production.train_boosted(data.train, data.train_labels, data.clauses, data.spec)
    return production.evaluate(bundle, data.test, data.test_labels)


def _out_of_fold_sql() -> str:
    """Every fold is a copy of the training rows of the other folds; all steps run per fold."""
    clauses = ", ".join(quoted(c) for c in CLAUSE_NAMES)
    return f"""WITH {SCORES_SQL},
labels AS (SELECT doc_id, clause, y FROM scores WHERE clause IN ({clauses}) AND split = 'train'),
train AS (SELECT doc_id, text FROM contracts WHERE {hash_bucket_sql()} >= 20),
perm AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS r, count(*) OVER () AS n FROM train),
folds AS (SELECT doc_id, least((r - 1) // (n // 3), 2)::INT AS fold FROM perm),
others AS (SELECT f, doc_id FROM folds, (SELECT unnest([0, 1, 2]) AS f) WHERE fold <> f),
{counts_cte(grams_sql(1, 2, 'train'))},
vocab AS (SELECT f, term FROM (SELECT f, term, count(*) AS df, sum(tf) AS cf FROM counts JOIN others USING (doc_id) GROUP BY 1, 2)
  JOIN (SELECT f, count(*) AS n FROM others GROUP BY f) USING (f) WHERE df >= 2 AND df <= 0.95::DOUBLE * n
  QUALIFY row_number() OVER (PARTITION BY f ORDER BY cf DESC, term) <= {V.BIGRAMS_20K.max_features}),
kept AS (SELECT f, doc_id, term, tf FROM counts JOIN others USING (doc_id) SEMI JOIN vocab USING (f, term)),
cls AS (SELECT f, clause, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM labels JOIN others USING (doc_id) GROUP BY 1, 2),
tot AS (SELECT f, term, sum(tf)::DOUBLE AS total FROM kept GROUP BY 1, 2),
pos AS (SELECT f, clause, term, sum(tf)::DOUBLE AS p FROM kept JOIN labels USING (doc_id) WHERE y = 1 GROUP BY 1, 2, 3),
sums AS (SELECT cls.f, cls.clause, tot.term, total, coalesce(p, 0) AS p, n1, n0
  FROM cls JOIN tot USING (f) LEFT JOIN pos USING (f, clause, term)),
coef AS (SELECT f, clause, term, ln((p + 0.5) / (sum(p) OVER c + 0.5 * count(*) OVER c))
    - ln((total - p + 0.5) / (sum(total - p) OVER c + 0.5 * count(*) OVER c)) AS w, ln(n1 / n0) AS bias
  FROM sums WINDOW c AS (PARTITION BY f, clause)),
margin AS (SELECT doc_id, clause, sum(tf * w) AS m FROM counts JOIN folds USING (doc_id)
  JOIN coef ON coef.f = folds.fold AND coef.term = counts.term GROUP BY 1, 2)
SELECT l.doc_id, l.clause, fold, round(1 / (1 + exp(-(coalesce(m, 0) + bias))), 5) AS prob, y
FROM labels l JOIN folds USING (doc_id) JOIN (SELECT f AS fold, clause, any_value(bias) AS bias FROM coef GROUP BY 1, 2) b USING (fold, clause)
LEFT JOIN margin USING (doc_id, clause)"""


@register("experiment_out_of_fold", _out_of_fold_sql())
def experiment_out_of_fold(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE)
    train = V.counted_texts(data.train, data.spec)
    scores = X.out_of_fold(train, data.train_labels, X.naive_bayes(*WHOLE, counted=True), 3)
    return scores.withColumn("prob", F.round("prob", 5))


@register("experiment_cross_validated_thresholds")
def experiment_cross_validated_thresholds(spark, sf_dir):
    data = Data(spark, sf_dir, *WHOLE)
    train, test = data.counted()
    return X.cross_validated(train, data.train_labels, test, data.test_labels, X.naive_bayes(*WHOLE, counted=True), 3)


@register("experiment_regularisation_sweep")
def experiment_regularisation_sweep(spark, sf_dir):
    """Metrics at every inverse penalty, all fitted as one block; the best by macro-F1 and by HR-F1 are marked."""
    data = Data(spark, sf_dir, *WHOLE).packed()
    columns = [c for value in X.C_VALUES for c in logistic_columns(data, c=value)]
    weights, bias, _ = fitted_linear(data, columns)
    scores = S.margins(data.test_rows, weights, bias).withColumn("prob", S.probability())
    scores = S.named(scores, {k: (data.clauses[c.clause], f"C={c.c}") for k, c in enumerate(columns)}, "clause string, arm string")
    return X.with_best(X.judge_arms(scores, data.test_labels))


@register("experiment_vocabulary_sizes")
def experiment_vocabulary_sizes(spark, sf_dir):
    """Logistic regression on the most frequent terms of five sizes: terms are counted and ranked once, a size is a prefix of the
    ranks, and all clauses of a size are fitted as one block."""
    data = Data(spark, sf_dir, CLAUSE_NAMES, V.TermSpec(hi=2, max_features=max(SIZES)))
    vocabulary = cut_lineage(by_rank(V.fit(data.train, data.spec)))
    data.packed(vocabulary)
    return X.judge_arms(scores_by_size(data, SIZES), data.test_labels)


def scores_by_size(data, sizes):
    """(doc_id, clause, arm, prob) of the test rows. Sizes are fitted one after the other on the same blocks, each as wide as it
    is, since L-BFGS keeps some twenty matrices of its terms x columns on the driver."""
    row_blocks, scores = S.row_blocks(data.rows, len(data.clauses)), None
    for size in sizes:
        columns = logistic_columns(data, terms=size)
        weights, bias, _ = S.minimise(row_blocks, size, columns)
        part = S.margins(data.test_rows, weights, bias, [size] * len(columns)).withColumn("prob", S.probability())
        part = S.named(part, {k: (data.clauses[c.clause], f"{size}") for k, c in enumerate(columns)}, "clause string, arm string")
        scores = part if scores is None else scores.unionByName(part)
    return scores


SIZES = [5_000, 10_000, 20_000, 50_000, 100_000]


def by_rank(vocabulary):
    """The vocabulary with its rank by corpus frequency as term id, so that every smaller vocabulary is a prefix of it."""
    return V.rank_terms(vocabulary).withColumn("term_id", (F.col("rank") - 1).cast("int")).drop("rank")


@register(
    "vocabulary_nested_sizes",
    f"""WITH {CONTRACTS_SQL}, train AS (SELECT doc_id, text FROM contracts WHERE {hash_bucket_sql()} >= 20),
{counts_cte(grams_sql(1, 2, 'train'))}, {vocab_cte(100000, '(SELECT count(*) FROM train)')},
ranked AS (SELECT term, idf, row_number() OVER (ORDER BY cf DESC, term) AS rank FROM vocab),
sizes AS (SELECT unnest([{', '.join(map(str, SIZES))}]) AS size),
norms AS (SELECT size, doc_id, sqrt(sum(((1 + ln(tf)) * idf) ** 2)) AS norm
  FROM counts JOIN ranked USING (term) JOIN sizes ON rank <= size GROUP BY 1, 2)
SELECT size::BIGINT AS size, least(size, (SELECT count(*) FROM ranked))::BIGINT AS n_terms, count(*)::BIGINT AS n_documents,
  round(avg(norm), 4) AS mean_norm FROM norms GROUP BY size""",
)
def vocabulary_nested_sizes(spark, sf_dir):
    """Terms and mean length of the documents' vectors in every nested vocabulary, from one counting of the terms."""
    docs = hash_split(contracts(spark, sf_dir).select("doc_id", "text")).where("split = 'train'").drop("split")
    spec = V.TermSpec(hi=2, max_features=max(SIZES))
    vocabulary = cut_lineage(by_rank(V.fit(docs, spec)))
    counts = V.count_terms(docs, spec).join(vocabulary.select("term", "term_id", "idf"), "term")
    square = (V.tf_weight(F.col("tf"), spec.sublinear) * F.col("idf")) ** 2
    sums = counts.groupBy("doc_id").agg(*[F.sum(F.when(F.col("term_id") < n, square)).alias(f"s{n}") for n in SIZES])
    long = sums.select(F.inline(F.array(*[F.struct(F.lit(n).cast("long").alias("size"), F.sqrt(f"s{n}").alias("norm")) for n in SIZES])))
    found = long.where("norm is not null").groupBy("size").agg(F.count("*").alias("n_documents"), F.round(F.avg("norm"), 4).alias("mean_norm"))
    terms = vocabulary.agg(F.count("*")).scalar()
    return found.select("size", F.least("size", terms).alias("n_terms"), "n_documents", "mean_norm")


@register("experiment_ablation")
def experiment_ablation(spark, sf_dir):
    """The champion's trees and five runs with one part changed each, all grown together."""
    data = Data(spark, sf_dir, *WHOLE)
    scores = X.grow_arms(X.ablation_arms(), data.train, data.train_labels, data.test, data.clauses)
    return X.with_deltas(X.judge_arms(scores, data.test_labels), "champion")


@register("experiment_tree_search")
def experiment_tree_search(spark, sf_dir):
    """Twenty drawn settings on the high-risk clauses and 5,000 terms, by HR-F1 on a held-out fifth of the training documents; the
    best is fitted again on all clauses and terms and judged on the test documents (``fit`` is whole there)."""
    high = [c for c in CLAUSE_NAMES if c in RISK_VERSIONS["production"]["HIGH"]]
    data = Data(spark, sf_dir, high, V.TermSpec(hi=2, max_features=5_000))
    held = hash_bucket("doc_id", 11, 5) == 0
    data.packed(V.fit(data.train.where(~held), data.spec))
    trials = X.draw_trials()
    bins = B.Bins.of(B.bin_edges(B.unpacked(data.rows.where(~held)), min_rows=min(t.min_rows for t in trials)))
    counts = linear.positives_and_negatives(data.train_labels.where(~held), high)
    found = X.search(B.binned_blocks(data.rows, bins, len(high), held=held), bins, counts, high, trials)
    best = max(found, key=lambda r: (r[2], r[1], -r[0]))[0]
    whole = Data(spark, sf_dir, *WHOLE).packed()
    score = X.judge(B.score(whole.boosted(trials[best]), whole.test_rows), whole.test_labels).first()["hr_f1"]
    settings = ("depth", "rate", "columns", "rows", "min_rows", "l2", "pos_weight_mult")
    rows = [(t, "proxy", trees, *(float(getattr(trials[t], k)) for k in settings), s) for t, trees, s in found]
    rows.append((best, "whole", trials[best].trees, *(float(getattr(trials[best], k)) for k in settings), score))
    return spark.createDataFrame(rows, "trial int, fit string, trees int, " + ", ".join(f"{k} double" for k in settings) + ", score double")


@register("model_block_importances")
def model_block_importances(spark, sf_dir):
    """What each block of the stacked features brings to the boosted trees of every clause: its share of the gain, its splits,
    and its best feature."""
    data = Data(spark, sf_dir, CLAUSE_NAMES, V.BIGRAMS_20K)
    stacked, space = stacked_blocks(data.train)
    stacked = cut_lineage(stacked)
    dense = stacked.where("block = 'dense'")
    scales = cut_lineage(dense.groupBy("block", "feature").agg((1 / F.max("weight")).alias("scale")))  # bins are parts of 0 to 1
    placed = blocks.positioned(stacked, space, scales)
    weights = placed.select("doc_id", F.col("position").alias("term_id"), "weight")
    data.rows = cut_lineage(B.packed(weights, data.train).join(linear.label_table(data.train_labels, data.clauses), "doc_id"))
    data.counts = linear.positives_and_negatives(data.train_labels, data.clauses)
    names = space.select(F.col("position").alias("term_id"), F.concat_ws("|", "block", "feature").alias("term"))
    found = B.importances(data.boosted(B.Boosting()), names)
    block = F.split("term", "[|]", 2)
    found = found.select("clause", block[0].alias("block"), block[1].alias("feature"), "weight", "splits")
    best = F.min_by("feature", F.struct(-F.col("weight"), "feature")).alias("best_feature")
    return found.groupBy("clause", "block").agg(F.sum("weight").alias("weight"), F.sum("splits").alias("splits"), best)
