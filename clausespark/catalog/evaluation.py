"""Thresholds, metrics, error analysis, comparison and routing over stored score rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clausespark.catalog import register
from clausespark.catalog.corpus import in_list, risk_sql
from clausespark.catalog.inputs import clause_scores, contracts, hash_bucket_sql, quoted, with_scores
from clausespark.catalog.terms import COMPLEMENT_COEF, NB_BASE, NB_CLAUSES, NB_COEF, NB_SCORE, NB_SPEC, _nb_inputs
from clausespark.catalog.text_features import WORDS_SQL
from clausespark.fixed.taxonomy import RISK_VERSIONS
from clausespark.functions import text as X
from clausespark.operators import analysis as A
from clausespark.operators import ensembles as E
from clausespark.operators import linear
from clausespark.operators import metrics as M
from clausespark.operators import thresholds as T
from clausespark.operators.splits import hash_bucket, hash_split
from clausespark.session import cut_lineage

HIGH_SQL = in_list(RISK_VERSIONS["production"]["HIGH"])
F1_SQL = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END"


def stored_scores(spark, sf_dir):
    """Score rows written once; every policy below is a query over them."""
    return cut_lineage(clause_scores(spark, sf_dir))


def halves(spark, sf_dir):
    scores = stored_scores(spark, sf_dir)
    return scores.where("split = 'train'").drop("split"), scores.where("split = 'test'").drop("split")


def rounded(df, places=6):
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


PRIOR = "prior AS (SELECT clause, avg(y) AS thr FROM scores WHERE split = 'train' GROUP BY clause)"
TEST = "test AS (SELECT doc_id, clause, prob, y FROM scores WHERE split = 'test')"
TRAIN = "train AS (SELECT doc_id, clause, prob, y FROM scores WHERE split = 'train')"
PREDS = f"{PRIOR}, {TEST}, preds AS (SELECT t.*, thr, (prob >= thr)::INT AS pred FROM test t JOIN prior USING (clause))"
CONF = """conf AS (SELECT clause, sum(y * pred)::BIGINT AS tp, sum((1 - y) * pred)::BIGINT AS fp,
  sum(y * (1 - pred))::BIGINT AS fn, sum((1 - y) * (1 - pred))::BIGINT AS tn FROM preds GROUP BY clause)"""
PER = f"""per AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, {F1_SQL} AS f1, tp + fn AS n_positive FROM conf)"""
ALL = f"{PREDS}, {CONF}, {PER}"


def predictions(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return train, T.apply_thresholds(test, T.class_prior(train))


# ---- thresholds ------------------------------------------------------------------------


@register("threshold_class_prior", with_scores(f", {PRIOR} SELECT clause, round(thr, 6) AS thr FROM prior"))
def threshold_class_prior(spark, sf_dir):
    return rounded(T.class_prior(clause_scores(spark, sf_dir).where("split = 'train'")))


@register(
    "threshold_fixed_half",
    with_scores("SELECT doc_id, clause, 0.5::DOUBLE AS thr, (prob >= 0.5)::INT AS pred FROM scores"),
)
def threshold_fixed_half(spark, sf_dir):
    return T.fixed_threshold(clause_scores(spark, sf_dir)).select("doc_id", "clause", "thr", "pred")


@register(
    "threshold_apply",
    with_scores(
        f""", {PRIOR}, {TEST} SELECT doc_id, clause, prob, y, round(coalesce(p.thr, 0.5), 6) AS thr,
  (prob >= coalesce(p.thr, 0.5))::INT AS pred
FROM test LEFT JOIN (SELECT * FROM prior WHERE clause <> 'Insurance') p USING (clause)"""
    ),
)
def threshold_apply(spark, sf_dir):
    """One clause is left without a threshold, so that it takes the default."""
    train, test = halves(spark, sf_dir)
    thresholds = T.class_prior(train).where(F.col("clause") != "Insurance")
    return rounded(T.apply_thresholds(test, thresholds))


def _grid_sql(values, source: str) -> str:
    listed = ", ".join(f"{v!r}::DOUBLE" for v in values)
    return f"""cells AS (SELECT clause, t AS thr, sum(y * (prob >= t)::INT)::BIGINT AS tp,
    sum((1 - y) * (prob >= t)::INT)::BIGINT AS fp, sum(y * (prob < t)::INT)::BIGINT AS fn
  FROM {source}, (SELECT unnest([{listed}]) AS t) GROUP BY clause, t)"""


SCUT_SQL = f"""{_grid_sql(sorted([*T.SCUT_GRID, 0.5]), 'train')},
scut AS (SELECT clause, thr, {F1_SQL} AS f1 FROM cells
  QUALIFY row_number() OVER (PARTITION BY clause ORDER BY f1 DESC, (thr <> 0.5), thr) = 1)"""


@register(
    "threshold_scut",
    with_scores(f", {TRAIN}, {SCUT_SQL} SELECT clause, round(thr, 6) AS thr, round(f1, 6) AS f1 FROM scut"),
)
def threshold_scut(spark, sf_dir):
    return rounded(T.scut(clause_scores(spark, sf_dir).where("split = 'train'")))


@register(
    "threshold_best_diagnostic",
    with_scores(
        f""", {TEST}, {_grid_sql(T.SCUT_GRID, 'test')}
SELECT clause, round(CASE WHEN f1 > 0 THEN thr ELSE 0.5 END, 6) AS thr, round(f1, 6) AS f1 FROM (
  SELECT clause, thr, {F1_SQL} AS f1 FROM cells
  QUALIFY row_number() OVER (PARTITION BY clause ORDER BY f1 DESC, thr) = 1)"""
    ),
)
def threshold_best_diagnostic(spark, sf_dir):
    return rounded(T.best_threshold(clause_scores(spark, sf_dir).where("split = 'test'")))


PCUT_SQL = """pcut AS (SELECT doc_id, clause, prob, y, (r <= k)::INT AS pred FROM (
  SELECT t.*, row_number() OVER (PARTITION BY clause ORDER BY prob DESC, doc_id) AS r,
    least(greatest(1, round_even(thr * count(*) OVER (PARTITION BY clause), 0)), count(*) OVER (PARTITION BY clause)) AS k
  FROM test t JOIN prior USING (clause)))"""


@register(
    "threshold_pcut",
    with_scores(f", {PRIOR}, {TEST}, {PCUT_SQL} SELECT doc_id, clause, y, pred FROM pcut"),
)
def threshold_pcut(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return T.pcut(test, T.class_prior(train)).select("doc_id", "clause", "y", "pred")


@register(
    "threshold_adaptive",
    with_scores(
        f""", {PRIOR}, {TRAIN}, {TEST}, {SCUT_SQL}, {PCUT_SQL}
SELECT doc_id, clause, y, CASE WHEN prior.thr < 0.10 THEN pred ELSE (prob >= scut.thr)::INT END AS pred
FROM pcut JOIN prior USING (clause) JOIN scut USING (clause)"""
    ),
)
def threshold_adaptive(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    preds = T.adaptive(test, T.class_prior(train), T.scut(train))
    return preds.select("doc_id", "clause", "y", "pred")


def _scales_sql(values, source: str) -> str:
    listed = ", ".join(f"{v!r}::DOUBLE" for v in values)
    return f"""cells AS (SELECT clause, s AS scale, sum(y * (prob >= s * thr)::INT)::BIGINT AS tp,
    sum((1 - y) * (prob >= s * thr)::INT)::BIGINT AS fp, sum(y * (prob < s * thr)::INT)::BIGINT AS fn
  FROM {source} JOIN prior USING (clause), (SELECT unnest([{listed}]) AS s) GROUP BY clause, s),
sweep AS (SELECT scale, avg(f1) AS macro_f1, coalesce(avg(f1) FILTER (clause IN {HIGH_SQL}), 0) AS hr_f1
  FROM (SELECT *, {F1_SQL} AS f1 FROM cells WHERE tp + fn > 0) GROUP BY scale)"""


@register(
    "threshold_scale_sweep_diagnostic",
    with_scores(
        f""", {PRIOR}, {TEST}, {_scales_sql(T.DIAGNOSTIC_SCALES, 'test')}
SELECT scale, round(macro_f1, 6) AS macro_f1, round(hr_f1, 6) AS hr_f1 FROM sweep"""
    ),
)
def threshold_scale_sweep_diagnostic(spark, sf_dir):
    train, test = halves(spark, sf_dir)
    return rounded(T.scale_sweep(test, T.class_prior(train), T.DIAGNOSTIC_SCALES))


@register(
    "threshold_scaled_prior",
    with_scores(
        f""", {PRIOR}, {TRAIN}, validation AS (SELECT * FROM train WHERE {hash_bucket_sql(seed=7)} < 20), {_scales_sql(T.VALIDATION_SCALES, 'validation')},
picked AS (SELECT scale FROM sweep ORDER BY round(macro_f1, 9) DESC, scale LIMIT 1)
SELECT clause, scale, round(thr * scale, 6) AS thr FROM prior, picked"""
    ),
)
def threshold_scaled_prior(spark, sf_dir):
    """The scale is picked on a fifth of the training documents and multiplies every clause's rate."""
    train, _ = halves(spark, sf_dir)
    rates = T.class_prior(train)
    validation = train.where(hash_bucket("doc_id", 7) < 20)
    return rounded(T.scaled_prior(rates, T.pick_scale(T.scale_sweep(validation, rates, T.VALIDATION_SCALES))))


CURVE = """points AS (SELECT clause, prob, sum(sum(y)) OVER d AS tp, sum(count(*)) OVER d AS flagged,
    sum(sum(y)) OVER c AS n_pos, sum(count(*)) OVER c AS n_all, sum(y) AS pos, count(*) AS n
  FROM test GROUP BY clause, prob
  WINDOW d AS (PARTITION BY clause ORDER BY prob DESC), c AS (PARTITION BY clause))"""


@register(
    "score_curve",
    with_scores(
        f""", {TEST}, {CURVE} SELECT clause, prob, tp::BIGINT AS tp, flagged::BIGINT AS flagged,
  n_pos::BIGINT AS n_pos, n_all::BIGINT AS n_all FROM points"""
    ),
)
def score_curve(spark, sf_dir):
    test = clause_scores(spark, sf_dir).where("split = 'test'")
    return T.curve(test).select("clause", "prob", "tp", "flagged", "n_pos", "n_all")


@register(
    "threshold_roc_youden",
    with_scores(
        f""", {TEST}, {CURVE} SELECT clause, CASE WHEN n_pos = 0 OR n_pos = n_all THEN 0.5
  WHEN g > 0 THEN prob ELSE 'infinity'::DOUBLE END AS thr
FROM (SELECT *, tp / n_pos - (flagged - tp) / (n_all - n_pos) AS g FROM points)
QUALIFY row_number() OVER (PARTITION BY clause ORDER BY g DESC, prob DESC) = 1"""
    ),
)
def threshold_roc_youden(spark, sf_dir):
    return T.roc_youden(T.curve(clause_scores(spark, sf_dir).where("split = 'test'")))


@register(
    "threshold_pr_youden",
    with_scores(
        f""", {TEST}, {CURVE} SELECT clause, prob AS thr FROM points WHERE n_pos > 0
QUALIFY row_number() OVER (PARTITION BY clause ORDER BY tp / flagged + tp / n_pos - 1 DESC, prob) = 1"""
    ),
)
def threshold_pr_youden(spark, sf_dir):
    return T.pr_youden(T.curve(clause_scores(spark, sf_dir).where("split = 'test'")))


FLOOR_SQL = f"""SELECT clause, CASE WHEN ok THEN prob ELSE 0.5 END AS thr FROM (
  SELECT clause, prob, (r >= 0.80 AND f > 0) AS ok, f FROM (
    SELECT clause, prob, tp / n_pos AS r, 2 * (tp / flagged) * (tp / n_pos) / greatest(tp / flagged + tp / n_pos, 1e-9) AS f
    FROM points WHERE n_pos > 0 AND clause IN {HIGH_SQL}))
QUALIFY row_number() OVER (PARTITION BY clause ORDER BY ok DESC, f DESC, prob) = 1"""


@register("threshold_recall_floor", with_scores(f", {TEST}, {CURVE} {FLOOR_SQL}"))
def threshold_recall_floor(spark, sf_dir):
    return T.recall_floor(T.curve(clause_scores(spark, sf_dir).where("split = 'test'")))


@register(
    "threshold_legal_review",
    with_scores(
        f""", {PRIOR}, {TEST}, {CURVE}, floors AS ({FLOOR_SQL})
SELECT clause, round(coalesce(f.thr, p.thr), 6) AS thr FROM prior p FULL JOIN floors f USING (clause)"""
    ),
)
def threshold_legal_review(spark, sf_dir):
    """High-risk clauses get the recall floor, the others keep their prior."""
    train, test = halves(spark, sf_dir)
    return rounded(T.override(T.class_prior(train), T.recall_floor(T.curve(test))))


@register(
    "threshold_global_sweep",
    with_scores(
        f""", {TEST}, {_grid_sql(T.GLOBAL_GRID, 'test')} SELECT round(thr, 6) AS thr, round(avg(f1), 6) AS macro_f1,
  round(coalesce(avg(f1) FILTER (clause IN {HIGH_SQL}), 0), 6) AS hr_f1, round(avg(r), 6) AS recall, round(avg(p), 6) AS precision
FROM (SELECT *, {F1_SQL} AS f1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p FROM cells) GROUP BY thr"""
    ),
)
def threshold_global_sweep(spark, sf_dir):
    return rounded(T.global_sweep(clause_scores(spark, sf_dir).where("split = 'test'")))


# ---- metrics ---------------------------------------------------------------------------


@register("metrics_confusion", with_scores(f", {PREDS}, {CONF} SELECT * FROM conf"))
def metrics_confusion(spark, sf_dir):
    return M.confusion(predictions(spark, sf_dir)[1])


@register(
    "metrics_per_clause",
    with_scores(
        f""", {ALL} SELECT clause, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, n_positive FROM per WHERE n_positive > 0"""
    ),
)
def metrics_per_clause(spark, sf_dir):
    return rounded(M.per_clause(predictions(spark, sf_dir)[1]))


def _summary_sql(source: str) -> str:
    return f"""SELECT round(avg(f1), 6) AS macro_f1, round(avg(precision), 6) AS macro_precision,
  round(avg(recall), 6) AS macro_recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1,
  round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS micro_recall,
  round(coalesce(avg(f1) FILTER (clause IN {HIGH_SQL} AND n_positive > 0), 0), 6) AS hr_f1, count(*) AS n_clauses
FROM {source}"""


@register("metrics_macro_active", with_scores(f", {ALL} {_summary_sql('per WHERE n_positive > 0')}"))
def metrics_macro_active(spark, sf_dir):
    return rounded(M.summary(M.per_clause(predictions(spark, sf_dir)[1])))


@register("metrics_macro_all", with_scores(f", {ALL} {_summary_sql('per')}"))
def metrics_macro_all(spark, sf_dir):
    return rounded(M.summary(M.per_clause(predictions(spark, sf_dir)[1], active_only=False)))


AUC_SQL = """areas AS (SELECT clause, sum(pos * (n_all - n_pos - (flagged - tp) + (n - pos) / 2.0))
    / (any_value(n_pos) * any_value(n_all - n_pos)) AS auc FROM points WHERE n_pos > 0 AND n_pos < n_all GROUP BY clause)"""
# The same area from its definition: the share of positive/negative pairs put in order.
AUC_PAIRS_SQL = """SELECT p.clause, round(avg(CASE WHEN p.prob > q.prob THEN 1.0 WHEN p.prob = q.prob THEN 0.5 ELSE 0.0 END), 6) AS auc
FROM test p JOIN test q USING (clause) WHERE p.y = 1 AND q.y = 0 GROUP BY p.clause"""


@register("metrics_auc", with_scores(f", {TEST} {AUC_PAIRS_SQL}"))
def metrics_auc(spark, sf_dir):
    return rounded(M.auc(T.curve(clause_scores(spark, sf_dir).where("split = 'test'"))))


@register(
    "metrics_evaluation_record",
    with_scores(
        f""", {ALL}, {CURVE}, {AUC_SQL}
SELECT *, (SELECT round(avg(auc), 6) FROM areas) AS macro_auc FROM ({_summary_sql('per WHERE n_positive > 0')})"""
    ),
)
def metrics_evaluation_record(spark, sf_dir):
    return rounded(M.evaluate(predictions(spark, sf_dir)[1]))


@register(
    "metrics_by_risk_level",
    with_scores(
        f""", {ALL} SELECT {risk_sql()} AS risk_level, round(avg(f1), 6) AS mean_f1, count(*) AS n_clauses
FROM per WHERE n_positive > 0 GROUP BY 1"""
    ),
)
def metrics_by_risk_level(spark, sf_dir):
    return rounded(M.by_risk_level(M.per_clause(predictions(spark, sf_dir)[1])))


@register(
    "metrics_keyword_baseline",
    with_scores(
        f""", {TEST}, preds AS (SELECT *, (prob > 0)::INT AS pred FROM test), {CONF}, {PER}
{_summary_sql('per WHERE n_positive > 0')}"""
    ),
)
def metrics_keyword_baseline(spark, sf_dir):
    """Keyword rules judged on the passage labels: a hit of any phrase predicts the clause."""
    from clausespark.operators.rules import keyword_predictions
    from clausespark.operators.splits import hash_split

    docs = hash_split(contracts(spark, sf_dir).select("doc_id", "text")).where("split = 'test'")
    truth = clause_scores(spark, sf_dir).where("split = 'test'").select("doc_id", "clause", "y")
    preds = truth.join(keyword_predictions(docs), ["doc_id", "clause"])
    return rounded(M.summary(M.per_clause(preds)))


@register(
    "timing_summary",
    """SELECT event_type, count(*) AS n, round(avg(ms), 6) AS mean, median(ms)::DOUBLE AS median,
  round(count(*) * 1000 / sum(ms), 6) AS per_thousand
FROM (SELECT event_type, floor(value * 1000)::BIGINT AS ms FROM events) GROUP BY event_type""",
)
def timing_summary(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    timings = events.select("event_type", F.floor(F.col("value") * 1000).alias("ms"))
    return rounded(M.timing_summary(timings, "ms", ["event_type"]))


@register(
    "token_cost",
    f"""SELECT role, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens,
  round(sum(i) / 1e6 * 3.0 + sum(o) / 1e6 * 15.0, 8) AS cost,
  round((sum(i) / 1e6 * 3.0 + sum(o) / 1e6 * 15.0) / count(*) * 1000, 6) AS cost_per_1k
FROM (SELECT role, CASE WHEN role = 'user' THEN n ELSE 0 END AS i, CASE WHEN role = 'user' THEN 0 ELSE n END AS o
  FROM (SELECT role, len({WORDS_SQL}) AS n FROM conversations)) GROUP BY role""",
)
def token_cost(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n, asked = X.word_count(F.col("text")), F.col("role") == "user"
    tokens = turns.select(
        "role", F.when(asked, n).otherwise(0).alias("input_tokens"), F.when(asked, 0).otherwise(n).alias("output_tokens")
    )
    cost = M.token_cost(tokens, ["role"])
    return cost.select(
        "role", "input_tokens", "output_tokens", F.round("cost", 8).alias("cost"), F.round("cost_per_1k", 6).alias("cost_per_1k")
    )


# ---- error analysis --------------------------------------------------------------------

DIFFICULTY = f"""{ALL}, {TRAIN}, {CURVE}, {AUC_SQL},
diff AS (SELECT clause, f1, precision, recall, coalesce(auc, 0.5) AS auc, n_positive AS n_test_pos,
    n_train_pos::BIGINT AS n_train_pos, n_positive / (tp + fp + fn + tn) AS prevalence, clause IN {HIGH_SQL} AS is_high_risk
  FROM per LEFT JOIN (SELECT clause, sum(y) AS n_train_pos FROM train GROUP BY clause) USING (clause)
  LEFT JOIN areas USING (clause) WHERE n_positive > 0)"""
DIFF_COLUMNS = """clause, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall, round(auc, 6) AS auc,
  n_test_pos, n_train_pos, round(prevalence, 6) AS prevalence, is_high_risk"""


def difficulty(spark, sf_dir):
    train, preds = predictions(spark, sf_dir)
    return A.difficulty(preds, train)


@register("error_difficulty", with_scores(f", {DIFFICULTY} SELECT {DIFF_COLUMNS} FROM diff"))
def error_difficulty(spark, sf_dir):
    return rounded(difficulty(spark, sf_dir))


@register(
    "error_extremes",
    with_scores(
        f""", {DIFFICULTY} (SELECT clause, round(f1, 6) AS f1, 'hardest' AS side FROM diff ORDER BY diff.f1, clause LIMIT 10)
UNION ALL (SELECT clause, round(f1, 6), 'easiest' FROM diff ORDER BY diff.f1 DESC, clause LIMIT 10)"""
    ),
)
def error_extremes(spark, sf_dir):
    table = M.per_clause(predictions(spark, sf_dir)[1]).select("clause", "f1")
    return rounded(A.extremes(table))


@register(
    "error_support_correlations",
    with_scores(
        f""", {DIFFICULTY} SELECT round(corr(n_train_pos, f1), 6) AS corr_train_f1,
  round(corr(prevalence, f1), 6) AS corr_prevalence_f1, round(regr_slope(f1, n_train_pos), 8) AS slope,
  round(regr_intercept(f1, n_train_pos), 6) AS intercept FROM diff"""
    ),
)
def error_support_correlations(spark, sf_dir):
    row = A.support_correlations(difficulty(spark, sf_dir))
    return row.select(*[F.round(c, 8 if c == "slope" else 6).alias(c) for c in row.columns])


@register(
    "error_hard_and_easy",
    with_scores(
        f""", {DIFFICULTY} SELECT count(*) FILTER (f1 < 0.4) AS n_hard,
  round(coalesce(avg(n_train_pos) FILTER (f1 < 0.4), 0), 6) AS hard_mean_train_pos, count(*) FILTER (f1 >= 0.7) AS n_easy,
  round(coalesce(avg(n_train_pos) FILTER (f1 >= 0.7), 0), 6) AS easy_mean_train_pos FROM diff"""
    ),
)
def error_hard_and_easy(spark, sf_dir):
    return rounded(A.hard_and_easy(difficulty(spark, sf_dir)))


ERRORS = f"""{PREDS}, errs AS (SELECT doc_id, sum(y)::BIGINT AS n_true_labels, sum(pred)::BIGINT AS n_predicted,
    sum((1 - y) * pred)::BIGINT AS false_positives, sum(y * (1 - pred))::BIGINT AS false_negatives,
    coalesce(sum(y * (1 - pred)) FILTER (clause IN {HIGH_SQL}), 0)::BIGINT AS hr_false_negatives,
    (sum((1 - y) * pred) + sum(y * (1 - pred)))::BIGINT AS total_errors, any_value(word_count) AS word_count
  FROM preds JOIN (SELECT doc_id, len({WORDS_SQL}) AS word_count FROM contracts) USING (doc_id) GROUP BY doc_id)"""


def document_errors(spark, sf_dir):
    docs = hash_split(contracts(spark, sf_dir)).where("split = 'test'").select("doc_id", X.word_count(F.col("text")).alias("word_count"))
    return A.document_errors(predictions(spark, sf_dir)[1], docs)


@register("error_per_document", with_scores(f", {ERRORS} SELECT * FROM errs"))
def error_per_document(spark, sf_dir):
    return document_errors(spark, sf_dir)


@register(
    "error_worst_documents",
    with_scores(f", {ERRORS} SELECT * FROM errs ORDER BY total_errors DESC, doc_id LIMIT 10"),
)
def error_worst_documents(spark, sf_dir):
    return A.worst_documents(document_errors(spark, sf_dir))


@register(
    "error_length_summary",
    with_scores(
        f""", {ERRORS}, m AS (SELECT median(word_count) AS med FROM errs)
SELECT count(*) AS n_docs, count(*) FILTER (total_errors = 0) AS n_perfect,
  count(*) FILTER (hr_false_negatives > 0) AS n_missing_high_risk, round(corr(word_count, total_errors), 6) AS corr_length_errors,
  round(avg(total_errors) FILTER (word_count > med), 6) AS mean_errors_long,
  round(avg(total_errors) FILTER (word_count <= med), 6) AS mean_errors_short,
  round(regr_slope(total_errors, word_count), 8) AS slope, round(regr_intercept(total_errors, word_count), 6) AS intercept
FROM errs, m"""
    ),
)
def error_length_summary(spark, sf_dir):
    row = A.error_summary(document_errors(spark, sf_dir))
    return row.select(
        *[F.round(c, 8 if c == "slope" else 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes]
    )


@register(
    "error_rates_per_clause",
    with_scores(
        f""", {PREDS} SELECT clause, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
  sum(y * (1 - pred))::BIGINT AS n_missed, sum((1 - y) * pred)::BIGINT AS n_false_alarms,
  round(sum(y * (1 - pred)) / nullif(sum(y), 0), 6) AS missed_share,
  round(sum((1 - y) * pred) / nullif(sum(1 - y), 0), 6) AS false_alarm_share FROM preds GROUP BY clause"""
    ),
)
def error_rates_per_clause(spark, sf_dir):
    return rounded(A.error_rates(predictions(spark, sf_dir)[1]))


@register(
    "error_first_missed",
    with_scores(
        f""", {PREDS} SELECT clause, doc_id, substr(text, 1, 200) AS excerpt FROM contracts JOIN (
  SELECT clause, min(doc_id) AS doc_id FROM preds WHERE y = 1 AND pred = 0 GROUP BY clause) USING (doc_id)"""
    ),
)
def error_first_missed(spark, sf_dir):
    return A.first_missed(predictions(spark, sf_dir)[1], contracts(spark, sf_dir))


# ---- a second system, blending and routing ---------------------------------------------

# The first system is the keyword score; the second multinomial naive Bayes on counts of one and two words, the third
# complement naive Bayes. Both are fitted on the training documents and score all of them.


def _fitted_sql(name: str, coefficients: str) -> str:
    """Scores of a fitted system for the documents and clauses of ``scores``."""
    return f"""{name} AS (SELECT doc_id, clause, y, split, nb.prob FROM scores
  JOIN (WITH {NB_BASE}, {coefficients}{NB_SCORE}) nb USING (doc_id, clause))"""


SECOND = _fitted_sql("second", NB_COEF)
THIRD = _fitted_sql("third", COMPLEMENT_COEF)


def fitted_scores(scores, inputs, fit):
    """Score rows of a system fitted on ``inputs`` (``_nb_inputs``), for the documents and clauses of ``scores``."""
    counted, labels, sums = inputs
    model = replace(fit(sums, labels, NB_CLAUSES), spec=NB_SPEC)
    found = linear.score_counted(counted, model).withColumn("prob", F.round("prob", 5))
    return cut_lineage(scores.drop("prob").join(found, ["doc_id", "clause"]).select("doc_id", "clause", "prob", "y", "split"))


def two_systems(spark, sf_dir):
    first = stored_scores(spark, sf_dir)
    return first, fitted_scores(first, _nb_inputs(spark, sf_dir, first), linear.multinomial_nb)


def three_systems(spark, sf_dir):
    """Both fitted systems take their terms and sums from the same counts."""
    first = stored_scores(spark, sf_dir)
    inputs = _nb_inputs(spark, sf_dir, first)
    return first, fitted_scores(first, inputs, linear.multinomial_nb), fitted_scores(first, inputs, linear.complement_nb)


def f1_sql(name: str, source: str, thr: str) -> str:
    """Per-clause F1 of ``source`` rows at a threshold expression, as a CTE."""
    return f"""{name} AS (SELECT clause, {F1_SQL} AS f1 FROM (SELECT clause, sum(y * (prob >= {thr})::INT) AS tp,
    sum((1 - y) * (prob >= {thr})::INT) AS fp, sum(y * (prob < {thr})::INT) AS fn
  FROM {source} WHERE split = 'test' GROUP BY clause) WHERE tp + fn > 0)"""


def f1_at(scores, threshold):
    test = scores.where("split = 'test'")
    return M.per_clause(T.fixed_threshold(test, threshold)).select("clause", "f1")


@register(
    "blend_scores",
    with_scores(
        f""", {SECOND} SELECT doc_id, clause, round(coalesce(0.5 * a.prob + 0.5 * b.prob, a.prob, b.prob), 6) AS prob
FROM scores a FULL JOIN (SELECT * FROM second WHERE clause <> 'Insurance') b USING (doc_id, clause)"""
    ),
)
def blend_scores(spark, sf_dir):
    """One clause has no second model, so the first one's score stands."""
    first, second = two_systems(spark, sf_dir)
    return rounded(E.blend(first, second.where(F.col("clause") != "Insurance"), 0.5))


ALPHAS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


@register(
    "blend_alpha_sweep",
    with_scores(
        f""", {SECOND}, mixed AS (SELECT alpha, clause, a.y, round(alpha * a.prob + (1 - alpha) * b.prob, 8) >= 0.25 AS pred
  FROM scores a JOIN second b USING (doc_id, clause), (SELECT unnest({ALPHAS})::DOUBLE AS alpha) WHERE a.split = 'test'),
cells AS (SELECT alpha, clause, sum(y * pred::INT) AS tp, sum((1 - y) * pred::INT) AS fp, sum(y * (1 - pred::INT)) AS fn
  FROM mixed GROUP BY alpha, clause)
SELECT alpha, round(avg(f1), 6) AS macro_f1, round(avg(f1) FILTER (clause IN {HIGH_SQL}), 6) AS hr_f1
FROM (SELECT *, {F1_SQL} AS f1 FROM cells WHERE tp + fn > 0) GROUP BY alpha"""
    ),
)
def blend_alpha_sweep(spark, sf_dir):
    first, second = two_systems(spark, sf_dir)
    test = first.where("split = 'test'")
    mixed = E.blend_sweep(test, second.where("split = 'test'"), ALPHAS).join(
        test.select("doc_id", "clause", "y"), ["doc_id", "clause"]
    )
    preds = mixed.withColumn("pred", (F.round("prob", 8) >= 0.25).cast("int"))
    scored = M.scores_of(M.confusion(preds, ["alpha", "clause"])).where("n_positive > 0")
    return rounded(M.summary(scored, keys=["alpha"]).select("alpha", "macro_f1", "hr_f1"))


def _best_sql(name: str, source: str, config: str) -> str:
    return f"""{name} AS (SELECT clause, {quoted(config)} AS config, CASE WHEN f1 > 0 THEN thr ELSE 0.5 END AS thr, f1 FROM (
  SELECT clause, thr, {F1_SQL} AS f1 FROM ({_grid_sql(T.SCUT_GRID, source).split('AS (', 1)[1]}
  QUALIFY row_number() OVER (PARTITION BY clause ORDER BY f1 DESC, thr) = 1))"""


ROUTES = f"""{SECOND}, va AS (SELECT * FROM scores WHERE split = 'train'), vb AS (SELECT * FROM second WHERE split = 'train'),
{_best_sql('ba', 'va', 'first')}, {_best_sql('bb', 'vb', 'second')},
routes AS (SELECT b.clause, CASE WHEN np < 2 THEN 'first' WHEN b.f1 >= a.f1 THEN 'second' ELSE 'first' END AS config,
    CASE WHEN np < 2 THEN 0.5 WHEN b.f1 >= a.f1 THEN b.thr ELSE a.thr END AS thr
  FROM ba a JOIN bb b USING (clause) JOIN (SELECT clause, sum(y) AS np FROM va GROUP BY clause) USING (clause))"""


def _routes(first, second):
    validation = {"first": first.where("split = 'train'"), "second": second.where("split = 'train'")}
    return E.route(validation, default="first", preferred="second")


@register(
    "router_choices",
    with_scores(f", {ROUTES} SELECT clause, config, round(thr, 6) AS thr FROM routes"),
)
def router_choices(spark, sf_dir):
    return rounded(_routes(*two_systems(spark, sf_dir)))


@register(
    "router_predictions",
    with_scores(
        f""", {ROUTES} SELECT doc_id, clause, config, prob, y, (prob >= thr)::INT AS pred FROM routes JOIN (
  SELECT *, 'first' AS config FROM scores UNION ALL SELECT doc_id, clause, prob, y, split, 'second' FROM second)
USING (clause, config) WHERE split = 'test'"""
    ),
)
def router_predictions(spark, sf_dir):
    first, second = two_systems(spark, sf_dir)
    tables = {"first": first.where("split = 'test'"), "second": second.where("split = 'test'")}
    routed = E.routed_scores(tables, _routes(first, second))
    return routed.select("doc_id", "clause", "config", "prob", "y", "pred")


TWO_F1 = f"{SECOND}, {f1_sql('fa', 'scores', '0.25')}, {f1_sql('fb', 'second', '0.3')}"


@register(
    "router_oracle_diagnostic",
    with_scores(
        f""", {TWO_F1} SELECT clause, CASE WHEN fa.f1 >= fb.f1 THEN 'first' ELSE 'second' END AS config,
  round(greatest(fa.f1, fb.f1), 6) AS f1 FROM fa JOIN fb USING (clause)"""
    ),
)
def router_oracle_diagnostic(spark, sf_dir):
    first, second = two_systems(spark, sf_dir)
    return rounded(E.oracle_route({"first": f1_at(first, 0.25), "second": f1_at(second, 0.3)}))


COMPARED = f"""{TWO_F1}, compared AS (SELECT clause, coalesce(fa.f1, 0) AS f1_a, coalesce(fb.f1, 0) AS f1_b,
    coalesce(fb.f1, 0) - coalesce(fa.f1, 0) AS delta, CASE WHEN coalesce(fb.f1, 0) > coalesce(fa.f1, 0) THEN 'second'
      WHEN coalesce(fa.f1, 0) > coalesce(fb.f1, 0) THEN 'first' ELSE 'tie' END AS winner, clause IN {HIGH_SQL} AS is_high_risk
  FROM fa FULL JOIN fb USING (clause))"""


def compared(spark, sf_dir):
    first, second = two_systems(spark, sf_dir)
    return A.compare(f1_at(first, 0.25), f1_at(second, 0.3), "first", "second")


@register(
    "compare_systems",
    with_scores(
        f""", {COMPARED} SELECT clause, round(f1_a, 6) AS f1_a, round(f1_b, 6) AS f1_b, round(delta, 6) AS delta,
  winner, is_high_risk FROM compared"""
    ),
)
def compare_systems(spark, sf_dir):
    return rounded(compared(spark, sf_dir))


@register(
    "compare_win_tally",
    with_scores(f", {COMPARED} SELECT is_high_risk, winner, count(*) AS n_clauses FROM compared GROUP BY ALL"),
)
def compare_win_tally(spark, sf_dir):
    return A.win_tally(compared(spark, sf_dir))


CONFIGS = f"""{TWO_F1}, {THIRD}, {f1_sql('fc', 'third', '0.5')},
blend AS (SELECT doc_id, clause, a.y, a.split, round(0.5 * a.prob + 0.5 * b.prob, 8) AS prob FROM scores a JOIN second b USING (doc_id, clause)),
{f1_sql('fd', 'blend', '0.5')}"""


def configs(spark, sf_dir):
    first, second, third = three_systems(spark, sf_dir)
    blend = E.blend(first, second, 0.5).withColumn("prob", F.round("prob", 8)).join(first.select("doc_id", "clause", "y", "split"), ["doc_id", "clause"])
    others = {"multinomial": f1_at(second, 0.3), "complement": f1_at(third, 0.5), "blended": f1_at(blend, 0.5)}
    return A.compare_configs(f1_at(first, 0.25), others)


CONFIG_ROWS = f"""{CONFIGS}, table4 AS (SELECT clause, fa.f1 AS base, fb.f1 AS multinomial, fc.f1 AS complement, fd.f1 AS blended,
  fb.f1 - fa.f1 AS d_multinomial, fc.f1 - fa.f1 AS d_complement, fd.f1 - fa.f1 AS d_blended
  FROM fa JOIN fb USING (clause) JOIN fc USING (clause) JOIN fd USING (clause))"""


@register(
    "compare_feature_configs",
    with_scores(f", {CONFIG_ROWS} SELECT clause, round(COLUMNS(* EXCLUDE (clause)), 6) FROM table4"),
)
def compare_feature_configs(spark, sf_dir):
    return rounded(configs(spark, sf_dir))


@register(
    "compare_largest_swings",
    with_scores(
        f""", {CONFIG_ROWS} SELECT clause, round(d_complement, 6) AS d_complement FROM table4
ORDER BY abs(table4.d_complement) DESC, clause LIMIT 5"""
    ),
)
def compare_largest_swings(spark, sf_dir):
    return rounded(A.largest_swings(configs(spark, sf_dir), "d_complement").select("clause", "d_complement"))


@register(
    "compare_three_winner",
    with_scores(
        f""", {CONFIG_ROWS} SELECT clause, CASE WHEN base >= greatest("multinomial", complement) THEN 'trees'
  WHEN complement >= "multinomial" THEN 'few' ELSE 'zero' END AS winner FROM table4"""
    ),
)
def compare_three_winner(spark, sf_dir):
    winner = A.winner_of_three(F.col("base"), F.col("multinomial"), F.col("complement"), ["trees", "zero", "few"])
    return configs(spark, sf_dir).select("clause", winner.alias("winner"))


# ---- leaderboards ----------------------------------------------------------------------

SYSTEMS = {"first@0.25": ("scores", 0.25), "first@0.35": ("scores", 0.35), "second@0.3": ("second", 0.3), "second@0.4": ("second", 0.4)}


def _board_sql() -> str:
    ctes = [f1_sql(f"m{i}", source, str(thr)) for i, (source, thr) in enumerate(SYSTEMS.values())]
    rows = " UNION ALL ".join(
        f"SELECT {quoted(name)} AS model, {quoted(name.split('@')[0])} AS family, avg(f1) AS macro_f1, "
        f"coalesce(avg(f1) FILTER (clause IN {HIGH_SQL}), 0) AS hr_f1 FROM m{i}"
        for i, name in enumerate(SYSTEMS)
    )
    return f"{SECOND}, {', '.join(ctes)}, board AS ({rows})"


BOARD = _board_sql()


def board(spark, sf_dir):
    """One metric row per system."""
    first, second = two_systems(spark, sf_dir)
    rows = []
    for name, (source, threshold) in SYSTEMS.items():
        test = (first if source == "scores" else second).where("split = 'test'")
        metrics = M.summary(M.per_clause(T.fixed_threshold(test, threshold)))
        rows.append(
            metrics.select(F.lit(name).alias("model"), F.lit(name.split("@")[0]).alias("family"), "macro_f1", "hr_f1")
        )
    return A.union_metrics(*rows)


@register(
    "leaderboard",
    with_scores(
        f""", {BOARD} SELECT model, family, round(macro_f1, 6) AS macro_f1, round(hr_f1, 6) AS hr_f1,
  row_number() OVER (ORDER BY round(board.macro_f1, 9) DESC, model)::INT AS rank, round(board.macro_f1 - 0.5, 6) AS delta FROM board"""
    ),
)
def leaderboard(spark, sf_dir):
    return rounded(A.leaderboard(board(spark, sf_dir), baseline=0.5))


@register(
    "leaderboard_champions",
    with_scores(
        f""", {BOARD} SELECT (SELECT model FROM board ORDER BY round(macro_f1, 9) DESC, model DESC LIMIT 1) AS macro_champion,
  (SELECT round(max(macro_f1), 6) FROM board) AS macro_f1, (SELECT model FROM board ORDER BY round(hr_f1, 9) DESC, model DESC LIMIT 1) AS hr_champion,
  (SELECT round(max(hr_f1), 6) FROM board) AS hr_f1"""
    ),
)
def leaderboard_champions(spark, sf_dir):
    return rounded(A.champions(board(spark, sf_dir)))


@register(
    "leaderboard_best_of_family",
    with_scores(f", {BOARD} SELECT family, first(model ORDER BY round(macro_f1, 9) DESC, model DESC) AS model, round(max(macro_f1), 6) AS macro_f1 FROM board GROUP BY family"),
)
def leaderboard_best_of_family(spark, sf_dir):
    return rounded(A.best_of_family(board(spark, sf_dir)))


@register(
    "leaderboard_with_stored_rows",
    with_scores(
        f""", {BOARD} SELECT model, family, round(macro_f1, 6) AS macro_f1, round(hr_f1, 6) AS hr_f1, NULL AS phase FROM board
UNION ALL SELECT 'published reference', NULL, 0.65, NULL, 'Ref'"""
    ),
)
def leaderboard_with_stored_rows(spark, sf_dir):
    stored = spark.createDataFrame([("published reference", 0.65, "Ref")], "model string, macro_f1 double, phase string")
    return rounded(A.union_metrics(board(spark, sf_dir), stored))


@register(
    "trials_running_best",
    with_scores(
        f""", {TEST}, {_grid_sql(T.GLOBAL_GRID, 'test')}, trials AS (
  SELECT row_number() OVER (ORDER BY thr) AS trial, macro FROM (SELECT thr, avg({F1_SQL}) AS macro FROM cells GROUP BY thr))
SELECT trial::INT AS trial, round(macro, 6) AS score, round(max(macro) OVER (ORDER BY trial), 6) AS best_so_far FROM trials"""
    ),
)
def trials_running_best(spark, sf_dir):
    """Each global threshold is one trial, in grid order."""
    sweep = T.global_sweep(clause_scores(spark, sf_dir).where("split = 'test'"))
    trial = F.array_position(F.array(*[F.lit(t) for t in T.GLOBAL_GRID]), F.col("thr")).cast("int")
    trials = sweep.select(trial.alias("trial"), F.col("macro_f1").alias("score"))
    return rounded(A.running_best(trials))


@register(
    "leaderboard_lift",
    with_scores(
        f""", {BOARD}, e AS (SELECT max(macro_f1) FILTER (model = 'second@0.4') AS lo, max(macro_f1) FILTER (model = 'first@0.25') AS hi FROM board)
SELECT model, round(macro_f1, 6) AS macro_f1, round(macro_f1 - lo, 6) AS delta,
  round((macro_f1 - lo) / (hi - lo) * 100, 4) AS captured_pct FROM board, e"""
    ),
)
def leaderboard_lift(spark, sf_dir):
    rows = cut_lineage(board(spark, sf_dir))
    return rounded(A.lift(rows, "second@0.4", "first@0.25")).withColumn("captured_pct", F.round("captured_pct", 4))
