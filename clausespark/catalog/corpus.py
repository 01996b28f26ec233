"""Corpus statistics, splits and clause filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausespark.catalog import register
from clausespark.catalog.inputs import (
    clause_scores,
    contracts,
    documents,
    hash_bucket_sql,
    quoted,
    with_contracts,
    with_scores,
)
from clausespark.catalog.text_features import WORDS_SQL, _enhanced_sql, _unfair_sql
from clausespark.fixed import patterns as P
from clausespark.fixed.taxonomy import CLAUSES, METADATA_CLAUSES, RISK_VERSIONS
from clausespark.functions import text as X
from clausespark.operators import corpus_stats as S
from clausespark.operators import splits, taxonomy
from clausespark.operators.features import MOMENT_STEPS, feature_groups, standardize
from clausespark.session import cut_lineage


def in_list(names) -> str:
    return "(" + ", ".join(quoted(n) for n in names) + ")"


def risk_sql(column: str = "clause", version: str = "production", other: str = "LOW") -> str:
    lists = RISK_VERSIONS[version]
    return (
        f"CASE WHEN {column} IN {in_list(lists['HIGH'])} THEN 'HIGH' "
        f"WHEN {column} IN {in_list(lists['MEDIUM'])} THEN 'MEDIUM' ELSE {quoted(other)} END"
    )


def sized_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    text = F.col("text")
    return docs.select(
        "doc_id", "lang", "source", F.length(text).cast("long").alias("text_len"), X.word_count(text).alias("n_words")
    )


SIZED = f"sized AS (SELECT doc_id, lang, source, length(text) AS text_len, len({WORDS_SQL}) AS n_words FROM documents)"


# ---- descriptive statistics ------------------------------------------------------------


def _describe_sql(measure: str) -> str:
    return f"""SELECT {quoted(measure)} AS measure, count(*) AS count, round(avg({measure}), 4) AS mean,
  round(stddev_samp({measure}), 4) AS std, min({measure}) AS min, quantile_cont({measure}, 0.25)::DOUBLE AS p25,
  quantile_cont({measure}, 0.5)::DOUBLE AS p50, quantile_cont({measure}, 0.75)::DOUBLE AS p75,
  max({measure}) AS max FROM sized"""


@register(
    "corpus_describe_lengths",
    f"WITH {SIZED} {_describe_sql('text_len')} UNION ALL {_describe_sql('n_words')}",
)
def corpus_describe_lengths(spark, sf_dir):
    stats = S.describe(sized_documents(spark, sf_dir), ["text_len", "n_words"])
    return stats.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


@register(
    "label_prevalence",
    with_scores(
        "SELECT clause, round(avg(y), 6) AS rate, sum(y)::BIGINT AS n_positive FROM scores GROUP BY clause"
    ),
)
def label_prevalence(spark, sf_dir):
    return S.prevalence(clause_scores(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@register(
    "label_prevalence_by_risk",
    with_scores(
        f"""SELECT * FROM (SELECT clause, {risk_sql()} AS risk_level, round(avg(y), 6) AS rate,
  sum(y)::BIGINT AS n_positive, count(*) AS n_docs FROM scores GROUP BY clause) WHERE risk_level <> 'LOW'"""
    ),
)
def label_prevalence_by_risk(spark, sf_dir):
    return S.prevalence_by_risk(clause_scores(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


@register(
    "label_count_describe",
    with_scores(
        """, sized AS (SELECT doc_id, sum(y)::BIGINT AS n_labels FROM scores GROUP BY doc_id)
SELECT *, (SELECT n_labels FROM sized GROUP BY n_labels ORDER BY count(*) DESC, n_labels LIMIT 1) AS mode
FROM ("""
        + _describe_sql("n_labels")
        + ")"
    ),
)
def label_count_describe(spark, sf_dir):
    stats = S.clauses_per_document(clause_scores(spark, sf_dir))
    return stats.withColumn("mean", F.round("mean", 4)).withColumn("std", F.round("std", 4))


COOC = """cooc AS (SELECT a.clause AS clause_a, b.clause AS clause_b, count(*) AS n_docs
  FROM scores a JOIN scores b USING (doc_id) WHERE a.y = 1 AND b.y = 1 GROUP BY 1, 2)"""


@register("label_cooccurrence", with_scores(f", {COOC} SELECT * FROM cooc"))
def label_cooccurrence(spark, sf_dir):
    return S.cooccurrence(clause_scores(spark, sf_dir))


@register(
    "label_correlation",
    with_scores(
        """, kept AS (SELECT clause FROM scores GROUP BY clause ORDER BY sum(y) DESC, clause LIMIT 12),
top AS (SELECT * FROM scores WHERE clause IN (SELECT clause FROM kept))
SELECT a.clause AS clause_a, b.clause AS clause_b, round(corr(a.y, b.y), 6) AS corr
FROM top a JOIN top b USING (doc_id) GROUP BY 1, 2"""
    ),
)
def label_correlation(spark, sf_dir):
    return S.label_correlation(clause_scores(spark, sf_dir)).withColumn("corr", F.round("corr", 6))


@register(
    "label_split_distribution",
    with_scores(
        """, docs AS (SELECT doc_id, split, max(y) AS has FROM scores GROUP BY 1, 2)
SELECT clause, sum(y) FILTER (split = 'train')::BIGINT AS train, sum(y) FILTER (split = 'test')::BIGINT AS test,
  sum(y)::BIGINT AS total FROM scores GROUP BY clause
UNION ALL SELECT CASE WHEN has = 1 THEN 'ANY LABEL' ELSE 'NO LABEL' END, count(*) FILTER (split = 'train'),
  count(*) FILTER (split = 'test'), count(*) FROM docs GROUP BY has"""
    ),
)
def label_split_distribution(spark, sf_dir):
    return S.split_distribution(clause_scores(spark, sf_dir), ["train", "test"])


@register(
    "label_positives_rollup",
    with_scores("SELECT clause, split, sum(y)::BIGINT AS n_positive FROM scores GROUP BY ROLLUP (clause, split)"),
)
def label_positives_rollup(spark, sf_dir):
    return S.positives_rollup(clause_scores(spark, sf_dir))


@register(
    "corpus_overview",
    with_scores(
        f""", {SIZED}, counts AS (SELECT doc_id, sum(y) AS k FROM scores GROUP BY doc_id)
SELECT count(*) AS n_docs, count(*) FILTER (k > 0) AS n_with_label, count(*) FILTER (k = 0) AS n_without_label,
  count(*) FILTER (k > 1) AS n_multi_label, round(avg(text_len), 4) AS mean_chars, round(avg(n_words), 4) AS mean_words,
  max(n_words) AS max_words, min(n_words) AS min_words,
  round(count(*) FILTER (k = 0) / greatest(count(*) FILTER (k > 0), 1), 6) AS imbalance_ratio,
  round(count(*) FILTER (k > 1) / count(*), 6) AS multi_label_share, median(n_words)::DOUBLE AS median_words
FROM sized JOIN counts USING (doc_id)"""
    ),
)
def corpus_overview(spark, sf_dir):
    row = S.overview(sized_documents(spark, sf_dir), clause_scores(spark, sf_dir))
    places = {"mean_chars": 4, "mean_words": 4, "imbalance_ratio": 6, "multi_label_share": 6}
    return row.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in row.columns])


@register(
    "label_count_distribution",
    with_scores(
        """SELECT n_labels, count(*) AS n_docs FROM (
  SELECT doc_id, sum(y)::BIGINT AS n_labels FROM scores GROUP BY doc_id) GROUP BY n_labels"""
    ),
)
def label_count_distribution(spark, sf_dir):
    return S.label_count_distribution(clause_scores(spark, sf_dir))


@register(
    "length_by_label_presence",
    with_scores(
        f""", {SIZED} SELECT has AS positive, count(*) AS n_docs, round(avg(n_words), 4) AS mean_words,
  median(n_words)::DOUBLE AS median_words
FROM sized JOIN (SELECT doc_id, max(y) AS has FROM scores GROUP BY doc_id) USING (doc_id) GROUP BY has"""
    ),
)
def length_by_label_presence(spark, sf_dir):
    has = clause_scores(spark, sf_dir).groupBy("doc_id").agg(F.max("y").alias("positive"))
    joined = sized_documents(spark, sf_dir).join(has, "doc_id")
    return S.length_by_group(joined, ["positive"], "n_words").withColumn("mean_words", F.round("mean_words", 4))


@register(
    "length_by_label",
    with_scores(
        f""", {SIZED} SELECT clause, count(*) AS n_docs, round(avg(n_words), 4) AS mean_words,
  median(n_words)::DOUBLE AS median_words
FROM sized JOIN scores USING (doc_id) WHERE y = 1 GROUP BY clause"""
    ),
)
def length_by_label(spark, sf_dir):
    positive = clause_scores(spark, sf_dir).where("y = 1").select("doc_id", "clause")
    joined = sized_documents(spark, sf_dir).join(positive, "doc_id")
    return S.length_by_group(joined, ["clause"], "n_words").withColumn("mean_words", F.round("mean_words", 4))


@register(
    "word_count_histogram",
    f"""WITH {SIZED}, ends AS (SELECT min(n_words) AS lo, max(n_words) AS hi FROM sized)
SELECT least(floor((n_words - lo) * 30 / greatest(hi - lo, 1)), 29)::INT AS bin,
  round(any_value(lo) + any_value(hi - lo) / 30.0::DOUBLE
    * least(floor((n_words - lo) * 30 / greatest(hi - lo, 1)), 29)::INT, 6) AS bin_start,
  count(*) AS n_docs FROM sized, ends GROUP BY 1, lo, hi""",
)
def word_count_histogram(spark, sf_dir):
    bins = S.histogram(sized_documents(spark, sf_dir), "n_words", 30)
    return bins.withColumn("bin_start", F.round("bin_start", 6))


def _power_sql() -> str:
    parts = [
        f"SELECT {quoted(f)} AS feature, avg({f}) FILTER (positive = 0) * 100 AS n, "
        f"avg({f}) FILTER (positive = 1) * 100 AS p FROM flagged"
        for f in P.UNFAIR_FLAGS
    ]
    return with_scores(
        f""", flags AS ({_unfair_sql()}),
flagged AS (SELECT f.*, h.positive FROM flags f
  JOIN (SELECT doc_id, max(y) AS positive FROM scores GROUP BY doc_id) h USING (doc_id))
SELECT feature, round(n, 6) AS negative_pct, round(p, 6) AS positive_pct,
  round(p / greatest(n, 0.1), 6) AS ratio,
  CASE WHEN p / greatest(n, 0.1) > 2.0 OR p / greatest(n, 0.1) < 0.5 THEN 'YES' ELSE 'marginal' END AS useful
FROM ({' UNION ALL '.join(parts)})"""
    )


def unfair_flag_table(spark, sf_dir):
    flags = X.unfair_terms_flags(F.col("text"))
    docs = contracts(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in flags.items()])
    has = clause_scores(spark, sf_dir).groupBy("doc_id").agg(F.max("y").alias("positive"))
    return docs.join(has, "doc_id")


@register("feature_discriminative_power", _power_sql())
def feature_discriminative_power(spark, sf_dir):
    power = S.discriminative_power(unfair_flag_table(spark, sf_dir), list(P.UNFAIR_FLAGS))
    return power.select(
        "feature", *[F.round(c, 6).alias(c) for c in ("negative_pct", "positive_pct", "ratio")], "useful"
    )


@register(
    "feature_discriminative_top5",
    f"SELECT feature, ratio FROM ({_power_sql()}) ORDER BY ratio DESC NULLS LAST, feature LIMIT 5",
)
def feature_discriminative_top5(spark, sf_dir):
    power = feature_discriminative_power(spark, sf_dir)
    return power.select("feature", "ratio").orderBy(F.col("ratio").desc_nulls_last(), "feature").limit(5)


@register(
    "label_first_examples",
    with_scores(
        """SELECT clause, doc_id, substr(text, 1, 200) AS excerpt FROM (
  SELECT clause, min(doc_id) AS doc_id FROM scores WHERE y = 1 GROUP BY clause) JOIN contracts USING (doc_id)"""
    ),
)
def label_first_examples(spark, sf_dir):
    return S.first_examples(clause_scores(spark, sf_dir), contracts(spark, sf_dir))


@register(
    "label_rarity_summary",
    with_scores(
        """SELECT min(n)::BIGINT AS min_positives, max(n)::BIGINT AS max_positives, round(avg(n), 6) AS mean_positives,
  count(*) FILTER (rate < 0.1) AS n_rare, count(*) FILTER (rate >= 0.3) AS n_frequent
FROM (SELECT sum(y) AS n, avg(y) AS rate FROM scores WHERE split = 'train' GROUP BY clause)"""
    ),
)
def label_rarity_summary(spark, sf_dir):
    train = clause_scores(spark, sf_dir).where("split = 'train'")
    return S.rarity_summary(train).withColumn("mean_positives", F.round("mean_positives", 6))


@register(
    "feature_group_coverage",
    f"""WITH feats AS ({_enhanced_sql()}),
long AS (UNPIVOT (SELECT doc_id, {', '.join(f'({f})::DOUBLE AS {f}' for f in P.ENHANCED_ORDER)} FROM feats)
  ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME feature VALUE value),
grouped AS ({' UNION ALL '.join(
        f"SELECT {quoted(g)} AS grp, * FROM long WHERE " + ' OR '.join(f"contains(feature, {quoted(p)})" for p in parts)
        for g, parts in P.FEATURE_GROUPS.items())})
SELECT grp, count(DISTINCT feature) AS n_features, count(*) FILTER (value <> 0) AS n_nonzero FROM grouped GROUP BY grp""",
)
def feature_group_coverage(spark, sf_dir):
    """Features per keyword group, and how many of their values in the corpus are not zero."""
    features = P.ENHANCED_ORDER
    docs = contracts(spark, sf_dir).select(*X.enhanced_features(F.col("text")))
    nonzero = docs.agg(*[F.sum((F.col(f) != 0).cast("long")).alias(f) for f in features])
    counts = nonzero.unpivot([], features, "feature", "nonzero")
    grouped = counts.join(F.broadcast(feature_groups(spark, features)), "feature")
    return grouped.groupBy("grp").agg(
        F.count("*").alias("n_features"), F.sum("nonzero").alias("n_nonzero")
    )


SCALED = P.ENHANCED_ORDER


def _z_sql(f: str) -> str:
    variance = f"(q_{f} / n - (s_{f} / n) * (s_{f} / n))"
    scale = f"CASE WHEN {variance} > 0 THEN sqrt({variance}) / {MOMENT_STEPS} ELSE 1.0::DOUBLE END"
    return f"floor((({f})::DOUBLE - (s_{f} / n) / {MOMENT_STEPS}) / {scale} * 100000 + 0.5) / 100000 AS {f}"


@register(
    "features_standardized",
    f"""WITH feats AS ({_enhanced_sql(rounded=False)}),
grid AS (SELECT {', '.join(f'floor(({f})::DOUBLE * {MOMENT_STEPS} + 0.5)::HUGEINT AS {f}' for f in SCALED)}
  FROM feats WHERE {hash_bucket_sql()} >= 20),
st AS (SELECT count(*)::DOUBLE AS n, {', '.join(f'sum({f})::DOUBLE AS s_{f}, sum({f} * {f})::DOUBLE AS q_{f}' for f in SCALED)} FROM grid)
SELECT doc_id, {', '.join(_z_sql(f) for f in SCALED)}
FROM feats, st""",
)
def features_standardized(spark, sf_dir):
    wanted = [c for c, name in zip(X.enhanced_features(F.col("text")), P.ENHANCED_ORDER) if name in SCALED]
    docs = splits.hash_split(contracts(spark, sf_dir)).select("doc_id", "split", *wanted)
    scaled = standardize(docs, SCALED, F.col("split") == "train")
    # rounded by floor, which both engines do alike next to a tie
    return scaled.select("doc_id", *[(F.floor(F.col(f) * 100_000 + 0.5) / 100_000).alias(f) for f in SCALED])


# ---- taxonomy, splits, clause filters --------------------------------------------------


@register(
    "taxonomy_risk_levels",
    with_scores(
        f"""SELECT clause, {risk_sql()} AS production, {risk_sql(version='review_screen', other='STANDARD')} AS screen,
  count(*) AS n_docs FROM scores GROUP BY clause"""
    ),
)
def taxonomy_risk_levels(spark, sf_dir):
    clause = F.col("clause")
    counts = clause_scores(spark, sf_dir).groupBy("clause").agg(F.count("*").alias("n_docs"))
    return counts.select(
        "clause",
        taxonomy.risk_level(clause).alias("production"),
        taxonomy.risk_level(clause, "review_screen", "STANDARD").alias("screen"),
        "n_docs",
    )


def _versions_sql() -> str:
    rows = ", ".join(
        f"({quoted(v)}, {quoted(level)}, {quoted(c.lower())})" for v, lists in RISK_VERSIONS.items() for level, listed in lists.items() for c in listed
    )
    return with_scores(
        f""", known AS (SELECT * FROM (VALUES {rows}) k(version, level, key))
SELECT clause, v.version, coalesce(level, 'LOW') AS level, n_pos FROM (SELECT clause, sum(y)::BIGINT AS n_pos FROM scores GROUP BY clause) c,
  (SELECT DISTINCT version FROM known) v LEFT JOIN known ON known.version = v.version AND known.key = lower(clause)"""
    )


@register("taxonomy_risk_versions", _versions_sql())
def taxonomy_risk_versions(spark, sf_dir):
    """The level of every clause in all four versions of the risk lists, with its positive documents."""
    counts = clause_scores(spark, sf_dir).groupBy("clause").agg(F.sum("y").cast("long").alias("n_pos"))
    counts = cut_lineage(counts)  # a row per clause, read twice
    return taxonomy.risk_versions(counts).join(counts, "clause")


# Every document is assigned one clause name of the taxonomy by its id.
ASSIGNED = f"list_value({', '.join(quoted(c) for c in CLAUSES)})[1 + (doc_id % 41)::INT]"


@register(
    "taxonomy_drop_metadata",
    f"""SELECT clause, count(*) AS n_docs FROM (SELECT {ASSIGNED} AS clause FROM documents)
WHERE clause NOT IN {in_list(METADATA_CLAUSES)} GROUP BY clause""",
)
def taxonomy_drop_metadata(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in CLAUSES])
    assigned = documents(spark, sf_dir).select(F.get(names, (F.col("doc_id") % 41).cast("int")).alias("clause"))
    return taxonomy.drop_metadata(assigned).groupBy("clause").agg(F.count("*").alias("n_docs"))


@register(
    "split_by_hash",
    f"SELECT doc_id, CASE WHEN {hash_bucket_sql()} < 20 THEN 'test' ELSE 'train' END AS split FROM documents",
)
def split_by_hash(spark, sf_dir):
    return splits.hash_split(documents(spark, sf_dir).select("doc_id"))


PERMUTED = """perm AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS r,
  count(*) OVER () AS n FROM documents)"""


def _permuted(spark, sf_dir):
    return splits.permuted(documents(spark, sf_dir).select("doc_id"))


@register(
    "split_permuted_tail",
    f"WITH {PERMUTED} SELECT doc_id, CASE WHEN r > n - round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM perm",
)
def split_permuted_tail(spark, sf_dir):
    return splits.tail_split(_permuted(spark, sf_dir)).select("doc_id", "split")


@register(
    "split_permuted_head",
    f"WITH {PERMUTED} SELECT doc_id, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM perm",
)
def split_permuted_head(spark, sf_dir):
    return splits.head_split(_permuted(spark, sf_dir)).select("doc_id", "split")


@register(
    "split_kfold",
    f"WITH {PERMUTED} SELECT doc_id, least((r - 1) // (n // 3), 2)::INT AS fold FROM perm",
)
def split_kfold(spark, sf_dir):
    return splits.kfold(_permuted(spark, sf_dir), 3).select("doc_id", "fold")


@register(
    "split_nested_validation",
    f"""WITH train AS (SELECT doc_id FROM documents WHERE {hash_bucket_sql()} >= 20),
perm AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS r, count(*) OVER () AS n FROM train)
SELECT doc_id, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM perm""",
)
def split_nested_validation(spark, sf_dir):
    train = splits.hash_split(documents(spark, sf_dir).select("doc_id")).where("split = 'train'").drop("split")
    return splits.nested_validation(train).select("doc_id", "split")


@register(
    "split_first_test_documents",
    f"SELECT doc_id, n_chars FROM documents WHERE {hash_bucket_sql()} < 20 ORDER BY doc_id LIMIT 30",
)
def split_first_test_documents(spark, sf_dir):
    docs = splits.hash_split(documents(spark, sf_dir).select("doc_id", "n_chars"))
    return splits.head_of_test(docs, "doc_id", 30).select("doc_id", "n_chars")


@register(
    "clauses_valid",
    with_scores(
        """SELECT clause, sum(y)::BIGINT AS n_positive FROM scores WHERE split = 'test'
GROUP BY clause HAVING sum(y) >= 3"""
    ),
)
def clauses_valid(spark, sf_dir):
    return splits.valid_clauses(clause_scores(spark, sf_dir), 3)


@register(
    "clauses_trainable",
    with_scores(
        """SELECT clause, sum(y) FILTER (split = 'train')::BIGINT AS train_pos,
  sum(1 - y) FILTER (split = 'train')::BIGINT AS train_neg, sum(y) FILTER (split = 'test')::BIGINT AS test_pos,
  sum(1 - y) FILTER (split = 'test')::BIGINT AS test_neg FROM scores GROUP BY clause
HAVING train_pos >= 10 AND train_neg > 0 AND test_pos > 0 AND test_neg > 0"""
    ),
)
def clauses_trainable(spark, sf_dir):
    return splits.trainable_clauses(clause_scores(spark, sf_dir), 10)


MAJORITY = """majority AS (SELECT clause, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
  (sum(y) > sum(1 - y))::INT AS majority FROM scores WHERE split = 'test' GROUP BY clause)"""


@register("clauses_majority_class", with_scores(f", {MAJORITY} SELECT * FROM majority"))
def clauses_majority_class(spark, sf_dir):
    return splits.majority_class(clause_scores(spark, sf_dir).where("split = 'test'"))


@register(
    "predict_majority_class",
    with_scores(
        f""", {MAJORITY} SELECT doc_id, clause, y, majority AS pred FROM scores JOIN majority USING (clause)
WHERE split = 'test'"""
    ),
)
def predict_majority_class(spark, sf_dir):
    test = clause_scores(spark, sf_dir).where("split = 'test'").select("doc_id", "clause", "y")
    return splits.predict_majority(test)


@register("predict_absent_floor", with_scores("SELECT doc_id, clause, y, 0 AS pred FROM scores WHERE split = 'test'"))
def predict_absent_floor(spark, sf_dir):
    """The floor below every system: no clause is ever predicted."""
    return splits.predict_absent(clause_scores(spark, sf_dir).where("split = 'test'").select("doc_id", "clause", "y"))
