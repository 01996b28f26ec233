"""Tokens, vocabularies, TF-IDF, feature blocks and closed-form classifiers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clausespark.catalog import register
from clausespark.catalog.inputs import (
    CLAUSE_NAMES,
    CONTRACTS_SQL,
    SCORES_SQL,
    contracts,
    documents,
    hash_bucket_sql,
    quoted,
    score_rows,
    with_contracts,
    with_scores,
)
from clausespark.catalog.text_features import STRUCTURE_NAMES, WORDS_SQL, _syntax_sql, structure_sql
from clausespark.fixed.patterns import SYNTAX_PATTERNS
from clausespark.functions import text as X
from clausespark.operators import blocks, linear, rules, splits
from clausespark.operators import vocabulary as V
from clausespark.plans import production
from clausespark.session import cut_lineage

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"


def tokens_sql(source: str = "documents", keys: str = "doc_id") -> str:
    return f"SELECT {keys}, {TOKENS} AS t FROM {source}"


def grams_sql(lo: int, hi: int, source: str = "documents", keys: str = "doc_id") -> str:
    parts = []
    for n in range(lo, hi + 1):
        joined = " || ' ' || ".join(f"t[i + {j}]" for j in range(n))
        parts.append(
            f"SELECT {keys}, {joined} AS term FROM (SELECT {keys}, t, "
            f"unnest(range(1, greatest(len(t) - {n - 1}, 0) + 1)) AS i FROM ({tokens_sql(source, keys)}))"
        )
    return " UNION ALL ".join(parts)


def char_grams_sql(lo: int, hi: int, source: str = "documents") -> str:
    parts = []
    for n in range(lo, hi + 1):
        keep = "TRUE" if n == lo else f"length(p) >= {n}"
        parts.append(
            f"SELECT doc_id, substr(p, i::INT, {n}) AS term FROM (SELECT doc_id, p, "
            f"unnest(range(1, greatest(length(p) - {n}, 0) + 2)) AS i FROM padded WHERE {keep})"
        )
    return " UNION ALL ".join(parts)


PADDED = (
    f"padded AS (SELECT doc_id, ' ' || unnest({WORDS_SQL.replace('(text,', '(lower(text),')}) || ' ' AS p FROM documents)"
)


def counts_cte(grams: str, keys: str = "doc_id") -> str:
    return f"counts AS (SELECT {keys}, term, count(*) AS tf FROM ({grams}) GROUP BY ALL)"


def vocab_cte(limit: int, n_docs: str, counts: str = "counts", min_df: int = 2, max_df: float = 0.95) -> str:
    return f"""vocab AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS term_id,
    ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0 AS idf
  FROM (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, any_value(nd.n) AS n FROM {counts},
    (SELECT {n_docs} AS n) nd GROUP BY term
    HAVING count(*) >= {min_df} AND count(*) <= {max_df}::DOUBLE * any_value(nd.n) ORDER BY cf DESC, term LIMIT {limit}))"""


def weights_cte(sublinear: bool = True, name: str = "weights", counts: str = "counts") -> str:
    tf = "(1.0::DOUBLE + ln(tf))" if sublinear else "tf::DOUBLE"
    return f"""{name} AS (SELECT doc_id, term, term_id, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight
  FROM (SELECT doc_id, term, term_id, tf, {tf} * idf AS raw FROM {counts} JOIN vocab USING (term)))"""


def plain_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "text")


N_DOCS = "(SELECT count(*) FROM documents)"


@register(
    "term_tokens",
    f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(t) AS token FROM ({tokens_sql()})) GROUP BY token",
)
def term_tokens(spark, sf_dir):
    counts = V.count_terms(plain_documents(spark, sf_dir), V.TermSpec(hi=1))
    return counts.groupBy(F.col("term").alias("token")).agg(F.sum("tf").alias("n"), F.count("*").alias("n_docs"))


@register(
    "term_ngrams",
    f"WITH {counts_cte(grams_sql(1, 3))} SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 2",
)
def term_ngrams(spark, sf_dir):
    counts = V.count_terms(plain_documents(spark, sf_dir), V.PRODUCTION)
    totals = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return totals.where("df >= 2")


@register(
    "term_char_ngrams",
    f"""WITH {PADDED}, {counts_cte(char_grams_sql(4, 6))}
SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 2""",
)
def term_char_ngrams(spark, sf_dir):
    counts = V.count_terms(plain_documents(spark, sf_dir), V.CHARACTERS_20K)
    totals = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return totals.where("df >= 2")


@register(
    "term_counts_without_accents",
    f"""WITH folded AS (SELECT doc_id, strip_accents(text) AS text FROM documents),
{counts_cte(grams_sql(1, 2, 'folded'))} SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 2""",
)
def term_counts_without_accents(spark, sf_dir):
    counts = V.count_terms(plain_documents(spark, sf_dir), V.TermSpec(hi=2, strip_accents=True))
    totals = counts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return totals.where("df >= 2")


VOCAB_COLUMNS = "term, df, cf, round(idf, 6) AS idf, term_id::INT AS term_id"


@register(
    "vocabulary_production",
    f"WITH {counts_cte(grams_sql(1, 3))}, {vocab_cte(40000, N_DOCS)} SELECT {VOCAB_COLUMNS} FROM vocab",
)
def vocabulary_production(spark, sf_dir):
    """1-3-grams, 40,000 terms."""
    vocabulary = V.fit(plain_documents(spark, sf_dir), V.PRODUCTION)
    return vocabulary.withColumn("idf", F.round("idf", 6))


@register(
    "vocabulary_characters",
    f"WITH {PADDED}, {counts_cte(char_grams_sql(4, 6))}, {vocab_cte(20000, N_DOCS)} SELECT {VOCAB_COLUMNS} FROM vocab",
)
def vocabulary_characters(spark, sf_dir):
    vocabulary = V.fit(plain_documents(spark, sf_dir), V.CHARACTERS_20K)
    return vocabulary.withColumn("idf", F.round("idf", 6))


SIZES = [5_000, 10_000, 20_000, 50_000, 100_000]


@register(
    "vocabulary_size_coverage",
    f"""WITH {counts_cte(grams_sql(1, 2))}, {vocab_cte(100000, N_DOCS)},
ranked AS (SELECT cf, df, row_number() OVER (ORDER BY cf DESC, term) AS r FROM vocab)
SELECT s AS size, count(*) AS n_terms, sum(cf)::BIGINT AS occurrences, min(cf) AS min_cf, round(avg(df), 6) AS mean_df
FROM ranked, (SELECT unnest({SIZES}) AS s) WHERE r <= s GROUP BY s""",
)
def vocabulary_size_coverage(spark, sf_dir):
    """One ranked vocabulary serves every size: a smaller one is its head, not a new fit."""
    spec = V.TermSpec(hi=2, max_features=max(SIZES))
    ranked = V.rank_terms(V.fit(plain_documents(spark, sf_dir), spec))
    sized = ranked.withColumn("size", F.explode(F.array(*[F.lit(s).cast("int") for s in SIZES])))
    return sized.where(F.col("rank") <= F.col("size")).groupBy("size").agg(
        F.count("*").alias("n_terms"),
        F.sum("cf").alias("occurrences"),
        F.min("cf").alias("min_cf"),
        F.round(F.avg("df"), 6).alias("mean_df"),
    )


TRAIN = f"(SELECT doc_id, text FROM documents WHERE {hash_bucket_sql()} >= 20)"
TRAIN_COUNTS = f"""train AS {TRAIN}, {counts_cte(grams_sql(1, 2, 'train'))},
{vocab_cte(20000, '(SELECT count(*) FROM train)')},
allcounts AS (SELECT doc_id, term, count(*) AS tf FROM ({grams_sql(1, 2)}) GROUP BY ALL)"""


def _train_fit(spark, sf_dir, spec):
    docs = splits.hash_split(plain_documents(spark, sf_dir))
    return docs, V.fit(docs.where("split = 'train'"), spec)


@register(
    "term_counts_raw_and_sublinear",
    f"""WITH {TRAIN_COUNTS} SELECT doc_id, term, tf, round(1.0::DOUBLE + ln(tf), 6) AS tf_sublinear
FROM allcounts SEMI JOIN vocab USING (term)""",
)
def term_counts_raw_and_sublinear(spark, sf_dir):
    docs, vocabulary = _train_fit(spark, sf_dir, V.BIGRAMS_20K)
    counts = V.count_terms(docs, V.BIGRAMS_20K, vocabulary=vocabulary)
    return counts.withColumn("tf_sublinear", F.round(V.tf_weight(F.col("tf"), True), 6))


@register(
    "tfidf_train_fit_all_transform",
    f"WITH {TRAIN_COUNTS}, {weights_cte(counts='allcounts')} SELECT doc_id, term, term_id::INT AS term_id, tf, round(weight, 6) AS weight FROM weights",
)
def tfidf_train_fit_all_transform(spark, sf_dir):
    docs, vocabulary = _train_fit(spark, sf_dir, V.BIGRAMS_20K)
    return V.transform(docs, vocabulary, V.BIGRAMS_20K).withColumn("weight", F.round("weight", 6))


@register(
    "tfidf_production_norms",
    f"""WITH {counts_cte(grams_sql(1, 3))}, {vocab_cte(40000, N_DOCS)}, {weights_cte()}
SELECT doc_id, count(*) AS n_terms, round(sum(weight * weight), 6) AS norm, round(max(weight), 6) AS top_weight FROM weights GROUP BY doc_id""",
)
def tfidf_production_norms(spark, sf_dir):
    """The production TF-IDF; every document's row has length one."""
    docs = plain_documents(spark, sf_dir)
    weights = V.transform(docs, V.fit(docs, V.PRODUCTION), V.PRODUCTION)
    return weights.groupBy("doc_id").agg(
        F.count("*").alias("n_terms"),
        F.round(F.sum(F.col("weight") ** 2), 6).alias("norm"),
        F.round(F.max("weight"), 6).alias("top_weight"),
    )


@register(
    "tfidf_vectors",
    f"""WITH {counts_cte(grams_sql(1, 1))}, {vocab_cte(5000, N_DOCS)}, {weights_cte()}
SELECT doc_id, count(w.term) AS n_entries, round(coalesce(sum(weight), 0), 6) AS total
FROM documents LEFT JOIN weights w USING (doc_id) GROUP BY doc_id""",
)
def tfidf_vectors(spark, sf_dir):
    """Sparse ML vectors; checked by their number of entries and their sum."""
    from pyspark.ml.functions import vector_to_array

    docs = plain_documents(spark, sf_dir)
    spec = V.TermSpec(hi=1, max_features=5_000)
    weights = V.transform(docs, V.fit(docs, spec), spec)
    dense = V.to_vectors(weights, docs, 5_000).select("doc_id", vector_to_array("features").alias("v"))
    return dense.select(
        "doc_id",
        F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("n_entries"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


SECTIONED = """sectioned AS (SELECT doc_id, i AS section, substr(text, lo + 1, hi - lo) AS text FROM (
  SELECT doc_id, text, i, round_even(length(text) * i / 4, 0)::BIGINT AS lo,
         round_even(length(text) * (i + 1) / 4, 0)::BIGINT AS hi
  FROM documents, (SELECT unnest([0, 1, 2, 3]) AS i)))"""


@register(
    "tfidf_positional",
    f"""WITH {SECTIONED}, {counts_cte(grams_sql(1, 2, 'sectioned', 'doc_id, section'), 'doc_id, section')},
stats AS (SELECT section, term, count(*) AS df, sum(tf) AS cf FROM counts GROUP BY 1, 2
  HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * {N_DOCS}),
vocab AS (SELECT *, ln((1.0::DOUBLE + {N_DOCS}) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM stats
  QUALIFY row_number() OVER (PARTITION BY section ORDER BY cf DESC, term) <= 5000),
raw AS (SELECT doc_id, section, term, (1.0::DOUBLE + ln(tf)) * idf AS raw FROM counts JOIN vocab USING (section, term))
SELECT doc_id, section, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id, section)), 6) AS weight FROM raw""",
)
def tfidf_positional(spark, sf_dir):
    """One vocabulary and TF-IDF per quarter of the text, all quarters in one job."""
    sections = blocks.section_rows(plain_documents(spark, sf_dir))
    vocabulary = V.fit(sections, V.SECTIONS_5K)
    weights = V.transform(sections, vocabulary, V.SECTIONS_5K)
    return weights.select("doc_id", "section", "term", F.round("weight", 6).alias("weight"))


WINDOWED = f"""windowed AS (SELECT doc_id, i AS win, CASE WHEN len(w) <= 400 THEN text
  ELSE array_to_string(list_slice(w, i * 200 + 1, i * 200 + 400), ' ') END AS text
FROM (SELECT doc_id, text, w,
  unnest(range(CASE WHEN len(w) <= 400 THEN 1 ELSE ceil((len(w) - 400) / 200)::BIGINT + 1 END)) AS i
  FROM (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents)))"""


@register(
    "tfidf_window_max_pool",
    f"""WITH {counts_cte(grams_sql(1, 2))}, {vocab_cte(10000, N_DOCS)}, {WINDOWED},
wc AS (SELECT doc_id, win, term, count(*) AS tf FROM ({grams_sql(1, 2, 'windowed', 'doc_id, win')}) GROUP BY ALL),
raw AS (SELECT doc_id, win, term, (1.0::DOUBLE + ln(tf)) * idf AS raw FROM wc JOIN vocab USING (term)),
w AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id, win)) AS weight FROM raw)
SELECT doc_id, term, round(max(weight), 6) AS weight FROM w GROUP BY doc_id, term""",
)
def tfidf_window_max_pool(spark, sf_dir):
    docs = plain_documents(spark, sf_dir)
    spec = V.TermSpec(hi=2, max_features=10_000)
    vocabulary = V.fit(docs, spec)
    windows = blocks.window_rows(V.by_document(docs))
    pooled = V.max_pool(V.transform_windows(windows, vocabulary, spec, "win", placed=True))
    return pooled.select("doc_id", "term", F.round("weight", 6).alias("weight"))


DENSE_NAMES = [*SYNTAX_PATTERNS, *STRUCTURE_NAMES]


def _stacked_sql() -> str:
    """All blocks and their numbering: 20,000 terms, 5,000 terms of each quarter, 42 dense features."""
    quarters = SECTIONED.replace("FROM documents", "FROM contracts").replace("sectioned AS", "quarters AS")
    dense = f"SELECT * FROM ({_syntax_sql()}) JOIN ({structure_sql()}) USING (doc_id)"
    return f"""WITH {CONTRACTS_SQL}, {counts_cte(grams_sql(1, 2, 'contracts'))},
{vocab_cte(20000, '(SELECT count(*) FROM contracts)')}, {weights_cte()}, {quarters},
qcounts AS (SELECT doc_id, section, term, count(*) AS tf FROM ({grams_sql(1, 2, 'quarters', 'doc_id, section')}) GROUP BY ALL),
qvocab AS (SELECT *, ln((1.0::DOUBLE + {N_DOCS}) / (1.0::DOUBLE + df)) + 1.0 AS idf FROM (
    SELECT section, term, count(*) AS df, sum(tf) AS cf FROM qcounts GROUP BY 1, 2
    HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * {N_DOCS})
  QUALIFY row_number() OVER (PARTITION BY section ORDER BY cf DESC, term) <= 5000),
qraw AS (SELECT doc_id, section, term, (1.0::DOUBLE + ln(tf)) * idf AS raw FROM qcounts JOIN qvocab USING (section, term)),
dense AS (UNPIVOT ({dense}) ON {', '.join(DENSE_NAMES)} INTO NAME feature VALUE weight),
stacked AS (SELECT doc_id, 0 AS b, 'terms' AS block, term AS feature, weight FROM weights
  UNION ALL SELECT doc_id, 1, 'positional', section || ':' || term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id, section)) FROM qraw
  UNION ALL SELECT doc_id, 2, 'dense', feature, weight FROM dense WHERE weight <> 0),
names AS (SELECT 0 AS b, term AS feature FROM vocab UNION ALL SELECT 1, section || ':' || term FROM qvocab
  UNION ALL SELECT 2, unnest([{', '.join(map(quoted, DENSE_NAMES))}])),
space AS (SELECT b, feature, (row_number() OVER (ORDER BY b, feature) - 1)::INT AS position FROM names)
SELECT doc_id, block, feature, position, round(weight, 6) AS weight FROM stacked JOIN space USING (b, feature)"""


def stacked_blocks(docs, fit_on=None):
    """Rows (doc_id, block, feature, weight) of all three blocks of the documents, and the numbering of their features.

    Vocabularies are those of ``fit_on``, of the documents themselves without it.
    """
    fitted = docs if fit_on is None else fit_on
    vocabulary, quarters = V.fit(fitted, V.BIGRAMS_20K), V.fit(blocks.section_rows(fitted), V.SECTIONS_5K)
    named = F.concat_ws(":", F.col("section"), F.col("term"))
    rates = [F.round(c, 6) for c in [*X.syntax_rates(F.col("text")), *X.structure_rates(F.col("text"))]]
    stacked = blocks.stack(
        {
            "terms": V.transform(docs, vocabulary, V.BIGRAMS_20K).select("doc_id", F.col("term").alias("feature"), "weight"),
            "positional": V.transform(blocks.section_rows(docs), quarters, V.SECTIONS_5K).select("doc_id", named.alias("feature"), "weight"),
            "dense": blocks.dense_block(docs.select("doc_id", *[c.alias(n) for c, n in zip(rates, DENSE_NAMES)]), DENSE_NAMES),
        }
    )
    space = blocks.feature_space(
        {
            "terms": vocabulary.select(F.col("term").alias("feature")),
            "positional": quarters.select(named.alias("feature")),
            "dense": docs.sparkSession.createDataFrame([(n,) for n in DENSE_NAMES], "feature string"),
        }
    )
    return stacked, space


@register("feature_blocks_stacked", _stacked_sql())
def feature_blocks_stacked(spark, sf_dir):
    """The 20,000-term block, the positional block of four quarters and 42 dense features in one feature space."""
    stacked, space = stacked_blocks(cut_lineage(contracts(spark, sf_dir).select("doc_id", "text")))
    return blocks.positioned(stacked, space).select("doc_id", "block", "feature", "position", F.round("weight", 6).alias("weight"))


@register(
    "vectors_mean_pooled",
    """SELECT label, dim, round(avg(v), 5) AS value FROM (
  SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, dim""",
)
def vectors_mean_pooled(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return blocks.pool_vectors(vectors, "label").withColumn("value", F.round("value", 5))


@register(
    "vectors_max_pooled",
    """SELECT label, dim, round(max(v), 5) AS value FROM (
  SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label, dim""",
)
def vectors_max_pooled(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return blocks.pool_vectors(vectors, "label", how="max").withColumn("value", F.round("value", 5))


# ---- rules and closed-form classifiers ------------------------------------------------


def _keyword_sql() -> str:
    from clausespark.fixed.keyword_rules import KEYWORD_RULES

    parts = []
    for clause, phrases in KEYWORD_RULES.items():
        any_of = " OR ".join(f"contains(l, {quoted(p)})" for p in phrases)
        parts.append(f"SELECT doc_id, {quoted(clause)} AS clause, ({any_of})::INT AS pred FROM lowered_contracts")
    return with_contracts(
        ", lowered_contracts AS (SELECT doc_id, lower(text) AS l FROM contracts) " + " UNION ALL ".join(parts)
    )


@register("keyword_rule_predictions", _keyword_sql())
def keyword_rule_predictions(spark, sf_dir):
    return rules.keyword_predictions(contracts(spark, sf_dir))


def _boolean_sql() -> str:
    from clausespark.catalog.text_features import _unfair_sql

    rules_sql = {
        "Limitation of liability": "has_not_liable + has_limitation + has_disclaimer > 0",
        "Unilateral termination": "has_terminate = 1 AND has_any_time + has_sole_discretion + has_right_to > 0",
        "Unilateral change": "has_modify_terms = 1 OR (has_right_to = 1 AND has_any_time = 1)",
        "Content removal": "has_terminate = 1 AND has_we_may = 1 AND has_governing_law = 0",
        "Contract by using": "has_by_using + has_agree > 0",
        "Choice of law": "has_governing_law = 1",
        "Jurisdiction": "has_jurisdiction = 1 AND has_arbitration = 0",
        "Arbitration": "has_arbitration = 1",
    }
    parts = [f"SELECT doc_id, {quoted(n)} AS clause, ({c})::INT AS pred FROM f" for n, c in rules_sql.items()]
    return f"WITH f AS ({_unfair_sql()}) " + " UNION ALL ".join(parts)


@register("boolean_rule_predictions", _boolean_sql())
def boolean_rule_predictions(spark, sf_dir):
    return rules.boolean_predictions(contracts(spark, sf_dir))


@register(
    "class_weights",
    with_scores(
        """SELECT clause, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
  round(count(*) / (2 * sum(y)), 6) AS balanced_pos, round(count(*) / (2 * sum(1 - y)), 6) AS balanced_neg,
  round(greatest(1.0, sum(1 - y) / sum(y)), 6) AS scale_pos, round(least(sum(1 - y) / sum(y), 20.0), 6) AS scale_pos_capped,
  round(avg(1 - y), 6) AS prior_weight_pos, round(avg(y), 6) AS prior_weight_neg
FROM scores WHERE split = 'train' GROUP BY clause"""
    ),
)
def class_weights(spark, sf_dir):
    from clausespark.catalog.inputs import clause_scores

    weights = linear.class_weights(clause_scores(spark, sf_dir).where("split = 'train'"))
    return weights.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in weights.dtypes])


NB_CLAUSES = CLAUSE_NAMES
NB_SPEC = production.COUNTS

NB_BASE = f"""{SCORES_SQL},
labels AS (SELECT doc_id, clause, y FROM scores WHERE clause IN ({', '.join(quoted(c) for c in NB_CLAUSES)}) AND split = 'train'),
train AS (SELECT doc_id, text FROM contracts WHERE {hash_bucket_sql()} >= 20),
{counts_cte(grams_sql(1, 2, 'train'))}, {vocab_cte(50000, '(SELECT count(*) FROM train)')},
kept AS (SELECT doc_id, term, tf FROM counts SEMI JOIN vocab USING (term)),
n AS (SELECT clause, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0 FROM labels GROUP BY clause),
tot AS (SELECT term, sum(tf)::DOUBLE AS total FROM kept GROUP BY term),
pos AS (SELECT clause, term, sum(tf)::DOUBLE AS p FROM kept JOIN labels USING (doc_id) WHERE y = 1 GROUP BY 1, 2),
sums AS (SELECT n.clause, tot.term, total, coalesce(p, 0) AS p, n1, n0 FROM n CROSS JOIN tot LEFT JOIN pos USING (clause, term)),
testcounts AS (SELECT doc_id, term, count(*) AS tf FROM ({grams_sql(1, 2, 'contracts')}) GROUP BY ALL)"""

NB_SCORE = """, margin AS (SELECT doc_id, clause, sum(tf * w) AS m FROM testcounts JOIN coef USING (term) GROUP BY 1, 2)
SELECT c.doc_id, n.clause, round(1 / (1 + exp(-(coalesce(m, 0) + bias))), 5) AS prob
FROM contracts c CROSS JOIN (SELECT clause, any_value(bias) AS bias FROM coef GROUP BY clause) n
LEFT JOIN margin USING (doc_id, clause)"""


def nb_labels(train):
    """Label rows written once: they are joined to the texts and counted per clause."""
    return cut_lineage(score_rows(train).where(F.col("clause").isin(NB_CLAUSES)).select("doc_id", "clause", "y"))


def contract_splits(spark, sf_dir):
    return splits.hash_split(contracts(spark, sf_dir).select("doc_id", "text"))


def _nb_inputs(spark, sf_dir, scores=None, docs=None):
    """All documents with their term counts, the training labels and the sums of the kept terms.

    The counts are made once: the vocabulary, the sums and the scores all read them. Labels come from written ``scores``, texts from
    written ``docs`` (``contract_splits``), if given.
    """
    docs = contract_splits(spark, sf_dir) if docs is None else docs
    if scores is None:
        labels = nb_labels(docs.where("split = 'train'").drop("split"))
    else:
        labels = scores.where("split = 'train'").where(F.col("clause").isin(NB_CLAUSES)).select("doc_id", "clause", "y")
    counted = V.counted_texts(linear.with_labels(docs, labels, NB_CLAUSES, how="left"), NB_SPEC)
    masks = linear.mask_names(len(NB_CLAUSES))
    train = counted.where("split = 'train'")
    rows = train.select("doc_id", *masks, F.inline("counts"))
    vocabulary = cut_lineage(V.fit_vocabulary(rows, V.document_count(train), NB_SPEC))
    kept = rows.where(F.col(masks[0]).isNotNull()).join(V.sent_whole(vocabulary.select("term"), NB_SPEC), "term", "left_semi")
    sums = cut_lineage(linear.term_sums(kept, len(NB_CLAUSES)))
    return counted.select("doc_id", "counts"), labels, sums


NB_COEF = """coef AS (SELECT clause, term, ln((p + 0.5) / (sum(p) OVER c + 0.5 * count(*) OVER c))
    - ln((total - p + 0.5) / (sum(total - p) OVER c + 0.5 * count(*) OVER c)) AS w, ln(n1 / n0) AS bias
  FROM sums WINDOW c AS (PARTITION BY clause))"""


@register("naive_bayes_multinomial", f"WITH {NB_BASE},\n{NB_COEF}{NB_SCORE}")
def naive_bayes_multinomial(spark, sf_dir):
    counted, labels, sums = _nb_inputs(spark, sf_dir)
    model = replace(linear.multinomial_nb(sums, labels, NB_CLAUSES), spec=NB_SPEC)
    return linear.score_counted(counted, model).withColumn("prob", F.round("prob", 5))


COMPLEMENT_COEF = """wsum AS (SELECT clause, term, p * (n0 / (n0 + n1)) + 0.5 AS cp, (total - p) * (n1 / (n0 + n1)) + 0.5 AS cn FROM sums),
logs AS (SELECT clause, term, ln(cp / sum(cp) OVER c) AS lp, ln(cn / sum(cn) OVER c) AS ln_ FROM wsum
  WINDOW c AS (PARTITION BY clause)),
coef AS (SELECT clause, term, ln_ / sum(ln_) OVER c - lp / sum(lp) OVER c AS w, 0.0 AS bias FROM logs
  WINDOW c AS (PARTITION BY clause))"""


@register("naive_bayes_complement", f"WITH {NB_BASE},\n{COMPLEMENT_COEF}{NB_SCORE}")
def naive_bayes_complement(spark, sf_dir):
    counted, labels, sums = _nb_inputs(spark, sf_dir)
    model = replace(linear.complement_nb(sums, labels, NB_CLAUSES), spec=NB_SPEC)
    return linear.score_counted(counted, model).withColumn("prob", F.round("prob", 5))


CHI_BASE = f"""{SCORES_SQL},
labels AS (SELECT doc_id, clause, y FROM scores WHERE clause IN ({', '.join(quoted(c) for c in NB_CLAUSES)}) AND split = 'train'),
train AS (SELECT doc_id, text FROM contracts WHERE {hash_bucket_sql()} >= 20),
{counts_cte(grams_sql(1, 2, 'train'))}, {vocab_cte(20000, '(SELECT count(*) FROM train)')}, {weights_cte()},
share AS (SELECT clause, avg(y) AS share FROM labels GROUP BY clause),
tot AS (SELECT term, sum(weight) AS total FROM weights GROUP BY term),
pos AS (SELECT clause, term, sum(weight) AS p FROM weights JOIN labels USING (doc_id) WHERE y = 1 GROUP BY 1, 2),
stat AS (SELECT clause, term, (p - share * total) ** 2 / (share * total)
    + ((total - p) - (1 - share) * total) ** 2 / ((1 - share) * total) AS chi2
  FROM (SELECT s.clause, t.term, share, total, coalesce(p, 0) AS p FROM share s CROSS JOIN tot t LEFT JOIN pos USING (clause, term)))"""


def chi2_table(spark, sf_dir, docs=None, labels=None):
    """``docs`` (``contract_splits``) and ``labels`` (``nb_labels``) are written ones; the texts are read four times."""
    docs = cut_lineage(contract_splits(spark, sf_dir)) if docs is None else docs
    train = docs.where("split = 'train'").drop("split")
    labels = nb_labels(train) if labels is None else labels
    vocabulary = V.fit(train, V.BIGRAMS_20K)
    labelled = linear.with_labels(V.by_document(train), labels, NB_CLAUSES)
    weights = V.transform(labelled, vocabulary, V.BIGRAMS_20K, carry=linear.mask_names(len(NB_CLAUSES)), placed=True)
    sums = linear.term_sums(weights, len(NB_CLAUSES), "weight")
    shares = labels.groupBy("clause").agg(F.avg("y").alias("share"))
    return blocks.chi2(sums, shares, NB_CLAUSES)


@register("chi2_scores", f"WITH {CHI_BASE} SELECT clause, term, round(chi2, 5) AS chi2 FROM stat")
def chi2_scores(spark, sf_dir):
    return chi2_table(spark, sf_dir).withColumn("chi2", F.round("chi2", 5))


@register(
    "chi2_selected_terms",
    f"""WITH {CHI_BASE} SELECT clause, term, round(chi2, 5) AS chi2 FROM stat
QUALIFY row_number() OVER (PARTITION BY clause ORDER BY round(chi2, 5) DESC, term) <= 100""",
)
def chi2_selected_terms(spark, sf_dir):
    rounded = chi2_table(spark, sf_dir).withColumn("chi2", F.round("chi2", 5))
    return blocks.select_k(rounded, 100).drop("position")


# A linear model of fixed form: the weight of a term is its idf, signed by clause and spelling.
LINEAR_WEIGHT = "idf * (CASE WHEN contains(term, {part}) THEN 1.0 ELSE -0.05 END)"
LINEAR_PARTS = {clause: max(clause.lower().replace("-", " ").split(), key=len)[:5] for clause in CLAUSE_NAMES}


@register(
    "linear_scores",
    f"""WITH {CONTRACTS_SQL}, {counts_cte(grams_sql(1, 2, 'contracts'))},
{vocab_cte(20000, '(SELECT count(*) FROM contracts)')}, {weights_cte()},
coef AS ({' UNION ALL '.join(f"SELECT {quoted(c)} AS clause, term, {LINEAR_WEIGHT.format(part=quoted(p))} AS w FROM vocab" for c, p in LINEAR_PARTS.items())}),
margin AS (SELECT doc_id, clause, sum(weight * w) AS m FROM weights JOIN coef USING (term) GROUP BY 1, 2)
SELECT c.doc_id, k.clause, round(1 / (1 + exp(-(coalesce(m, 0) - 0.25))), 6) AS prob
FROM contracts c CROSS JOIN (SELECT DISTINCT clause FROM coef) k LEFT JOIN margin USING (doc_id, clause)""",
)
def linear_scores(spark, sf_dir):
    """All clauses of a linear model from one pass over the documents' term weights."""
    docs = cut_lineage(contracts(spark, sf_dir).select("doc_id", "text"))
    vocabulary = V.fit(docs, V.BIGRAMS_20K)
    weights = V.transform(docs, vocabulary, V.BIGRAMS_20K)
    columns = []
    for i, part in enumerate(LINEAR_PARTS.values()):
        sign = F.when(F.contains("term", F.lit(part)), 1.0).otherwise(-0.05)
        columns.append((F.col("idf") * sign).alias(f"w{i}"))
    model = linear.LinearModel(vocabulary.select("term", *columns), [-0.25] * len(columns), list(LINEAR_PARTS), V.BIGRAMS_20K)
    scores = linear.score_weights(docs, weights, model, V.BIGRAMS_20K)
    return scores.withColumn("prob", F.round("prob", 6))
