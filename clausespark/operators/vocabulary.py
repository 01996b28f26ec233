"""Vocabularies and TF-IDF as relational jobs over (document, term) counts.

Terms are counted inside each text's own row, so counting moves nothing; the corpus statistics of the
terms are summed per task and then shuffled once. Weighting distributes the text by document, joins
the broadcast vocabulary and normalises in the same task; there are as many tasks as the text needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from clausespark.functions import terms as N
from clausespark.functions import text as X
from clausespark.operators import counting
from clausespark.session import cut_lineage

#: Bytes of text that one task weighs, and the largest vocabulary that is broadcast.
TASK_BYTES, BROADCAST_TERMS = 4 << 20, 100_000


@dataclass(frozen=True)
class TermSpec:
    """How text becomes terms, which terms are kept and how they are weighted."""

    analyzer: str = "word"
    lo: int = 1
    hi: int = 3
    min_df: int = 2
    max_df: float = 0.95
    max_features: int | None = 40_000
    sublinear: bool = True
    smooth_idf: bool = True
    strip_accents: bool = False
    keys: tuple[str, ...] = ()  # extra grouping columns, such as a section or window number


PRODUCTION = TermSpec()
BIGRAMS_20K = TermSpec(hi=2, max_features=20_000)
CHARACTERS_20K = TermSpec(analyzer="char_wb", lo=4, hi=6, max_features=20_000)
SECTIONS_5K = TermSpec(hi=2, max_features=5_000, keys=("section",))


def by_document(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of a document in one task, so later grouping by document moves nothing.

    The texts are measured first: a task gets some ``TASK_BYTES``, however large the table is, since its memory grows with
    the term rows it sorts.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES)), id_col)


def sent_whole(table: DataFrame, spec: TermSpec) -> DataFrame:
    """A table with a row per term of a capped vocabulary, to be broadcast: a join by term would bring all rows of a frequent
    term to one task."""
    capped = spec.max_features is not None and spec.max_features <= BROADCAST_TERMS
    return F.broadcast(table) if capped else table


def term_counts(spec: TermSpec, text: str = "text") -> Column:
    """The terms of one text with their counts, as an array of (term, tf)."""
    source = X.strip_accents(F.col(text)) if spec.strip_accents else F.col(text)
    if spec.analyzer == "char_wb":
        spelled = F.transform(
            X.words(F.lower(source)), lambda word: N.word_char_ngrams(word, spec.lo, spec.hi)
        )
        terms = F.flatten(spelled)
    else:
        terms = N.word_ngrams(N.word_tokens(source), spec.lo, spec.hi)
    return N.counted(terms)


def counted_texts(df: DataFrame, spec: TermSpec, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``counts`` in place of the text, written out: for several uses of the same counts."""
    return cut_lineage(df.withColumn("counts", term_counts(spec, text)).drop(text))


def count_terms(
    df: DataFrame,
    spec: TermSpec,
    id_col: str = "doc_id",
    text: str = "text",
    vocabulary: DataFrame | None = None,
    carry: Sequence[str] = (),
    outer: bool = False,
    counted: bool = False,
) -> DataFrame:
    """(id, carried columns, keys, term, tf); with a vocabulary its terms only.

    Each row of ``df`` is one text; no rows are moved. With ``outer`` a text without terms gives one
    row of nulls, so that later sums by document know of it. ``counted`` texts are those of ``counted_texts``.
    """
    inline = F.inline_outer if outer else F.inline
    rows = df.select(id_col, *carry, *spec.keys, inline(F.col("counts") if counted else term_counts(spec, text)))
    if vocabulary is not None:
        known = vocabulary.select(*spec.keys, "term")
        rows = rows.join(sent_whole(known, spec), [*spec.keys, "term"], "left_semi")
    return rows.select(id_col, *carry, *spec.keys, "term", "tf")


def fit_vocabulary(counts: DataFrame, n_docs: Column, spec: TermSpec) -> DataFrame:
    """(keys, term, df, cf, idf, term_id): document-frequency limits, then the most frequent terms.

    Ties at the cut go to the alphabetically first term; ids follow the alphabet.
    """
    keys = list(spec.keys)
    stats = counts.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    kept = stats.where((F.col("df") >= spec.min_df) & (F.col("df") <= F.lit(spec.max_df) * n_docs))
    most = [F.col("cf").desc(), F.col("term")]
    if spec.max_features is not None and keys:
        kept = _most_per_group(kept, keys, most, spec.max_features)
    elif spec.max_features is not None:
        kept = kept.orderBy(*most).limit(spec.max_features)
    named = kept.withColumn("idf", idf(n_docs, F.col("df"), spec.smooth_idf))
    if spec.max_features is None:
        return named
    # At most max_features rows per group are numbered.
    numbering = Window.partitionBy(*keys).orderBy("term")
    return named.withColumn("term_id", (F.row_number().over(numbering) - 1).cast("int"))


def _most_per_group(stats: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Top rows per group in two steps, so that no task sorts all terms of a group.

    Terms fall into hashed buckets; each bucket passes on its own first ``limit`` rows.
    """
    buckets = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = stats.withColumn("_bucket", F.pmod(F.hash("term"), F.lit(buckets)))
    first = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ahead = bucketed.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= limit)
    final = Window.partitionBy(*keys).orderBy(*order)
    return ahead.withColumn("_at", F.row_number().over(final)).where(F.col("_at") <= limit).drop("_at", "_bucket")


def idf(n_docs: Column, df: Column, smooth: bool = True) -> Column:
    if smooth:
        return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0
    return F.log(n_docs / df) + 1.0


def tf_weight(tf: Column, sublinear: bool) -> Column:
    return F.lit(1.0) + F.log(tf) if sublinear else tf.cast("double")


def document_count(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def fit(df: DataFrame, spec: TermSpec, id_col: str = "doc_id", text: str = "text", counted: bool = False) -> DataFrame:
    """The vocabulary of a table of texts. With keys, ``df`` holds one row per document and key.

    A capped vocabulary is written out: it is small, and every later use reads the same terms
    without counting the corpus again.
    """
    counts = count_terms(df, spec, id_col, text, counted=counted)
    n_docs = document_count(df) if not spec.keys else df.agg(F.countDistinct(id_col)).scalar()
    vocabulary = fit_vocabulary(counts, n_docs, spec)
    return cut_lineage(vocabulary) if spec.max_features is not None else vocabulary


def transform(
    df: DataFrame,
    vocabulary: DataFrame,
    spec: TermSpec,
    id_col: str = "doc_id",
    text: str = "text",
    carry: Sequence[str] = (),
    placed: bool = False,
) -> DataFrame:
    """(id, carried columns, keys, term, [term_id], tf, weight): L2-normalised TF-IDF.

    Texts without known terms give no rows. ``placed`` texts come from ``by_document``.
    """
    counts = count_terms(df if placed else by_document(df, id_col, text), spec, id_col, text, carry=carry)
    return _weigh(counts, vocabulary, spec, [id_col, *spec.keys], spec.keys)


def packed(
    df: DataFrame, vocabulary: DataFrame, spec: TermSpec, labels: DataFrame | None = None, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id, [y0..], i, w``: every document's terms and weights of ``transform`` as arrays, with its row of ``labels``, without
    which it is left out. Texts are counted, weighed and packed in one pass."""
    return packed_spaces(df, [(spec, vocabulary, 0)], labels, id_col, text)


def packed_spaces(
    df: DataFrame, spaces: Sequence[tuple[TermSpec, DataFrame, int]], labels: DataFrame | None = None, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The same for several vocabularies side by side, each with its first id."""
    texts = by_document(df.select(id_col, text), id_col, text)
    if labels is None:
        return counting.packed(texts, spaces, [], id_col, text)
    return counting.packed(texts.join(labels, id_col), spaces, [c for c in labels.columns if c != id_col], id_col, text)


def transform_windows(
    windows: DataFrame, vocabulary: DataFrame, spec: TermSpec, key: str, id_col: str = "doc_id", placed: bool = False
) -> DataFrame:
    """TF-IDF of each window with one vocabulary for all of them: (id, key, term, weight).

    ``placed`` windows were cut from texts that ``by_document`` has distributed, which moves less than their windows.
    """
    counts = count_terms(windows if placed else by_document(windows, id_col), spec, id_col, carry=[key])
    return _weigh(counts, vocabulary, spec, [id_col, key], ())


def _weigh(
    counts: DataFrame, vocabulary: DataFrame, spec: TermSpec, text_keys: Sequence[str], vocabulary_keys: Sequence[str]
) -> DataFrame:
    known = vocabulary.select(*vocabulary_keys, "term", "idf", *_ids(vocabulary))
    joined = counts.join(sent_whole(known, spec), [*vocabulary_keys, "term"])
    raw = joined.withColumn("_raw", tf_weight(F.col("tf"), spec.sublinear) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*text_keys)))
    weighed = raw.withColumn("weight", F.col("_raw") / norm)
    return weighed.select(*[c for c in counts.columns if c != "tf"], *_ids(vocabulary), "tf", "weight")


def _ids(vocabulary: DataFrame) -> list[str]:
    return ["term_id"] if "term_id" in vocabulary.columns else []


def rank_terms(vocabulary: DataFrame) -> DataFrame:
    """Add ``rank`` by corpus frequency over a capped vocabulary."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cf").desc(), "term")
    return vocabulary.withColumn("rank", F.row_number().over(order))


def max_pool(weights: DataFrame, id_col: str = "doc_id", keys: Sequence[str] = ("win",)) -> DataFrame:
    """The largest weight of each term over the windows of a document."""
    others = [c for c in weights.columns if c not in [*keys, "tf", "weight"]]
    return weights.groupBy(*others).agg(F.max("weight").alias("weight"))


VECTOR_JSON = T.StructType([T.StructField("v", VectorUDT())])


def sparse_vector(size: Column, indices: Column, values: Column) -> Column:
    """An ML sparse vector from sorted index and value arrays, made inside the JVM."""
    fields = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        size.cast("int").alias("size"),
        indices.alias("indices"),
        values.alias("values"),
    )
    return F.from_json(F.to_json(F.struct(fields.alias("v"))), VECTOR_JSON)["v"]


def to_vectors(
    weights: DataFrame, docs: DataFrame, size: int, id_col: str = "doc_id", index: str = "term_id", value: str = "weight"
) -> DataFrame:
    """(id, features) for every document; one without weights gets an all-zero vector."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(index).cast("int").alias("i"), F.col(value).alias("w"))))
    listed = weights.groupBy(id_col).agg(pairs.alias("pairs"))
    joined = docs.select(id_col).join(listed, id_col, "left")
    return joined.select(
        id_col,
        sparse_vector(
            F.lit(size),
            F.coalesce(F.transform("pairs", lambda p: p["i"]), F.array().cast("array<int>")),
            F.coalesce(F.transform("pairs", lambda p: p["w"]), F.array().cast("array<double>")),
        ).alias("features"),
    )
