"""Vocabularies are broadcast to term rows, tasks get texts by their size, texts and labels are gone through once."""

from pyspark.sql import functions as F

from clausespark.catalog import reports as report_queries, terms as term_queries
from clausespark.operators import blocks, linear
from clausespark.operators import vocabulary as V

ROWS = [(1, "alpha beta alpha gamma"), (2, "beta gamma delta"), (3, "alpha delta delta"), (3, "beta alpha"), (4, None), (None, "gamma beta")]


def texts(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def hidden_size(table):
    """The table with a size that Spark takes for too large to broadcast on its own."""
    table.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vocabularies_and_weights_are_broadcast(spark):
    docs, spec = texts(spark), V.TermSpec(hi=2, min_df=1, max_features=10)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        vocabulary = hidden_size(V.fit(docs, spec))
        weights = V.transform(docs, vocabulary, spec)
        assert "SortMergeJoin" not in plan(weights)
        table = vocabulary.select("term", F.col("idf").alias("w0"))
        model = linear.LinearModel(table, [0.0], ["Insurance"], spec)
        assert "SortMergeJoin" not in plan(model.joined(weights)) and "SortMergeJoin" not in plan(linear.score_counts(docs, model, spec))
        assert "SortMergeJoin" not in plan(V.count_terms(docs, spec, vocabulary=vocabulary))
        unknown = linear.LinearModel(table, [0.0], ["Insurance"])  # of unknown size: the optimiser decides
        assert "SortMergeJoin" in plan(unknown.joined(weights))
        norms = {r["doc_id"]: round(r["n"], 9) for r in weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
        assert norms == {1: 1.0, 2: 1.0, 3: 1.0, None: 1.0}  # texts that repeat an id are one document
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tasks_get_texts_by_size(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"))
    assert V.by_document(docs).rdd.getNumPartitions() == cores
    monkeypatch.setattr(V, "TASK_BYTES", 1000)
    assert V.by_document(docs).rdd.getNumPartitions() == 100
    assert V.by_document(docs.where("doc_id < 0")).rdd.getNumPartitions() == cores


def test_placed_windows_weigh_the_same(spark):
    docs, spec = texts(spark), V.TermSpec(hi=1, min_df=1, max_features=10)
    vocabulary = V.fit(docs, spec)
    plain = V.transform_windows(blocks.window_rows(docs, 2, 1), vocabulary, spec, "win")
    placed = V.transform_windows(blocks.window_rows(V.by_document(docs), 2, 1), vocabulary, spec, "win", placed=True)
    rows = lambda df: sorted(str((r["doc_id"], r["win"], r["term"], round(r["weight"], 9))) for r in df.collect())
    assert rows(plain) == rows(placed) and rows(plain)


def test_overlap_makes_texts_and_labels_once(spark, monkeypatch):
    words = ["insurance coverage shall", "no later than insurance", "audit right shall not", "renewal term of audit"]
    docs = spark.createDataFrame([(i, "en", "s", f"{words[i % 4]} and {words[i % 3]}") for i in range(60)], "doc_id long, lang string, source string, text string")
    made, scored, plain = [], [], term_queries.score_rows
    monkeypatch.setattr(term_queries, "contracts", lambda *_: made.append(1) or docs)
    monkeypatch.setattr(term_queries, "score_rows", lambda rows: scored.append(1) or plain(rows))
    report_queries.explain_term_overlap(spark, "").collect()
    assert len(made) == 1 and len(scored) == 1
