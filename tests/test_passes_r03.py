"""Texts and labels are gone through once: term positions, label counts, text files, sums of blocks."""

import numpy as np
from pyspark.sql import functions as F

from clausespark.catalog import corpus, labels as label_queries
from clausespark.functions import text as X
from clausespark.operators import boosting as B
from clausespark.operators import corpus_stats, reports
from clausespark.sources import tables

#: Stands for the costly scoring of labels in a plan.
MARK = "monotonically_increasing_id"


def marked(spark, rows):
    found = spark.createDataFrame(rows, "doc_id long, clause string, y int, split string")
    return found.withColumn("y", F.col("y") + (F.monotonically_increasing_id() * 0).cast("int"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


ROWS = [(1, "Insurance", 1, "train"), (1, "Audit Rights", 0, "train"), (2, "Insurance", 0, "test"), (2, "Audit Rights", 0, "test")]


def test_label_counts_read_written_rows(spark):
    found = corpus_stats.split_distribution(marked(spark, ROWS), ["train", "test"])
    assert MARK not in plan(found)
    got = {r["clause"]: (r["train"], r["test"], r["total"]) for r in found.collect()}
    assert got == {"Insurance": (1, 0, 1), "Audit Rights": (0, 0, 0), "ANY LABEL": (1, 0, 1), "NO LABEL": (0, 1, 1)}


def test_risk_versions_read_written_counts(spark, monkeypatch):
    monkeypatch.setattr(corpus, "clause_scores", lambda *_: marked(spark, ROWS))
    found = corpus.taxonomy_risk_versions(spark, "")
    assert MARK not in plan(found)
    assert {(r["clause"], r["n_pos"]) for r in found.collect()} == {("Insurance", 1), ("Audit Rights", 0)}


def test_text_is_lowered_once_for_all_terms(spark):
    docs = spark.createDataFrame([("A Café no",), ("",), (None,)], "text string")
    found = docs.select(X.terms_present(F.col("text"), ["CAFÉ", "no", "zz"]).alias("p"))
    assert "contains(lower(text" not in plan(found).lower()
    assert [r["p"] for r in found.collect()] == [["CAFÉ", "no"], [], []]


def test_positions_of_all_terms_split_a_text_once(spark, monkeypatch):
    calls, plain = [], X.padded_words
    monkeypatch.setattr(X, "padded_words", lambda text: calls.append(1) or plain(text))
    docs = spark.createDataFrame([(1, "a b c d"), (2, "d c b a"), (3, None)], "doc_id long, text string")
    terms = {"Insurance": ["a", "b c"], "Audit Rights": ["d"]}
    rows = [(1, "Insurance", 1, "train"), (2, "Insurance", 1, "train"), (2, "Audit Rights", 1, "train"), (3, "Insurance", 1, "train")]
    found = reports.position_analysis(docs, marked(spark, rows), terms)
    assert len(calls) == 1 and MARK not in plan(found)
    got = {r["clause"]: (r["n_positions"], r["median_position_pct"], r["in_second_half"]) for r in found.collect()}
    assert got == {"Insurance": (3, 25.0, 33.3), "Audit Rights": (1, 0.0, 0.0)}


def test_text_files_are_listed_by_name_below_a_folder(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "la b"), (-2, "é"), (3, "")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(label_queries, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    paths, plain = [], tables.read_text_contracts
    monkeypatch.setattr(tables, "read_text_contracts", lambda spark, path, **more: paths.append(path) or plain(spark, path, **more))
    rows = {r["doc_id"]: (r["n_chars"], r["was_broken"]) for r in label_queries.text_files_read(spark, f"{tmp_path}/in").collect()}
    assert rows == {1: (6, True), -2: (2, False), 3: (1, False)}
    assert not any("*" in path for path in paths)


def test_sums_of_many_blocks_are_added_up_on_the_way(monkeypatch):
    draw = np.random.default_rng(1)
    columns = [B.Column(0, B.Boosting(columns=1.0, min_rows=1), 2.0), B.Column(1, B.Boosting(columns=0.5), 1.0)]
    parts = []
    for _ in range(6):
        ptr = np.append(0, np.cumsum(draw.integers(0, 9, 30)))
        n = int(ptr[-1])
        block = B.Block(list(range(20)), ptr, draw.integers(0, 20, n).astype(np.int32), draw.integers(1, 3, n).astype(np.uint8),
                        draw.integers(0, 2, (20, 2)).astype(np.uint8), draw.integers(0, 2**60, 20).astype(np.uint64), np.zeros(20, bool))
        parts.append((block.prepared(4), np.zeros((2, 20))))
    calls, plain = [], B.summed
    monkeypatch.setattr(B, "summed", lambda key, sums: calls.append(len(key)) or plain(key, sums))
    tree = B.Trees.empty(2, 1)
    whole = dict(B.histograms(parts, columns, tree, 0, 0, 4))
    largest = max(calls)
    calls.clear()
    monkeypatch.setattr(B, "PENDING", 50)
    bounded = dict(B.histograms(parts, columns, tree, 0, 0, 4))
    assert len(calls) > 1 and max(calls) < largest
    for r, (key, sums, totals) in whole.items():
        assert (bounded[r][0] == key).all() and np.allclose(bounded[r][1], sums) and np.allclose(bounded[r][2], totals)
