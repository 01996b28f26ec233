import json

import pytest
from pyspark.sql import functions as F

from clausespark.fixed.taxonomy import CLAUSES
from clausespark.operators import splits
from clausespark.sources import qa_json, tables


def qa(i, question, texts, impossible=False):
    return {"id": i, "question": question, "is_impossible": impossible, "answers": [{"text": t} for t in texts]}


CORPUS = {
    "version": "tiny",
    "data": [
        {"title": "A", "paragraphs": [
            {"context": "First part.", "qas": [
                qa("A__Insurance", "Insurance?", ["  "]), qa("A__Governing Law", "governing law", ["laws of X"]),
                qa("noparts", "unicorn", ["x"])]},
            {"context": "Second part.", "qas": [qa("A__Insurance", "INSURANCE", ["cover"])]}]},
        {"title": "B", "paragraphs": [
            {"context": "Only part.", "qas": [
                qa("B__x__y", "which parties hold insurance", ["x"]), qa("B__Non-Compete", "non-compete", ["y"], True)]}]},
        {"title": "C", "paragraphs": [{"context": "", "qas": []}]},
    ],
}


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "corpus.json"
    path.write_text(json.dumps(CORPUS))
    return qa_json.read_entries(spark, str(path)).cache()


def test_contracts(entries):
    first = {r["contract_title"]: r["text"] for r in qa_json.contracts(entries).collect()}
    joined = {r["contract_title"]: r["text"] for r in qa_json.contracts(entries, True).collect()}
    assert first == {"A": "First part.", "B": "Only part.", "C": ""}
    assert joined["A"] == "First part. Second part."


def test_labels(entries):
    got = {(r["contract_title"], r["clause"]): r["y"] for r in qa_json.labels(entries).collect()}
    assert got == {("A", "Insurance"): 1, ("A", "Governing Law"): 1, ("B", "Parties"): 1, ("B", "Non-Compete"): 1}
    by_id = {(r["contract_title"], r["clause"]): r["y"] for r in qa_json.labels_from_ids(entries).collect()}
    assert by_id == {("A", "Insurance"): 0, ("A", "Governing Law"): 1, ("B", "Non-Compete"): 0}


def test_wide_labels_are_binary(entries):
    wide = tables.long_to_wide(qa_json.labels(entries), "contract_title", CLAUSES)
    assert len(wide.columns) == 42
    for row in wide.collect():
        assert all(row[c] in (0, 1) for c in CLAUSES)
    back = tables.wide_to_long(wide, "contract_title", tables.label_columns(wide))
    assert back.count() == 2 * 41 and back.agg(F.sum("y")).first()[0] == 4


def test_flat_rows_last_write_wins(spark):
    rows = spark.createDataFrame(
        [("t", "c1", "insurance", ["x"], 1), ("t", "c2", "insurance", [" "], 2), ("t", "c3", "exclusivity", [], 3)],
        "title string, context string, question string, answers array<string>, seq int",
    )
    got = {r["clause"]: r["y"] for r in qa_json.flat_labels(rows, "seq").collect()}
    assert got == {"Insurance": 0, "Exclusivity": 0}
    assert qa_json.flat_contracts(rows, "seq").first()["text"] == "c1"


def test_one_entry_per_line(spark, tmp_path, entries):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(e) for e in CORPUS["data"]))
    lines = qa_json.read_entries(spark, str(tmp_path / "lines.json"), one_entry_per_line=True)
    assert sorted(map(str, qa_json.labels(lines).collect())) == sorted(map(str, qa_json.labels(entries).collect()))


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Grüße\nzwei".encode())
    (tmp_path / "b.txt").write_bytes(b"bad \xff byte")
    got = {r["path"][-5:]: r["text"] for r in tables.read_text_contracts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "Grüße\nzwei", "b.txt": "bad � byte"}
    whole = tables.read_text_contracts(spark, str(tmp_path / "a.txt"), replace_errors=False)
    assert whole.first()["text"] == "Grüße\nzwei"


def test_folds_partition_the_rows(spark):
    ranked = splits.permuted(spark.range(11).withColumnRenamed("id", "doc_id"))
    sizes = {r["fold"]: r["n"] for r in splits.kfold(ranked, 3).groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 3, 1: 3, 2: 5}
    assert splits.tail_split(ranked).where("split = 'test'").count() == 2
    assert splits.head_split(ranked).where("split = 'test'").count() == 2
