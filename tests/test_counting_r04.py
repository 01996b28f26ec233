"""Array counting of terms gives the rows of the column functions, also where ids come twice or are null."""

from pyspark.sql import functions as F

from clausespark.operators import boosting as B
from clausespark.operators import counting
from clausespark.operators import vocabulary as V

ROWS = [
    (1, "The  Quick brown fox. the quick FOX a b ab"), (2, None), (None, "the quick"), (3, ""), (4, "İstanbul ΣΑΣ ß ½½ aaaa aaaa 日本語 aaaa"),
    (1, "quick brown the quick"), (5, "fox"), (5, "fox"), (5, "fox jumps"), (6, "a   b\tlong-word under_score \x1c tab"),
]
SPECS = [
    V.TermSpec(hi=2, min_df=1, max_df=1.0, max_features=1_000),
    V.TermSpec(analyzer="char_wb", lo=3, hi=5, min_df=1, max_df=1.0, max_features=1_000, sublinear=False),
]


def entries(rows):
    return sorted((repr(r["doc_id"]), sorted((i, round(w, 9)) for i, w in zip(r["i"], r["w"]))) for r in rows.collect())


def test_packed_rows_equal_those_of_term_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for spec in SPECS:
        found = V.fit(docs, spec)
        assert entries(V.packed(docs, found, spec)) == entries(B.packed(V.transform(docs, found, spec), docs))


def test_vocabularies_side_by_side_and_labels(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    labels = docs.where("doc_id <> 6").select("doc_id", F.lit(1).alias("y0")).distinct()
    first, second = (V.fit(docs, spec) for spec in SPECS)
    parts = [V.transform(docs, v, s).select("doc_id", (F.col("term_id") + at).alias("term_id"), "weight") for s, v, at in ((SPECS[0], first, 0), (SPECS[1], second, 1_000))]
    old = B.packed(parts[0].unionByName(parts[1]), docs).join(labels, "doc_id")
    new = V.packed_spaces(docs, [(SPECS[0], first, 0), (SPECS[1], second, 1_000)], labels)
    assert new.columns == ["doc_id", "y0", "i", "w"]
    assert entries(new) == entries(old)


def test_small_pieces_count_the_same(spark):
    import pyarrow as pa

    texts = pa.array([None, "", "a b a b", "fox", "fox jumps fox", ""])

    def all_counts(parts):
        found = []
        for at, part in parts:
            row, term, tf, names = counting.counted(part, SPECS[0])
            found += [(int(r) + at, names[int(t)].as_py(), int(n)) for r, t, n in zip(row, term, tf)]
        return sorted(found)

    whole = all_counts([(0, texts)])
    assert whole == all_counts([(k, texts.slice(k, 1)) for k in range(len(texts))])
    assert (2, "a b", 2) in whole and (4, "fox", 2) in whole and len(whole) == 9
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    assert sum(b.num_rows for b in counting.cut(batch, 0)) == len(texts)
