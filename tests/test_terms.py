"""Vocabulary, TF-IDF, chi-square and naive Bayes against brute force."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausespark.functions import terms as N
from clausespark.operators import blocks, linear
from clausespark.operators import vocabulary as V

DOCS = {0: "alpha beta beta gamma", 1: "alpha beta delta", 2: "alpha alpha epsilon beta gamma", 3: "", 4: "beta x"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id long, text string")


def tokens(text):
    return re.findall(r"(?u)\b\w\w+\b", text.lower())


def char_grams(text, lo, hi):
    grams = []
    for word in text.lower().split():
        w = f" {word} "
        for n in range(lo, hi + 1):
            offset = 0
            grams.append(w[:n])
            while offset + n < len(w):
                offset += 1
                grams.append(w[offset:offset + n])
            if offset == 0:
                break
    return Counter(grams)


def test_char_grams_count_short_words_once(spark):
    text = "a ab abc abcd abcde abcdefgh a"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = {r["term"]: r["tf"] for r in V.count_terms(df, V.CHARACTERS_20K).collect()}
    assert got == dict(char_grams(text, 4, 6))


def test_word_ngrams(spark):
    df = spark.createDataFrame([("one two three",), ("one",), ("",)], "t string")
    got = [r[0] for r in df.select(N.word_ngrams(N.word_tokens(F.col("t")), 1, 3)).collect()]
    assert got == [["one", "two", "three", "one two", "two three", "one two three"], ["one"], []]


def test_vocabulary_and_tfidf(docs):
    spec = V.TermSpec(hi=1, min_df=2, max_df=0.95, max_features=3)
    vocabulary = V.fit(docs, spec)
    got = {r["term"]: r for r in vocabulary.collect()}
    n, df, cf = len(DOCS), Counter(), Counter()
    for text in DOCS.values():
        df.update(set(tokens(text)))
        cf.update(tokens(text))
    kept = sorted((t for t in df if 2 <= df[t] <= 0.95 * n), key=lambda t: (-cf[t], t))[:3]
    assert set(got) == set(kept)
    assert [got[t]["term_id"] for t in sorted(kept)] == [0, 1, 2]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
    weights = {(r["doc_id"], r["term"]): r["weight"] for r in V.transform(docs, vocabulary, spec).collect()}
    for doc, text in DOCS.items():
        raw = {t: (1 + math.log(c)) * idf[t] for t, c in Counter(tokens(text)).items() if t in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t, value in raw.items():
            assert weights.pop((doc, t)) == pytest.approx(value / norm)
    assert not weights


def test_vectors_cover_every_document(docs):
    spec = V.TermSpec(hi=1, max_features=10)
    rows = V.to_vectors(V.transform(docs, V.fit(docs, spec), spec), docs, 10).collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        norm = r["features"].norm(2)
        assert norm == pytest.approx(1.0) or norm == 0.0


def test_section_vocabularies_stay_apart(docs, spark):
    sections = blocks.section_rows(docs, 2)
    spec = V.TermSpec(hi=1, min_df=1, max_df=1.0, max_features=2, keys=("section",))
    assert {r["section"]: r["n"] for r in V.fit(sections, spec).groupBy("section").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 2}


LABELS = {0: 1, 1: 0, 2: 1, 3: 0, 4: 0}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, "c", y) for d, y in LABELS.items()], "doc_id long, clause string, y int")


def test_chi2(docs, labels):
    counts = V.count_terms(linear.with_labels(docs, labels, ["c"]), V.TermSpec(hi=1), carry=linear.mask_names(1))
    sums = linear.term_sums(counts, 1)
    shares = labels.groupBy("clause").agg(F.avg("y").alias("share"))
    got = {r["term"]: r["chi2"] for r in blocks.chi2(sums, shares, ["c"]).collect()}
    total, pos = Counter(), Counter()
    for d, text in DOCS.items():
        total.update(tokens(text))
        if LABELS[d]:
            pos.update(tokens(text))
    share = 0.4
    for t in total:
        e1, e0 = share * total[t], (1 - share) * total[t]
        want = (pos[t] - e1) ** 2 / e1 + (total[t] - pos[t] - e0) ** 2 / e0
        assert got[t] == pytest.approx(want)


@pytest.mark.parametrize("kind", ["multinomial", "complement"])
def test_naive_bayes(docs, labels, kind):
    spec = V.TermSpec(hi=1)
    counts = V.count_terms(linear.with_labels(docs, labels, ["c"]), spec, carry=linear.mask_names(1))
    sums = linear.term_sums(counts, 1)
    model = {"multinomial": linear.multinomial_nb, "complement": linear.complement_nb}[kind](sums, labels, ["c"])
    got = {r["doc_id"]: r["prob"] for r in linear.score_counts(docs, model, spec).collect()}
    vocab = sorted({t for text in DOCS.values() for t in tokens(text)})
    rate = sum(LABELS.values()) / len(LABELS)
    count = {c: Counter() for c in (0, 1)}
    for d, text in DOCS.items():
        weight = 1.0 if kind == "multinomial" else (1 - rate if LABELS[d] else rate)
        for t, k in Counter(tokens(text)).items():
            count[LABELS[d]][t] += k * weight
    table, prior = {}, {}
    for c in (0, 1):
        source = count[c] if kind == "multinomial" else count[1 - c]
        mass = sum(source[t] + 0.5 for t in vocab)
        logs = {t: math.log((source[t] + 0.5) / mass) for t in vocab}
        if kind == "complement":
            whole = sum(logs.values())
            logs = {t: v / whole for t, v in logs.items()}
        table[c] = logs
        prior[c] = math.log(rate if c else 1 - rate) if kind == "multinomial" else 0.0
    for d, text in DOCS.items():
        joint = {c: prior[c] + sum(table[c][t] for t in tokens(text)) for c in (0, 1)}
        want = math.exp(joint[1]) / (math.exp(joint[0]) + math.exp(joint[1]))
        assert got[d] == pytest.approx(want), (d, got)


def test_pooled_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 4.0]), (1, [3.0, 2.0]), (2, [0.0, 1.0])], "g int, embedding array<float>")
    mean = {(r["g"], r["dim"]): r["value"] for r in blocks.pool_vectors(df, "g").collect()}
    assert mean[(1, 0)] == 2.0 and mean[(1, 1)] == 3.0
    assert {r["g"]: r["pooled"] for r in blocks.pooled_array(df, "g", 2, how="max").collect()}[1] == [3.0, 4.0]


def test_label_numbers_hold_many_clauses(spark):
    """More clauses than fit in one number; each keeps its own positives."""
    names = [f"c{i}" for i in range(130)]
    docs = spark.createDataFrame([(d, f"aa{d} bb") for d in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(d, c, int((i + d) % 3 == 0)) for d in range(4) for i, c in enumerate(names)], "doc_id long, clause string, y int"
    )
    rows = V.count_terms(linear.with_labels(docs, labels, names), V.TermSpec(hi=1), carry=linear.mask_names(130))
    got = {r["term"]: r for r in linear.term_sums(rows, 130).collect()}
    for i in range(130):
        assert got["bb"][f"p{i}"] == sum((i + d) % 3 == 0 for d in range(4))
        assert got["aa2"][f"p{i}"] == int((i + 2) % 3 == 0)
