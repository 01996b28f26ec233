"""Text features against brute force in plain Python on a small fixture."""

import re

import pytest
from pyspark.sql import functions as F

from clausespark.fixed import patterns as P
from clausespark.functions import text as X

LONG = " ".join(f"w{i}" for i in range(601))
TEXTS = [
    "",
    "word",
    "nowhitespaceatall",
    " ".join(f"w{i}" for i in range(400)),
    " ".join(f"w{i}" for i in range(401)),
    LONG,
    "Café naïve résumé: no éno noé, NO less than five; no cap on liability. Indemnifies the buyer",
    "\n1. Scope. The Vendor shall not exceed $5,000 or 20 % of 300 dollars.\n 2. Term\n",
    "\nGOVERNING TERMS\nThis is governed by the laws. ARTICLE IV (a) (ii) (12) percent\nDEFINITIONS.\n",
    "no later than within 30 business days, within ten months; up to 12, at least 3",
    "Change of control. " + "x " * 200 + "liquidated   damages apply\n\n here " + "y " * 200,
    'Ends with "Defined Term" and NON-COMPETE',
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(2).cache()


def values(docs, columns):
    return {r["id"]: r.asDict() for r in docs.select("id", *columns).collect()}


def test_syntax_rates(docs):
    got = values(docs, X.syntax_rates(F.col("text")) + X.structure_rates(F.col("text")))
    extra = {"sentence_count_per_k": (P.SENTENCE_END, 0), "numbered_clause_count_k": (P.ENUMERATOR, re.I),
             "dollar_mentions_k": (P.DOLLAR_AMOUNT, re.I), "percent_mentions_k": (P.PERCENT, re.I)}
    for i, text in enumerate(TEXTS):
        per_k = max(1, len(text)) / 1000
        for name, pattern in P.SYNTAX_PATTERNS.items():
            assert got[i][name] == pytest.approx(len(re.findall(pattern, text, re.I)) / per_k), (i, name)
        for name, (pattern, flags) in extra.items():
            assert got[i][name] == pytest.approx(len(re.findall(pattern, text, flags)) / per_k), (i, name)
        assert got[i]["section_count"] == len(re.findall(P.SECTION_HEADER, text))


def test_basic_features(docs):
    got = values(docs, X.basic_features(F.col("text")))
    for i, text in enumerate(TEXTS):
        assert got[i]["char_count"] == len(text)
        assert got[i]["word_count"] == len(text.split())
        assert got[i]["sentence_count"] == len(re.split(P.SENTENCE_SPLIT, text))
        assert got[i]["section_count"] == len(re.findall(P.NUMBERED_SECTION, text))
        assert got[i]["n_will_not_mentions"] == text.lower().count("will not") + text.lower().count("shall not")
        assert got[i]["has_liability_kw"] == int("liabilit" in text.lower())


def test_enhanced_and_unfair_features(docs):
    enhanced = values(docs, X.enhanced_features(F.col("text")))
    unfair = values(docs, X.unfair_terms_features(F.col("text")))
    for i, text in enumerate(TEXTS):
        low = text.lower()
        for name, kind, value in P.ENHANCED_FEATURES:
            want = {
                "count": lambda: len(re.findall(value, text)),
                "icount": lambda: len(re.findall(value, text, re.I)),
                "iflag": lambda: int(bool(re.search(value, text, re.I))),
                "lcount": lambda: len(re.findall(value, low)),
                "lflag": lambda: int(bool(re.search(value, low))),
                "literal": lambda: low.count(value),
            }[kind]()
            assert enhanced[i][name] == want, (i, name)
        for name, rule in P.UNFAIR_FLAGS.items():
            want = bool(re.search(rule["regex"], low)) if "regex" in rule else any(p in low for p in rule["any_of"])
            assert unfair[i][name] == int(want), (i, name)
        words = text.split()
        assert unfair[i]["avg_word_len"] == pytest.approx(sum(map(len, words)) / len(words) if words else 0)
        assert unfair[i]["legal_signal_count"] == sum(unfair[i][f] for f in P.LEGAL_SIGNAL_FLAGS)


def test_sections_windows_chunks(docs):
    text = F.col("text")
    got = values(docs, [X.sections(text).alias("s"), X.word_windows(text).alias("w"), X.word_chunks(text).alias("c"),
                        X.truncate_words(text, 400).alias("t")])
    for i, value in enumerate(TEXTS):
        edges = [int(round(len(value) * k / 4)) for k in range(5)]
        assert got[i]["s"] == [value[edges[k]:edges[k + 1]] for k in range(4)]
        words = value.split()
        windows, start = [], 0
        if len(words) <= 400:
            windows = [value]
        else:
            while start < len(words):
                end = min(start + 400, len(words))
                windows.append(" ".join(words[start:end]))
                if end == len(words):
                    break
                start += 200
        assert got[i]["w"] == windows
        assert got[i]["c"] == ([" ".join(words[k:k + 400]) for k in range(0, len(words), 400)] or [value[:1000]])
        assert got[i]["t"] == (value if len(words) <= 400 else " ".join(words[:400]) + " [... contract continues ...]")


def test_snippets(docs):
    for pattern in P.HIGHLIGHT_PATTERNS.values():
        got = values(docs, [X.snippet(F.col("text"), pattern).alias("s")])
        for i, text in enumerate(TEXTS):
            m = re.search(pattern, text, re.I)
            want = None
            if m:
                a, b = max(0, m.start() - 180), min(len(text), m.end() + 180)
                want = re.sub(r"\s+", " ", text[a:b]).strip()
                want = ("… " if a > 0 else "") + want + (" …" if b < len(text) else "")
            assert got[i]["s"] == want


def test_highlight_positions_and_accents(spark, docs):
    text = F.col("text")
    got = values(docs, [X.highlight(text, ["no", "a.b"]).alias("h"), X.terms_present(text, ["Café", "zzz"]).alias("p"),
                        X.first_term_position(text, F.lit("w1 w2")).alias("f"), X.strip_accents(text).alias("a"),
                        X.strip_accents_any_script(text).alias("any")])
    assert got[6]["h"].count("<mark") == len(re.findall("no", TEXTS[6], re.I))
    assert got[6]["p"] == ["Café"] and got[5]["p"] == []
    assert got[5]["f"] == pytest.approx(1 / 601) and got[0]["f"] is None
    assert got[6]["a"].startswith("Cafe naive resume") and got[6]["any"].startswith("Cafe naive resume")


def test_answers(spark):
    reply = "Sure.\nuncapped liability: Yes\nNon-Compete: NO\nNon-Compete and Liquidated Damages: yes\n"
    row = spark.createDataFrame([(reply,), ("",)], "r string")
    first = [r.asDict() for r in row.select(*[c.alias(k) for k, c in X.parse_answers(F.col("r")).items()]).collect()]
    assert first[0] == {"Uncapped Liability": 1, "Change Of Control": 0, "Non-Compete": 1, "Liquidated Damages": 0}
    assert set(first[1].values()) == {0}
    every = row.select(*[c.alias(k) for k, c in X.parse_answers(F.col("r"), False).items()]).first().asDict()
    assert every["Liquidated Damages"] == 1
