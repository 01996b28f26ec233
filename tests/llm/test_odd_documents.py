"""Every operator on documents with nulls, extremes, ties and repeated rows, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from conftest_llm import ids, odd_rows
from pyspark.sql import functions as F

from clausespark.llm import decontamination, language_id, line_dedup, minhash_dedup, packing, substring_dedup, token_counts, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_token_counts_are_those_of_the_library(odd, no_documents):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in odd_rows())
    got = token_counts.token_counts(odd, MODEL, 4096).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_counts.token_counts(no_documents, MODEL, 4096).count() == 0


def test_substring_dedup(odd, no_documents):
    windows = defaultdict(lambda: 2**63)
    rows = odd_rows()
    number = lambda r: 2**63 - 1 if r[0] is None else r[0]
    for r in rows:
        w = split(r[1])
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])] = min(number(r), windows[tuple(w[i : i + 50])])
    want = []
    for r in rows:
        w = split(r[1])
        gone = {i + k for i in range(len(w) - 49) if windows[tuple(w[i : i + 50])] < number(r) for k in range(50)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.dedup(odd, 50).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert substring_dedup.dedup(no_documents, 50).count() == 0


def test_crowded_minimisers_give_the_same_rows(odd, monkeypatch):
    want = Counter(map(tuple, substring_dedup.dedup(odd, 50).collect()))
    monkeypatch.setattr(substring_dedup, "CROWDED", 1)
    assert Counter(map(tuple, substring_dedup.dedup(odd, 50).collect())) == want


def test_minhash_dedup(odd, no_documents):
    rows = odd_rows()
    sets = []
    for r in rows:
        w = split(lower(r[1]))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()})
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 85 * len(a | b):
                part = [part[j] if p == part[i] else p for p in part]
    least = defaultdict(lambda: 2**63)
    for r, p in zip(rows, part):
        if r[0] is not None:
            least[p] = min(least[p], r[0])
    want = [(r[0], len(s), None if r[0] is None else least[p], r[0] is None or r[0] == least[p]) for r, s, p in zip(rows, sets, part)]
    got = minhash_dedup.near_duplicates(odd, 3, (85, 100)).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert minhash_dedup.near_duplicates(no_documents, 3, (85, 100)).count() == 0


def test_line_dedup(odd, no_documents):
    rows = [r for r in odd_rows()]
    got = line_dedup.dedup_lines(odd, min_sites=8)
    assert got.columns == odd.columns + ["_n_lines", "_n_removed"]
    first = min(r[0] for r in rows if r[0] is not None and "same line" in (r[1] or "").split("\n"))
    want = []
    for r in rows:
        lines = r[1].split("\n") if r[1] is not None else []
        kept = [x for i, x in enumerate(lines) if x != "same line" or (r[0] == first and i == 0)]
        want.append((r[0], None if r[1] is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert Counter(map(tuple, got.select("doc_id", "text", "_n_lines", "_n_removed").collect())) == Counter(want)
    assert line_dedup.dedup_lines(no_documents).count() == 0


def test_decontamination(spark, odd, no_documents):
    rows = odd_rows()
    items = [(1, " ".join(split(rows[8][1])[20:45])), (2, "Two words"), (10, "two, WORDS!"), (3, None), (4, "..."), (None, "one"), (5, "absent in all of them"), (1, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else ():
            known[tuple(w[k : k + n])].add(str(i))
    want = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(w) - n + 1):
                if names := known.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((r[0], len(w), len(hit), len(found), digest, bool(hit)))
    for limit in (250_000, 60):
        windows = decontamination.BenchmarkWindows(bench, 10, part=limit)
        got = decontamination.contamination(odd, windows).drop("spans")
        assert Counter(map(tuple, got.collect())) == Counter(want)
        clean = Counter(w[0] for w in want if not w[5])
        left = decontamination.without_hits(odd, windows)
        assert left.columns == odd.columns and Counter(r[0] for r in left.select("doc_id").collect()) == clean
    nothing = decontamination.BenchmarkWindows(bench.limit(0), 10)
    assert decontamination.contamination(odd, nothing).filter("contaminated").count() == 0
    assert decontamination.contamination(no_documents, windows).count() == 0


def test_spans_are_cut(spark):
    rows = [(1, "Alpha beta, gamma! delta"), (2, "Nothing Here"), (3, None), (4, ""), (5, "beta gamma beta gamma"), (1, "Alpha beta, gamma! delta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "beta gamma"), (2, "gamma beta")], "item_id long, text string")
    want = Counter([(1, "alpha delta"), (2, "Nothing Here"), (3, None), (4, ""), (5, ""), (1, "alpha delta")])
    for limit in (250_000, 1):  # one hash table, and one per window
        got = decontamination.without_spans(docs, decontamination.BenchmarkWindows(bench, part=limit))
        assert Counter(map(tuple, got.collect())) == want
    nothing = decontamination.BenchmarkWindows(bench.limit(0))
    assert Counter(map(tuple, decontamination.without_spans(docs, nothing).collect())) == Counter(rows)


def test_packing(odd, no_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTES[0])
    got = packing.pack(packing.pieces(odd, *BYTES, size=64, end_id=2), size=64).collect()
    want = Counter()
    for r in odd_rows():
        encoded = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        first = len(encoded) % 64 or 64
        edges = [0, *range(first, len(encoded) + 1, 64)]
        for k, (a, z) in enumerate(zip(edges, edges[1:])):
            want[r[0], k, a, z - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in encoded[a:z]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= sum(r["length"] for r in got) / 64 + 2
    assert packing.pack(packing.pieces(no_documents, *BYTES, size=64, end_id=2), size=64).count() == 0


def test_more_slices_pack_the_same_pieces(odd, monkeypatch):
    def sequences():
        got = packing.pack(packing.pieces(odd, *BYTES, size=64, end_id=2), size=64).collect()
        filled = defaultdict(list)
        for r in got:
            filled[r["sequence_id"]].append((r["offset"], r["length"]))
        return Counter(tuple(r)[:5] for r in got), Counter(tuple(sorted(x)) for x in filled.values())

    usual = sequences()
    monkeypatch.setattr(packing, "SLICES", 1)
    assert sequences() == usual
    monkeypatch.setattr(packing, "SLICE_ROWS", 1)
    assert sequences() == usual


def test_two_for_the_smallest():
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    assert plan[0] == ([6, 2, 2], 1) and sum(t for _, t in plan) == 2
    assert packing.best_two_fit({7: 5, 3: 5}, 10) == [([7, 3], 5)]
    assert packing.best_two_fit({}, 10) == []


def test_language_id(odd, no_documents):
    model = language_id.fit(odd, F.lit(True), buckets=4096)
    assert model[0] == ["de", "en"]
    got = language_id.predict(odd, model).collect()
    assert ids(got) == ids(odd_rows())
    by_id = {r["doc_id"]: r for r in got}
    for doc_id in (0, 3, 6, 21):
        assert by_id[doc_id]["lang_pred"] == "und" and by_id[doc_id]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)
    empty = language_id.fit(no_documents, F.lit(True), buckets=64)
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(no_documents, model).count() == 0


def test_language_counts_are_those_of_plain_counting(spark):
    docs = spark.createDataFrame([(1, "Ab, ab", "x"), (2, "ba", "y")], "doc_id long, text string, lang string")
    names, prior, matrix = language_id.fit(docs, F.lit(True), buckets=1 << 14, sizes=(2,))
    bucket = lambda s: int(language_id.grams(language_id.folded(s)[1:-1], (2,), 1 << 14)[0])
    total = {"x": 6, "y": 3}  # " a", "ab", "b " twice each; " b", "ba", "a "
    for name, gram, n in (("x", "ab", 2), ("x", "ba", 0), ("y", "ba", 1)):
        want = (n + 1) / (total[name] + (1 << 14))
        assert abs(float(matrix[bucket(gram), names.index(name)]) - __import__("math").log(want)) < 1e-5


def test_toxicity(spark, odd, no_documents):
    draw = odd_rows()
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    got = toxicity.score(odd, model).collect()
    assert ids(got) == ids(draw) and {r["score"] for r in got} == {0.0}
    assert toxicity.score(no_documents, model).count() == 0
    kept = toxicity.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(draw)


def test_toxicity_learns_sentences_from_document_labels(spark):
    from conftest_llm import phrase

    rows = [(k, f"{phrase(k, 12)}. {phrase(k + 999, 9)}{' zorgblat' * (k % 5 == 0)}. {phrase(k + 1999, 12)}.") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs, labels, F.col("doc_id") % 2 == 0)
    got = toxicity.score(docs, model).filter("doc_id % 2 = 1").collect()
    right = [r["predicted"] == (r["doc_id"] % 5 == 0) for r in got]
    assert sum(right) / len(right) > 0.98
    texts = dict(rows)
    for r in got:
        assert all("zorgblat" in texts[r["doc_id"]][o["start"] : o["end"]] for o in r["offending"] if r["predicted"])


def test_large_bands_give_the_same_components(spark, monkeypatch):
    import random

    from conftest_llm import phrase

    draw, base, rows = random.Random(5), phrase(77, 90).split(), []
    for k in range(60):
        w = list(base)
        for _ in range(draw.randint(0, 5)):
            w[draw.randrange(len(w))] = f"edit{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for _, t in rows for w in [t.split()]]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 85 * len(a | b):
                part = [part[j] if p == part[i] else p for p in part]
    want = {(k, min(j for j, q in enumerate(part) if q == p)) for k, p in enumerate(part)}
    for few, block in ((32, 1_000), (1, 7), (1, 1_000)):
        monkeypatch.setattr(minhash_dedup, "FEW", few)
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        got = minhash_dedup.near_duplicates(docs, 3, (85, 100)).collect()
        assert {(r["doc_id"], r["component_id"]) for r in got} == want
