"""The prefix trie, importance resampling and the class language model against plain versions on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import CLASHES, SCHEMA, odd_rows
from pyspark.sql import functions as F

from clausespark.llm import class_lm, conversation_trie, importance_resampling
from clausespark.llm.common import crc_mod


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- trie -----------------------------------------------------------------------------------


def conversations():
    rows = []
    for c in [*range(0, 12), 100, 101, 105, 107, 199, 205, 207, -3, -100, -101]:
        for t in range(c % 7 + (c % 100 == 0) * 5):
            rows.append((c, t, ["user", "assistant"][t % 2], f"says {t % 3} {c % 2 if t > 2 else ''}"))
    rows += [(300, t, "user", "long") for t in range(60)] + [(301 + k, t, "user", "long") for k in range(4) for t in range(55 + k)]
    rows += [(400, None, None, None), (400, 1, "user", ""), (400, 1, "user", "tie"), (400, 1, "a", "tie"), (401, 0, "user", "é€😀" * 50)]
    rows += [(401, 0, "user", "é€😀" * 50), (None, 0, "user", "nobody"), (2**40, 0, "x" * 2_000, "far"), (502, 0, "u", "v"), (503, 0, "u", "v")]
    return rows


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        paths[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("ids", [1_024, 2])
def test_conversation_trie(spark, monkeypatch, ids):
    monkeypatch.setattr(conversation_trie, "IDS", ids)
    rows = conversations()
    names = "conv_id long, turn long, role string, text string, at int, id string, n long, depth long, block string, c1 long, b1 int, slice int"
    table = spark.createDataFrame([(*r, 1, "i", 2, 3, "b", 4, 5, 6) for r in rows], names).repartition(5)
    got = conversation_trie.conversation_trie(table)
    assert Counter(map(tuple, got.collect())) == Counter(plain_trie(rows))


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got = conversation_trie.conversation_trie(table).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, 0, 0, 1, 0, hashlib.sha256().hexdigest())]


def test_running_values_spread_a_key_over_slices(spark):
    rows = [(k % 3 * 5, i, i * 7 % 11) for k in range(3) for i in range(200)] + [(1, 0, 4)]
    table = spark.createDataFrame(rows, "key long, i long, v long").withColumn("w", F.col("v") + 1)
    got = conversation_trie.before(table, "key", [F.col("i")], sums=["v"], xors=["w"]).collect()
    own = defaultdict(list)
    for key, i, v in sorted(rows):
        own[key].append((i, v))
    for r in got:
        earlier = [v for i, v in own[r["key"]] if i < r["i"]]
        assert r["before_v"] == sum(earlier)
        assert r["before_w"] == int(np.bitwise_xor.reduce([v + 1 for v in earlier])) if earlier else r["before_w"] == 0
    assert len(got) == len(rows)


# ---- resampling -----------------------------------------------------------------------------


def features(text, longest):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).encode())
    return words, [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resampling(rows, target, percent, least, buckets, longest, seed):
    crc = lambda f: zlib.crc32(f) % buckets
    source, wanted = Counter(), Counter()
    for r in rows:
        source.update(map(crc, features(r[1], longest)[1]))
    for t in target:
        wanted.update(map(crc, features(t, longest)[1]))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out = []
    for r in rows:
        words, own = features(r[1], longest)
        weight = sum(gain(crc(f)) for f in own) // len(own) if own else 0
        score = None
        if r[0] is not None:
            h = int(hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([r[0], len(words), len(own), weight, score, None])
    able = sorted((x for x in out if x[0] is not None and x[1] >= least), key=lambda x: (-x[4], x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[5] = k + 1
    return out


@pytest.mark.parametrize(("percent", "longest", "parts"), [(10, 1, 16), (60, 2, 2), (100, 1, 3), (1, 1, 16)])
def test_resampling(spark, odd, monkeypatch, percent, longest, parts):
    monkeypatch.setattr(importance_resampling, "PARTS", parts)
    target = ["same line and more", None, odd_rows()[8][1]]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_resampling.resample(odd, items, percent, 3, 97, longest, seed=5).collect()
    want = plain_resampling(odd_rows(), target, percent, 3, 97, longest, 5)
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_resampling_of_nothing(spark, odd, no_documents):
    none = spark.createDataFrame([], "text string")
    assert importance_resampling.resample(no_documents, none).count() == 0
    got = importance_resampling.resample(odd, none, 50, 1, 10, 1).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, plain_resampling(odd_rows(), [], 50, 1, 10, 1, 2024)))


# ---- class language model -------------------------------------------------------------------


def xlogx(x):
    return x * math.log(x) if x > 0 else 0.0


class PlainModel:
    """The same model by dictionaries, word by word."""

    def __init__(self, texts, table, exchange, classes, rounds, parts):
        self.k, self.texts = classes, texts
        self.count = Counter(w for t in texts for w in t)
        able = sorted((w for w in self.count if len(w) <= class_lm.WORD_BYTES), key=lambda w: (-self.count[w], w))
        while len(able) > table:  # all words of a count or none
            able = [w for w in able if self.count[w] > self.count[able[-1]]]
        self.order = [None, *able]
        self.count[None] = len(texts)
        self.pairs_of_words = Counter()
        for t in texts:
            self.pairs_of_words.update(zip([None, *t], [*t, None]))
        own = {w: i for i, w in enumerate(self.order[:exchange])}
        self.cls = {w: i for w, i in own.items() if i < classes}
        self.inside = Counter({(a, b): n for (a, b), n in self.pairs_of_words.items() if a in own and b in own})
        met = {w for pair in self.inside for w in pair}
        if len(own) > classes:
            self.move([w for w in own if own[w] >= classes and w in met], self.inside, self.class_pairs(self.inside))
        table_now = self.class_pairs(self.inside)
        for _ in range(rounds):
            before = self.value(table_now)
            for part in range(parts):
                kept = dict(self.cls)
                self.move([w for w, i in own.items() if i and w in met and i * 2_654_435_761 % 2**32 % parts == part], self.inside, table_now)
                tried = self.class_pairs(self.inside)
                if self.value(tried) > self.value(table_now):
                    table_now = tried
                else:
                    self.cls = kept
            if self.value(table_now) <= before:
                break
        for rest in ([w for w in self.order if w not in self.cls], None):
            words = rest if rest is not None else [w for w in self.count if w not in self.cls]
            self.move(words, self.pairs_of_words, table_now)

    def class_pairs(self, pairs):
        out = np.zeros((self.k, self.k))
        for (a, b), n in pairs.items():
            if a in self.cls and b in self.cls:
                out[self.cls[a], self.cls[b]] += n
        return out

    def value(self, t):
        return sum(map(xlogx, t.ravel())) - sum(map(xlogx, t.sum(axis=0))) - sum(map(xlogx, t.sum(axis=1)))

    def move(self, words, pairs, t):
        left, right = defaultdict(Counter), defaultdict(Counter)
        for (a, b), n in pairs.items():
            if b in self.cls:
                right[a][self.cls[b]] += n
            if a in self.cls:
                left[b][self.cls[a]] += n
        chosen = {}
        for w in words:
            best = []
            for b in range(self.k):
                home = self.cls.get(w) == b
                gain = 0.0
                for counts, beside in ((left[w], t.T), (right[w], t)):
                    for c, n in counts.items():
                        x = beside[b, c]
                        gain += xlogx(x) - xlogx(max(x - n, 0)) if home else xlogx(x + n) - xlogx(x)
                    s, n = beside[b].sum(), sum(counts.values())
                    gain -= xlogx(s) - xlogx(max(s - n, 0)) if home else xlogx(s + n) - xlogx(s)
                best.append(gain if b else -math.inf)
            chosen[w] = int(np.round(best, 6).argmax())
        self.cls.update(chosen)

    def score(self, text):
        pairs, once, types = self.class_pairs(self.pairs_of_words), Counter(), Counter()
        for (a, b), n in self.pairs_of_words.items():
            once[self.cls[a]] += n * (self.count[b] == 1)
        types.update(self.cls[w] for w in self.count if self.count[w])
        tokens = pairs.sum(axis=0)
        n_all, v = sum(self.count.values()), sum(n > 0 for n in self.count.values())
        share = (sum(n == 1 for n in self.count.values()) + 0.5) / (n_all + 1) if n_all else 1.0
        total, base, known, before = 0.0, 0.0, 0, 0
        for w in [*text, None]:
            n = self.count.get(w, 0)
            base += math.log10((n + 0.5) / (n_all + 0.5 * (v + 1)))
            known += n > 0
            new = share if before is None else (once[before] + class_lm.UNKNOWN_ADDED * share) / (pairs[before].sum() + class_lm.UNKNOWN_ADDED)
            if not n:
                total, before = total + math.log10(new), None
                continue
            c = self.cls[w]
            usual = tokens[c] / tokens.sum()
            follows = usual if before is None else (pairs[before, c] + class_lm.CLASS_ADDED * usual) / (pairs[before].sum() + class_lm.CLASS_ADDED)
            total += math.log10((1 - new) * follows * (n + class_lm.WORD_ADDED) / (tokens[c] + class_lm.WORD_ADDED * types[c]))
            before = c
        return len(text) + 1, known, n_all, base, total


SIZES = {"table": 60, "exchange": 25, "classes": 5, "rounds": 3, "parts": 2}


def test_class_lm_is_the_plain_model(odd):
    rows = odd_rows()
    words = [re.findall(rb"[^\x20\x09-\x0D]+", lower(r[1]).encode()) for r in rows]
    train = [i for i, r in enumerate(rows) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1]
    plain = PlainModel([words[i] for i in train], **SIZES)
    want = sorted((str(r[0]), *plain.score(w)) for r, w in zip(rows, words))
    got = class_lm.score(odd, crc_mod("doc_id", 5) != 1, crc_mod("doc_id", 5) == 1, **SIZES).collect()
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got)
    assert [x[:4] for x in found] == [x[:4] for x in want]
    for a, b in zip(found, want):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    held = {r["doc_id"]: r["held_out"] for r in got}
    assert all(h == (None if i is None else zlib.crc32(str(i).encode()) % 5 == 1) for i, h in held.items())


def test_class_lm_without_training(odd, no_documents, spark):
    got = class_lm.score(odd, F.lit(False), F.lit(True), **SIZES).collect()
    assert len(got) == len(odd_rows()) and all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in got)
    assert class_lm.score(no_documents, F.lit(True), F.lit(False), **SIZES).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA)
    assert all(r["n_tokens"] == 1 and r["score"] <= 0 for r in class_lm.score(blank, F.lit(True), F.lit(False), **SIZES).collect())


def test_probabilities_add_up_to_one():
    draw = np.random.default_rng(1)
    pairs = draw.integers(0, 30, (4, 4)).astype(float)
    model = class_lm.probabilities(pairs, draw.integers(0, 5, 4), np.array([1.0, 5, 6, 7]), class_lm.Totals(int(pairs.sum()), 19, 6))
    assert (10**model.transitions).sum(axis=1) == pytest.approx(np.ones(5))


def test_helper_names_clash_with_nothing(spark):
    """Columns with the names used inside come back as they were."""
    from clausespark.llm import decontamination, line_dedup, minhash_dedup

    names = ["_cut", "_key", "_doc_id", "_lines", "_text_key", "_n_lines", "_n_removed", "_rep", "rep", "cut", "lines", "d", "k", "w", "h", "f", "hash0"]
    rows = [(i, f"shared line of all\nown words {i} and more of them here\nlast", f"s{i}", *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = line_dedup.dedup_lines(docs, min_sites=8)
    assert got.columns == [*docs.columns, "__n_lines", "__n_removed"]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got.collect() for n in names)
    assert sum(r["__n_removed"] > 0 for r in got.collect()) == 11
    assert minhash_dedup.near_duplicates(docs).count() == 12
    items = spark.createDataFrame([(1, "own words 3 and more of them here")], "item_id long, text string")
    windows = decontamination.BenchmarkWindows(items)
    left = decontamination.without_hits(docs, windows)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [r for r in sorted(rows) if r[0] != 3]
    assert CLASHES
