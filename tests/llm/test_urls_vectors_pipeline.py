"""URL filters and embedding dedup against brute force, and the pipeline on odd documents."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from clausespark.llm import embedding_dedup, url_filters


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    return re.sub("[A-Z]", lambda x: x[0].lower(), host), path


def plain_judge(pages, bad_of, least=0.7, weight=10.0, many=20, share=0.05, z=3.0):
    """The documented steps on lists and dictionaries."""
    read = []
    for page, url in pages:
        host, path = parts(url)
        mask = tuple(re.sub("[0-9]+", "#", path.removeprefix("/")).split("/")) if path else ()
        number = re.search(r"(?:^|/)([0-9]{1,18})(?:[^0-9]|$)", path)
        read.append((page, host, path, mask, bad_of.get(int(number[1])) if number else None))
    template = {(h, m): "" for _, h, _, m, _ in read}
    for level in range(min(8, max((len(m) for *_, m, _ in read), default=0))):
        child, node = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0, set()])
        for _, h, _, m, bad in read:
            if len(m) > level:
                for x in (child[h, template[h, m], m[level]], node[h, template[h, m]]):
                    x[0] += 1
                    x[1] += bad is not None
                    x[2] += bad or 0
                node[h, template[h, m]][3].add(m[level])
        grown = {}
        for (h, m), t in template.items():
            if len(m) > level:
                n, labelled, bads = child[h, t, m[level]]
                all_n, all_labelled, all_bad, children = node[h, t]
                rate = (all_bad + 0.5) / (all_labelled + 1)
                similar = abs(bads - labelled * rate) < z * math.sqrt(labelled * rate * (1 - rate)) + 1e-9
                rare = len(children) > many and n < share * all_n
                kept = not rare and (len(children) == 1 or (labelled == 0 and len(children) <= many) or (labelled > 0 and not similar))
                t = f"{t}/{m[level] if kept else '*'}"
            grown[h, m] = t
        template = grown
    template = {(h, m): t + ("/**" if len(m) > 8 else "") for (h, m), t in template.items()}
    total, seen = [0, 0], defaultdict(lambda: [0, 0])
    for _, h, _, m, bad in read:
        if bad is not None:
            for x in (total, seen[h, template[h, m]]):
                x[0] += 1
                x[1] += bad
    overall = 1 - total[1] / total[0] if total[0] else 1.0
    out = []
    for page, host, path, m, _ in read:
        labelled, bads = seen[host, template[host, m]]
        purity = (labelled - bads + weight * overall) / (labelled + weight)
        rule = max(
            (r for r in url_filters.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])),
            key=lambda r: len(r[0] + r[1]),
            default=None,
        )
        verdict = rule[2] if rule else "block" if purity < least else "allow"
        out.append((page, host, path, rule[0] + rule[1] if rule else None, verdict, template[host, m]))
    return out


def test_url_filters(spark):
    draw = random.Random(3)
    pages = [(k, f"https://H{draw.randrange(2)}.net/{draw.choice(['good', 'bad', 'blog'])}/{k}/x{draw.randrange(40)}.html?q=/z") for k in range(900)]
    pages += [(1000 + k, f"http://deep.net/" + "/".join(f"s{j}" for j in range(k))) for k in range(12)]
    odd = [None, "", "no scheme", "x://", "http://ORG", "http://org/", "HTTP://a.Example.ORG/en/12", "http://example.org/es/q#f", "http://notorg/", "a://b.com/fr/1",
           "a://com/de/", "a://org:80/x", "http://sub.example.org?x=/es/", "see http://u.com/de/x?y://z", "\nhttp://n.org/\nq"]
    pages += [(2000 + k, u) for k, u in enumerate(odd)] + [(2000, None), (None, "http://org/x"), (7, pages[7][1])]
    bad = {k: int("/bad/" in pages[k][1] or k % 10 == 0) for k in range(0, 900, 2)}
    labels = [(k, 1 - b) for k, b in bad.items()] + [(1, None), (None, 0), (2, 1)]
    frame = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, template string, n int").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = [tuple(r)[:6] for r in url_filters.judge(frame, table, url_filters.RULES).collect()]
    want = plain_judge(pages, bad)
    assert Counter(got) == Counter(want)
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
    none = url_filters.judge(frame, table.limit(0), url_filters.RULES).collect()
    assert Counter(tuple(r)[:5] for r in none) == Counter(w[:5] for w in plain_judge(pages, {}))
    assert url_filters.judge(frame.limit(0), table, url_filters.RULES).count() == 0


def test_embedding_dedup(spark):
    draw = np.random.default_rng(1)
    base = draw.normal(size=(150, 8))
    near = base[:40] + 0.15 * draw.normal(size=(40, 8))
    vectors = [v.astype(np.float32).tolist() for v in [*base, *near, *near[:5], base[0] * 3]]
    vectors += [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 0.0], [2.0, 0.1], vectors[0][:4]]
    rows = [(2 * k, v) for k, v in enumerate(vectors)] + [(0, vectors[0]), (None, vectors[1])]
    links = defaultdict(set)
    good = [v is not None and i is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    for i, (_, v) in enumerate(rows):
        for j, (_, u) in enumerate(rows[:i]):
            if good[i] and good[j] and len(u) == len(v):
                a, b = np.array(u, float), np.array(v, float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9 or u == v:
                    links[i].add(j)
                    links[j].add(i)
    part = list(range(len(rows)))
    for i in links:
        for j in links[i]:
            part = [part[j] if p == part[i] else p for p in part]
    want = []
    for i, (name, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None), default=None)
        want.append((name, len(links[i]), least, name is None or name == least))
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rep int, v int")
    assert Counter(map(tuple, embedding_dedup.near_duplicates(frame).collect())) == Counter(want)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def plain_links(rows, least=0.9):
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= least, 1)))}


def scattered_pairs(pairs, seed, single=0):
    """Unstructured vectors, each of the first with a partner at a cosine of 0.9 to 0.96."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(pairs + single, 64))
    twins = base[:pairs] + draw.uniform(0.3, 0.45, size=(pairs, 1)) * draw.normal(size=(pairs, 64))
    return [(k, v.tolist()) for k, v in enumerate([*base, *twins])]


def test_embedding_search_that_stays_below_recall_ends_exact(spark, monkeypatch):
    tried = []

    def nothing_found(classes, count, cosine, probes, beam):
        tried.append(probes)
        return spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(embedding_dedup, "found_links", nothing_found)
    monkeypatch.setattr(embedding_dedup, "PER_CLUSTER", 8)
    monkeypatch.setattr(embedding_dedup, "PART", 170)
    rows = scattered_pairs(200, 5)
    links = Counter(x for pair in plain_links(rows) for x in pair)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(frame).collect()}
    assert len(links) > 300 and got == {k: links[k] for k, _ in rows}
    assert tried == sorted(tried)


def test_embedding_search_by_a_vectors_own_centroids(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_CLUSTER", 10)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 400)
    rows = scattered_pairs(1000, 6)
    classes = spark.createDataFrame(rows, "rep long, v array<double>")
    want = plain_links(rows)
    found = {tuple(r) for r in embedding_dedup.found_links(classes, len(rows), 0.9, 6, 48).collect()}
    assert len(want & found) >= 0.97 * len(want)


@pytest.mark.parametrize("case", ["few links", "hot group"])
def test_embedding_audit(spark, monkeypatch, case):
    """Lost links are seen where most vectors have none, and beside a group with most of all links."""
    draw = np.random.default_rng(8)
    rows = scattered_pairs(4, 7, single=600) if case == "few links" else scattered_pairs(150, 7)
    if case == "hot group":
        centre = draw.normal(size=64)
        rows += [(1000 + k, (centre + 0.05 * draw.normal(size=64)).tolist()) for k in range(300)]
    want = plain_links(rows)
    kept = [x for x in want if min(x) >= 1000]
    monkeypatch.setattr(embedding_dedup, "found_links", lambda *_: spark.createDataFrame(kept, "a long, b long"))
    monkeypatch.setattr(embedding_dedup, "AUDITED", 20)
    if case == "hot group":
        assert len(kept) > 0.99 * len(want)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = Counter(x for pair in want for x in pair)
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(frame).collect()} == {k: links[k] for k, _ in rows}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_documents(spark, odd, tmp_path, empty):
    docs = (odd.limit(0) if empty else odd).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "two words"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near dedup" and not empty:
            left = Counter(r[0] for r in docs.select("doc_id").collect())
            assert left[42] == 1 and left[45] == 0 and left[0] == 1 and left[None] == 2
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert (ids == set()) if empty else (12 not in ids and 42 in ids)
