"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, from document labels.

A document is a bag of sentences. A sentence has features: hashed runs of five lower-cased letters,
word edges included. Its score is a logistic one, and a document is toxic if at least one sentence
is: 1 - prod(1 - p). Training knows labels of documents only; afterwards the sentence scores say
where the offending sentences are.

The fit reads a bounded sample of labelled rows (``fit_rows``, drawn by a hash of the id). In it,
Spark counts per feature the toxic and the other documents that hold it; features that are clearly
more frequent in toxic documents are kept (``features`` at most), so what reaches the driver is
bounded by the sample: kept features per sentence. Scoring reads every whole text in one pass.

Null and empty texts get the score of a document without sentences, the share of toxic labels among
such is not learnt: it is 0.0. Without labels of both kinds every score is 0.0. Labels that are null
are left out; a document with several labels counts as toxic if one says so. Repeated rows give
repeated rows, an empty table an empty one, and only the named columns are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import per_batch, small_batches
from clausespark.llm.language_id import letters

BUCKETS = 1 << 20
RUN = 5
END = re.compile(r"[.!?]+(?=\s)|\n+")
BREAK = 1


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of the sentences of a text: cut after stops before white space and at line ends."""
    cuts = [m.end() for m in END.finditer(text)]
    edges = [0, *cuts, *([len(text)] if not cuts or cuts[-1] < len(text) else [])]
    return list(zip(edges, edges[1:]))


def sentence_features(text: str) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Distinct (sentence number, feature) pairs in order of the sentences, and the sentences' spans."""
    spans = sentence_spans(text)
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    lowered = text.lower()
    if len(lowered) != len(text):  # a few letters have two lower-case ones
        lowered = "".join(c.lower()[0] for c in text)
    lower = np.frombuffer(lowered.encode("utf-32-le", "replace"), np.uint32)
    points = np.where(letters()[points], lower, np.uint32(32))
    # each sentence between two spaces, after a mark no feature may hold
    starts = np.array([s for s, _ in spans])
    number = np.repeat(np.arange(len(spans)), np.diff(np.append(starts, len(points))))
    at = np.repeat(starts, 3)
    points = np.insert(points, at, np.tile(np.array([32, BREAK, 32], np.uint32), len(spans)))
    number = np.insert(number, at, np.repeat(np.arange(len(spans)), 3))
    points = np.append(points, np.uint32(32))
    number = np.append(number, len(spans) - 1)
    space = points == 32
    keep = ~space | np.append(True, ~space[:-1])
    points, number = points[keep], number[keep]
    n = len(points) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), spans
    value, mark = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(RUN):
        value = value * np.uint64(0x100000001B3) + points[k : k + n] * np.uint64(0x9E3779B97F4A7C15)
        mark |= points[k : k + n] == BREAK
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    feature = (value >> np.uint64(44)).astype(np.int64)
    return number[:n][~mark], feature[~mark], spans


def labelled(labels: DataFrame, train: Column, fit_rows: int, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """At most about ``fit_rows`` labelled rows of training documents, drawn by a hash of their id."""
    rows = labels.filter(train & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max((F.col(toxic) == 1).cast("int")).alias("toxic"))
    share = min(1.0, 0.95 * fit_rows / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, fit_rows: int = 20_000, features: int = 4_096, doc_id: str = "doc_id", text: str = "text"
) -> tuple[np.ndarray, float]:
    """A weight per bucket and the bias of the sentence score."""
    sample = labelled(labels, train, fit_rows)
    bags = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")

    def present():
        def run(batch):
            names, toxic = [], []
            for value, y in zip(batch.column(0), batch.column(1).to_pylist()):
                found = np.unique(sentence_features(str(value))[1]) if value.is_valid else np.zeros(0, np.int64)
                names.append(np.append(found, -1))
                toxic.append(np.full(len(found) + 1, y))
            key, back = np.unique(np.concatenate(names), return_inverse=True)
            y = np.concatenate(toxic)
            return {"feature": key, "toxic": np.bincount(back, weights=y).astype(np.int64), "docs": np.bincount(back)}

        return run

    counts = per_batch(bags.select("text", "toxic"), present, "feature long, toxic long, docs long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    whole = counts.filter("feature = -1").first()
    weights = np.zeros(BUCKETS, np.float32)
    if not whole or not 0 < whole["toxic"] < whole["docs"]:
        return weights, -math.inf
    base = whole["toxic"] / whole["docs"]
    # binomial z of the share of toxic documents among those with the feature
    z = (F.col("toxic") - F.col("docs") * base) / F.sqrt(F.col("docs") * base * (1 - base))
    telling = counts.filter("feature >= 0").withColumn("z", z).filter("z > 4 and toxic >= 3 and 2 * toxic >= docs")
    chosen = np.array(sorted(r["feature"] for r in telling.orderBy(F.desc("z"), "feature").limit(features).collect()), np.int64)

    def instances():
        def run(batch):
            toxic, sizes, kept = batch.column(1).to_pylist(), [], []
            for value in batch.column(0):
                number, feature, _ = sentence_features(str(value)) if value.is_valid else (np.zeros(0, np.int64),) * 2 + ([],)
                where = np.searchsorted(chosen, feature)
                hit = where < len(chosen)
                hit[hit] = chosen[where[hit]] == feature[hit]
                pairs = np.unique(number[hit] * len(chosen) + where[hit]) if hit.any() else np.zeros(0, np.int64)
                sizes.append(int(number[-1]) + 1 if len(number) else 0)
                kept.append(pairs)
            return {"toxic": toxic, "sentences": sizes, "pairs": kept}

        return run

    table = per_batch(bags.select("text", "toxic"), instances, "toxic int, sentences int, pairs array<long>").toArrow()
    learnt, bias = train_noisy_or(
        table["toxic"].to_numpy(), [np.asarray(x, np.int64) for x in table["pairs"].to_pylist()], table["sentences"].to_numpy(), len(chosen)
    )
    weights[chosen] = learnt
    return weights, bias


def train_noisy_or(
    toxic: np.ndarray, pairs: list[np.ndarray], sentences: np.ndarray, features: int, steps: int = 500, decay: float = 2e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias that fit the labels of bags; ``pairs`` are sentence * features + feature per bag.

    Sentences without a kept feature all share one score, so they are counted, not stored. Full
    gradients with per-weight step sizes.
    """
    sentence_of, feature_of, bag_of, base = [], [], [], 0
    for k, x in enumerate(pairs):
        if len(x):
            number, back = np.unique(x // features, return_inverse=True)
            sentence_of.append(back + base)
            feature_of.append(x % features)
            bag_of.append(np.full(len(number), k))
            base += len(number)
    if not base:
        return np.zeros(features, np.float32), -math.inf
    sentence, feature, bag = map(np.concatenate, (sentence_of, feature_of, bag_of))
    plain = np.maximum(0, sentences - np.bincount(bag, minlength=len(toxic)))
    y = toxic.astype(float)
    w, b = np.zeros(features), -7.0
    gw, gb = np.full(features, 1e-6), 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(sentence, weights=w[feature], minlength=base) + b, -30, 30)))
        p0 = 1 / (1 + math.exp(-b))
        log_none = np.bincount(bag, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + plain * math.log1p(-p0)
        some = np.maximum(1 - np.exp(log_none), 1e-9)
        pull = np.where(y == 1, (1 - some) / some, -1.0) / len(y)  # times p: the gradient of a sentence's logit
        g = pull[bag] * p
        grad_w = np.bincount(feature, weights=g[sentence], minlength=features) - decay * w / 100
        grad_b = g.sum() + (pull * plain).sum() * p0
        gw += grad_w**2
        gb += grad_b**2
        w += 0.5 * grad_w / np.sqrt(gw)
        b = min(-3.0, b + 0.2 * grad_b / math.sqrt(gb))
    return w.astype(np.float32), float(b)


def bag_score(text: str, w: np.ndarray, bias: float) -> tuple[float, list[tuple[int, int, float]]]:
    """The score of a text, and start, end and score of its sentences."""
    number, feature, spans = sentence_features(text)
    if not spans or bias == -math.inf:
        return 0.0, []
    hit = w[feature] != 0
    number, feature = number[hit], feature[hit]
    if len(number):
        pairs = np.unique(number * BUCKETS + feature)
        number, feature = pairs // BUCKETS, pairs % BUCKETS
    logit = bias + np.bincount(number, weights=w[feature], minlength=len(spans))
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    total = -math.expm1(float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()))
    return min(1.0, max(0.0, total)), [(*span, float(x)) for span, x in zip(spans, p)]


def score(
    docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7, sentence_at: float = 0.5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, score, predicted, offending``; offending: (start, end, score) of sentences at ``sentence_at`` or more."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        w = shared.value

        def run(batch):
            both = [bag_score(str(value), w, bias) if value.is_valid else (0.0, []) for value in batch.column(1)]
            return {
                "doc_id": batch.column(0),
                "score": [s for s, _ in both],
                "offending": [[{"start": a, "end": z, "score": s} for a, z, s in found if s >= sentence_at] for _, found in both],
            }

        return run

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = per_batch(read, make, "doc_id long, score double, offending array<struct<start:int,end:int,score:double>>")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores below the threshold."""
    weights, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index(text)
    small_batches(docs)

    def run(batches):
        w = shared.value
        for batch in batches:
            keep = [not value.is_valid or bag_score(str(value), w, bias)[0] < threshold for value in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
