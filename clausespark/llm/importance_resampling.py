"""Target-distribution importance resampling by hashed word features.

1. One pass over the texts keeps per document its number of words and the buckets of its features (runs
   of words); the table is written once.
2. Every task adds up its own bucket counts, Spark sums them. A bucket's gain compares its share in
   the target texts with that in the documents. Gains are one array of ``buckets`` numbers, whatever
   the corpus holds, and a document's weight is the floored mean of its entries.
3. Weight plus seeded Gumbel noise is the score, an integer; scores are written once.
4. The cutoff is found on the numbers alone: count jobs narrow the range of scores, then that of the
   tied document ids, until the wanted number of rows lies above. Each job counts above ``PARTS`` cuts.
5. Only the drawn rows are sorted, by range, to get their ranks; the others pass by unsorted.

Null texts have no words; a document without features has weight 0. Rows without an id have no score,
don't count among the documents to draw from and are never drawn. Repeated rows are drawn each by
itself; where only some of several rows of one id and score fit, any of them are. Empty tables give
empty ones; without target texts T and t are 0. Extra columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import UPPER_TO_LOWER, _arrow_schema, per_batch, to_batch
from clausespark.operators.ordering import global_rank
from clausespark.session import cut_lineage

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Cuts that one count job tries.
PARTS = 16


class Buckets(dict):
    """Bucket numbers of features, remembered up to a number of short ones."""

    LIMIT = 200_000

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        value = zlib.crc32(feature) % self.buckets
        if len(self) < self.LIMIT and len(feature) <= 48:
            self[feature] = value
        return value

    def of(self, text: bytes, longest: int) -> tuple[int, np.ndarray]:
        """The number of words of a text and the buckets of all runs of 1 to ``longest`` words."""
        words = WORDS.findall(text.translate(UPPER_TO_LOWER))
        features = [words]
        for size in range(2, longest + 1):
            features.append([b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)])
        found = [np.fromiter(map(self.__getitem__, f), np.int32, len(f)) for f in features]
        return len(words), np.concatenate(found)


def featured(docs: DataFrame, buckets: int, longest: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, buckets`` of every row."""

    def make():
        known = Buckets(buckets)

        def run(batch):
            found = [known.of(x.as_py() or b"", longest) for x in batch.column(1)]
            return {"doc_id": batch.column(0), "n_words": [n for n, _ in found], "buckets": [b for _, b in found]}

        return run

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return per_batch(read, make, "doc_id long, n_words long, buckets array<int>")


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a batch's list column and where each row's begin and end."""
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum([len(x) for x in column]))


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows; a task gives at most one row per bucket."""
    schema = "bucket int, n long"
    arrow = _arrow_schema(features, schema)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(flat(batch.column(0))[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield to_batch({"bucket": found, "n": total[found]}, arrow)

    rows = features.select("buckets").mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in rows:  # at most one per bucket
        total[r["bucket"]] = r["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the smoothed log ratio of target to source share, per bucket."""
    n = len(source)
    above = (target + 1.0) * (target.dtype.type(source.sum()) + float(n))
    below = (source + 1.0) * (source.dtype.type(target.sum()) + float(n))
    return np.floor(1000 * np.log(above / below)).astype(np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of every row."""
    shared = features.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def make():
        own = shared.value

        def run(batch):
            values, ends = flat(batch.column(2))
            sums = np.append(0, np.cumsum(own[values]))[ends]
            n = np.diff(ends)
            return {"doc_id": batch.column(0), "n_words": batch.column(1), "n_features": n, "weight": np.diff(sums) // np.maximum(n, 1)}

        return run

    return per_batch(features.select("doc_id", "n_words", "buckets"), make, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Floored thousandths of Gumbel noise that the seed and the id alone decide."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def cutoff(rows: DataFrame, value: Column, wanted: int) -> int:
    """The largest integer that at least ``wanted`` rows reach; there are at least so many rows."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        step = -(-(high - low) // PARTS)
        cuts = list(range(low + step, high, step)) + [high]
        reached = rows.agg(*[F.count_if(value >= F.lit(c)) for c in cuts]).first()
        good = [c for c, n in zip(cuts, reached) if n >= wanted]
        bad = [c for c, n in zip(cuts, reached) if n < wanted]
        low, high = (good[-1] if good else low), (bad[0] - 1 if bad else high)
    return low


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1,
    seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; undrawn rows have no rank.

    Of the rows with an id and at least ``least_words`` words ``percent`` in a hundred are drawn, floored.
    """
    features = cut_lineage(featured(docs, buckets, longest, doc_id, text))
    wanted_like = featured(target.withColumn("_none", F.lit(None).cast("long")), buckets, longest, "_none", target_text)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted_like, buckets))
    scored = weighted(features, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))

    open_rows = scored.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words))
    k = percent * open_rows.count() // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if k == 0:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    least = cutoff(open_rows, F.col("score"), k)
    tied = open_rows.filter(F.col("score") == least)
    left = k - open_rows.filter(F.col("score") > least).count()
    last = -cutoff(tied, -F.col("doc_id"), left)
    is_open = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    drawn = is_open & ((F.col("score") > least) | ((F.col("score") == least) & (F.col("doc_id") <= last)))
    ranked = global_rank(scored.filter(drawn), [], [F.col("score").desc(), F.col("doc_id"), F.col("_row")])
    ranked = ranked.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    rest = scored.filter(~F.coalesce(drawn, F.lit(False)))
    return ranked.union(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
