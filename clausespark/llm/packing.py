"""Best-two-fit packing of tokenised documents into sequences of a fixed number of tokens.

A document is its token ids and an end id. Documents longer than a sequence are cut into whole
sequences and a shorter first piece; no other document is cut.

Which lengths share a sequence depends on lengths alone, so the plan is made on the histogram of
piece lengths (at most ``size`` numbers, whatever the number of documents): fill a sequence
greedily with the longest lengths that fit; then take out its smallest and put in two unpacked ones
that fit the expanded gap more tightly; use this pattern as often as the counts allow. Pieces
of one length are interchangeable: each gets its rank among those of its length, counted by slices
of a hash so that a frequent length is spread over many tasks, and its rank says its place. The
number of slices grows with the most frequent length, so a slice stays near ``SLICE_ROWS`` pieces.

Null and empty texts are one end id. Repeated rows are packed each for itself, an empty table gives
an empty one, and only the named columns are read. Texts are taken whole, one at a time.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausespark.llm.common import per_batch
from clausespark.session import cut_lineage

#: Runs longer than this go to the slower tokenizer, whose time stays near linear in a run.
LONG_RUN = re.compile(r"\S{2048}|\s{2048}")
#: Slices of a length at least, and pieces of a slice about.
SLICES, SLICE_ROWS = 256, 250_000
_ENCODERS: dict = {}


def encoder(json_file: str, ranks_file: str, pattern: str):
    """A function from text to ids: those of the tokenizer in ``json_file``, most of them made from the same vocabulary's ranks."""
    key = (json_file, ranks_file)
    if key not in _ENCODERS:
        import base64
        import json
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        with open(json_file, encoding="utf-8") as f:
            special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        whole = Tokenizer.from_file(json_file)

        def encode(text: str) -> np.ndarray:
            if LONG_RUN.search(text):
                return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, allowed_special="all")

        _ENCODERS[key] = encode
    return _ENCODERS[key]


def pieces(
    docs: DataFrame, json_file: str, ranks_file: str, pattern: str, size: int, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece; the ids themselves stay in the task."""

    def make():
        encode = encoder(json_file, ranks_file, pattern)

        def run(batch):
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(str(value)) if value.is_valid else ()
                ids = np.append(np.asarray(ids, "<u4"), np.array([end_id], "<u4"))
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    for field, x in zip(out, (name, k, a, z - a, zlib.crc32(ids[a:z].tobytes()))):
                        out[field].append(x)
            return out

        return run

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return per_batch(read, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence) and how many sequences each gives, for pieces counted by length."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan = []
    while left.any():
        pattern: list[int] = []
        spare = left.copy()
        gap = size
        while gap:  # fill greedily
            fits = np.flatnonzero(spare[1 : gap + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            pattern.append(length)
            spare[length] -= 1
            gap -= length
        if gap and len(pattern) > 1:  # two for the smallest, if they leave less
            smallest = pattern[-1]
            room = gap + smallest
            have = np.flatnonzero(spare[1 : room + 1]) + 1
            best = (smallest, ())
            if len(have):
                partner = np.searchsorted(have, room - have, side="right") - 1
                for a, k in zip(have[::-1].tolist(), partner[::-1].tolist()):
                    if a * 2 < best[0]:
                        break
                    b = int(have[k]) if k >= 0 else 0
                    if b == a and spare[a] < 2:
                        b = int(have[k - 1]) if k >= 1 else 0
                    if 0 < b <= a and a + b > best[0]:
                        best = (a + b, (a, b))
                        if a + b == room:
                            break
            if best[1]:
                spare[smallest] += 1
                pattern[-1:] = best[1]
        lengths, uses = np.unique(pattern, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        plan.append((pattern, times))
    return plan


def places(spark, plan: list[tuple[list[int], int]]) -> DataFrame:
    """The plan as ranges: pieces of ``length`` with ranks from ``low`` to below ``high`` and where they go."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            low = used.get(length, 0)
            used[length] = low + times
            rows.append((length, low, low + times, sequence, offset))
            offset += length
        sequence += times
    return spark.createDataFrame(rows, "length long, low long, high long, sequence long, offset long")


def pack(cut: DataFrame, size: int) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces (any table with doc_id, piece and length columns)."""
    spark = cut.sparkSession
    cut = cut_lineage(cut)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slices = max(SLICES, max(histogram.values(), default=0) // SLICE_ROWS)
    cut = cut.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    counted = cut_lineage(cut.groupBy("length", "_slice").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in cut.columns])
    ranked = cut.withColumn("_row", F.row_number().over(within) - 1).join(before, ["length", "_slice"])
    ranked = ranked.withColumn("_rank", F.col("_row") + F.col("_before"))
    at = F.broadcast(places(spark, best_two_fit(histogram, size)).withColumnRenamed("length", "_length"))
    found = ranked.join(at, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    return found.withColumn("sequence_id", F.col("sequence") + F.col("_rank") - F.col("low")).select(
        *[c for c in cut.columns if c != "_slice"], "sequence_id", "offset"
    )
