"""Substring dedup of word windows by super-k-mer partitioning.

1. One pass over the texts hashes the words, takes the smallest hash of the ``MINIMISER`` word runs
   of each window, and cuts each document into super-k-mers: maximal runs of consecutive windows with
   the same minimiser. Only (minimiser, document, first window, windows) is written.
2. Equal windows have equal minimisers. So a super-k-mer whose minimiser occurs in one document only
   holds no repeated window and is done: on natural text that is most of them.
3. The others travel as one packed string of words to the bucket of their minimiser. There the windows
   are sorted, equal neighbours are compared word for word, and every run of equal windows knows its
   smallest document.
4. A minimiser with more than ``CROWDED`` super-k-mers would gather in one task. Its windows go one by
   one instead: the smallest document per 128-bit window hash is aggregated, partly inside each task,
   and joined back by a join that Spark can split.
5. Covered words are marked per document and removed.

A window is removed if its words also start in a document with a smaller id; windows are judged
on the input. Null texts have no words. Fewer words than a window: nothing goes. A null id counts as
larger than all others. Rows that repeat an id are judged each by its text, and none is smaller than
the other. Empty tables give empty ones; extra columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import WordHashes, _arrow_schema, pack_runs, per_batch, run_hashes, to_batch
from clausespark.session import cut_lineage

MINIMISER = 12
#: Super-k-mers of one minimiser that are sorted in one task, some 5 MB of words.
CROWDED = 10_000
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LAST_ID = 2**63 - 1


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, by doubling."""
    size, least = 1, values
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def super_kmers(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of the super-k-mers of hashed words."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = min(MINIMISER, window)
    least = sliding_min(run_hashes(words, width, FIRST), window - width + 1)
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return least[starts].view(np.int64), starts, np.diff(np.append(starts, len(least)))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``at, key, doc_id, text``: the id as a number that is never null, a hash of the text, the id itself."""
    number = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))
    return docs.select(
        number.alias("at"), F.xxhash64(text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")
    )


def scan(read: DataFrame, window: int) -> DataFrame:
    """``minimiser, at, key, start, n`` of every super-k-mer."""

    def make():
        hashes = WordHashes()

        def run(batch):
            found = [super_kmers(hashes.of((x.as_py() or b"").split()), window) for x in batch.column(2)]
            sizes = [len(starts) for _, starts, _ in found]
            minimiser, start, n = (np.concatenate(x) for x in zip(*found))
            at, key = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), sizes) for k in (0, 1))
            return {"minimiser": minimiser, "at": at, "key": key, "start": start, "n": n}

        return run

    return per_batch(read.select("at", "key", "text"), make, "minimiser long, at long, key long, start int, n int")


def packed(parted: DataFrame, window: int) -> DataFrame:
    """``minimiser, words, at, key, start`` of the super-k-mers that aren't crowded."""

    def make():
        def run(batch):
            out = {name: [] for name in ("minimiser", "words", "at", "key", "start")}
            for at, key, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                for p in parts:
                    if not p["crowded"]:
                        for field, x in zip(out, (p["minimiser"], b" ".join(words[p["start"] : p["start"] + p["n"] + window - 1]), at, key, p["start"])):
                            out[field].append(x)
            return out

        return run

    return per_batch(parted, make, "minimiser long, words binary, at long, key long, start int")


def crowded_windows(parted: DataFrame, window: int) -> DataFrame:
    """``w1, w2, at, key, start`` of every window of the crowded super-k-mers."""

    def make():
        hashes = WordHashes()

        def run(batch):
            out = {name: [np.zeros(0, np.int64)] for name in ("w1", "w2", "at", "key", "start")}
            for at, key, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                words = hashes.of(text.split())
                for p in parts:
                    if p["crowded"]:
                        run_of = words[p["start"] : p["start"] + p["n"] + window - 1]
                        n = p["n"]
                        columns = (
                            run_hashes(run_of, window, FIRST).view(np.int64),
                            run_hashes(run_of, window, SECOND).view(np.int64),
                            np.full(n, at),
                            np.full(n, key),
                            np.arange(p["start"], p["start"] + n),
                        )
                        for field, x in zip(out, columns):
                            out[field].append(x)
            return {name: np.concatenate(x) for name, x in out.items()}

        return run

    return per_batch(parted, make, "w1 long, w2 long, at long, key long, start int")


def repeated_in_buckets(buckets: pa.Table, window: int, hashes: WordHashes) -> dict:
    """``at, key, start, n`` of the runs of windows that also start in a smaller document; whole buckets in, sorted by minimiser."""
    words_of = [x.split() for x in buckets["words"].to_pylist()]
    sizes = np.array([len(x) for x in words_of])
    flat = [w for x in words_of for w in x]
    values = hashes.of(flat)
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in flat), np.int64, len(flat))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    windows = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    position = first[owner] + within
    h = run_hashes(values, window, FIRST)[position]
    at = buckets["at"].to_numpy()
    order = np.lexsort((at[owner], h))
    p, d = position[order], at[owner][order]
    same = np.append(False, h[order][1:] == h[order][:-1])
    for k in range(window):  # equal hashes count as equal only where all words are
        idx = np.flatnonzero(same)
        same[idx] = codes[p[idx] + k] == codes[p[idx - 1] + k]
    group = np.cumsum(~same) - 1
    smallest = d[np.flatnonzero(~same)]  # sorted by document inside equal hashes
    mark = np.zeros(len(order), bool)
    mark[order] = d > smallest[group]
    runs, lengths = pack_runs(mark, owner)
    who = owner[runs]
    return {
        "at": at[who],
        "key": buckets["key"].to_numpy()[who],
        "start": buckets["start"].to_numpy()[who] + within[runs],
        "n": lengths,
    }


def count_buckets(strings: DataFrame, window: int) -> DataFrame:
    """Deal packed strings to the bucket of their minimiser and mark repeated windows there."""
    schema = "at long, key long, start int, n int"
    arrow = _arrow_schema(strings, schema)

    def run(batches):
        hashes, held = WordHashes(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            minimiser = table["minimiser"].to_numpy()
            cut = int(np.searchsorted(minimiser, minimiser[-1]))  # the last bucket may go on
            for part in slices(minimiser[:cut]):
                yield to_batch(repeated_in_buckets(table.slice(*part), window, hashes), arrow)
            held = table.slice(cut)
        if held is not None:
            yield to_batch(repeated_in_buckets(held, window, hashes), arrow)

    def slices(minimiser: np.ndarray, rows: int = 4000):
        starts = np.flatnonzero(np.append(True, minimiser[1:] != minimiser[:-1])) if len(minimiser) else []
        begin = 0
        for s in [*starts[1:], len(minimiser)] if len(minimiser) else []:
            if s - begin >= rows or s == len(minimiser):
                yield begin, int(s) - begin
                begin = int(s)

    return strings.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and ``at, key, start, n``: runs of windows that also start in a smaller document."""
    read = keyed(docs, doc_id, text)
    pieces = cut_lineage(scan(read, window))
    ends = pieces.groupBy("minimiser").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count("*").alias("c"))
    shared = cut_lineage(ends.filter("low < high").select("minimiser", (F.col("c") > CROWDED).alias("crowded")))
    part = F.struct("start", "n", "minimiser", "crowded")
    parts = pieces.join(shared, "minimiser").groupBy("at", "key").agg(F.collect_set(part).alias("parts"))
    parted = read.join(cut_lineage(parts), ["at", "key"]).select("at", "key", "text", "parts")
    marks = count_buckets(packed(parted, window), window)
    if shared.filter("crowded").head(1):
        single = crowded_windows(parted, window)
        least = single.groupBy("w1", "w2").agg(F.min("at").alias("low"))
        least = least.select("w1", F.col("w2").alias("v2"), "low")
        # equal w2 is a filter, not a key: the join is then dealt anew by w1, and Spark can split it
        again = single.join(least, "w1").filter((F.col("w2").bitwiseXOR(F.col("v2")) == 0) & (F.col("low") < F.col("at")))
        marks = marks.unionByName(again.select("at", "key", "start", F.lit(1).alias("n")))
    return read, marks


def dedup(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` of every row; kept: the words left, joined by one space."""
    read, marks = repeated_windows(docs, window, doc_id, text)
    marks = marks.groupBy("at", "key").agg(F.collect_set(F.struct("start", "n")).alias("marks"))

    def make():
        def run(batch):
            out = {name: [] for name in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")}
            ids, texts, found = (batch.column(k) for k in range(3))
            for name, value, runs in zip(ids.to_pylist(), texts, found.to_pylist()):
                words = (value.as_py() or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for x in runs or ():
                    gone[x["start"]] += 1
                    gone[min(len(words), x["start"] + x["n"] + window - 1)] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                kept = b" ".join(words if not runs else [w for w, s in zip(words, stays.tolist()) if s])
                row = (name, len(words), int(len(words) - stays.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))
                for field, x in zip(out, row):
                    out[field].append(x)
            return out

        return run

    joined = read.join(marks, ["at", "key"], "left").select("doc_id", "text", "marks")
    return per_batch(joined, make, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
