"""Helpers of the operators in this folder: hashing of words in batches, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.session import cut_lineage

BATCH_ROWS = 1_000
UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def crc_mod(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def per_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """Apply a batch function in every task; ``make`` runs once per task and may hold state.

    The function returns columns by name (lists, arrays), or None for no rows.
    """
    small_batches(df)
    arrow = _arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            if batch.num_rows:
                columns = function(batch)
                if columns is not None:
                    yield to_batch(columns, arrow)

    return df.mapInArrow(run, schema)


def small_batches(df: DataFrame) -> None:
    """Let the session send long texts to Python by ``BATCH_ROWS``, so that a batch stays a few MB."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def to_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in arrow for x in [columns[f.name]]]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def _arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of short words."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT and len(word) <= 48:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser with two multiplications)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """A hash of every run of ``length`` neighbouring values, by Horner's rule on doubling blocks."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, value = 0, np.zeros(n, np.uint64)
    block, size, factor = words, 1, multiplier % 2**64
    remaining = length
    while remaining:
        if remaining & 1:
            value = value * np.uint64(factor) + block[done : done + n]
            done += size
        remaining >>= 1
        if remaining:
            block = block[: len(block) - size] * np.uint64(factor) + block[size:]
            size, factor = size * 2, factor * factor % 2**64
    return mix(value)


def pack_runs(mask: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run of True in ``mask`` that stays within one group."""
    where = np.flatnonzero(mask)
    if not len(where):
        return where, where
    first = np.ones(len(where), bool)
    first[1:] = (where[1:] != where[:-1] + 1) | (group[where[1:]] != group[where[:-1]])
    starts = np.flatnonzero(first)
    return where[starts], np.diff(np.append(starts, len(where)))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) of the undirected edges ``a, b``.

    Large-star and small-star rounds on distinct edges, each written to the shared folder. A round
    attaches neighbours to the smallest one known; neighbourhoods are only reduced by min, never
    gathered, so a hub with many neighbours is combined before its shuffle.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
