"""MinHash near-dedup with b-bit signatures.

1. One pass over the texts gives per document its number of distinct shingles, a 128-bit key of the
   set, one hash per band of minima, and the low bits of all minima packed into a few longs.
2. Documents with equal sets are one class, known by its smallest id: groups of copies of any size
   are folded by an aggregation that combines inside each task.
3. Classes that share a band are candidates. First each is paired with the smallest and the largest of
   its band (a star, so a band with n classes gives 2n pairs). Pairs whose similarity, estimated by
   counting equal low bits and corrected for chance, lies clearly below the threshold go; the others
   are confirmed on full sets. Components follow from the confirmed links.
4. A band whose classes then lie in several components may still hide links: there, all pairs across
   components that pass the estimate are confirmed too. Pairs inside a component can't change it. So
   every candidate pair is either confirmed, refuted or already connected: nothing is capped. In a
   band with more than ``FEW`` such classes no pairs are written: its sets are compared in blocks of
   ``BLOCK`` by ``BLOCK`` classes, and a block gives only the links of a spanning forest.

The number of bands makes a pair at the threshold share none with probability ``MISS`` at most.

Null texts and texts without words have no shingles and are linked with nothing. With fewer words than
a shingle the whole sequence is one. Rows without an id are a component of nothing (null, kept).
Rows that repeat an id are judged each by its text; where two texts of one id are both the smallest of their
kind, a link of one is a link of both. Empty tables give empty ones. Extra columns are not read, whatever
their names. Shingles are compared by 64-bit hashes; texts are taken whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import UPPER_TO_LOWER, WordHashes, connected_components, mix, per_batch, run_hashes
from clausespark.session import cut_lineage

MULTIPLIER = 0x9E3779B97F4A7C15
#: Minima per band, bits kept of a minimum, and the largest chance to miss a pair at the threshold.
ROWS, BITS, MISS = 5, 4, 1e-5
FEW, BLOCK = 32, 1_000


def bands_for(similarity: float) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-(similarity**ROWS)))


def shingle_set(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = text.translate(UPPER_TO_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    values = hashes.of(found)
    if len(values) < words:
        return mix(run_hashes(values, len(values), MULTIPLIER) + np.uint64(len(values)))
    return np.unique(run_hashes(values, words, MULTIPLIER))


def minima(values: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest value of every hash function over the set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 512):
        least = np.minimum(least, (values[at : at + 512] * factors + offsets).min(axis=1, initial=np.iinfo(np.uint64).max)[:, None].ravel())
    return least


def sketches(docs: DataFrame, words: int, bands: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, c1, c2, bands, bits``: set size, key of the set, band hashes, packed low bits."""
    import xxhash

    count = bands * ROWS
    draw = np.random.default_rng(20_240_229)
    factors = (draw.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    offsets = draw.integers(0, 2**63, count, dtype=np.uint64)[:, None]
    salts = mix(np.arange(1, bands + 1, dtype=np.uint64))
    per_long = 64 // BITS
    longs = -(-count // per_long)
    shifts = (np.arange(per_long, dtype=np.uint64) * np.uint64(BITS))[None, :]

    def make():
        hashes = WordHashes()

        def run(batch):
            sizes, keys, band_rows, bit_rows = [], [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py() or b"", words, hashes)
                sizes.append(len(found))
                key = xxhash.xxh3_128_intdigest(found.tobytes())
                keys.append((key >> 64, key % 2**64))
                if not len(found):
                    band_rows.append(np.zeros(0, np.int64))
                    bit_rows.append(np.zeros(0, np.int64))
                    continue
                least = mix(minima(found, factors, offsets))
                grouped = least.reshape(bands, ROWS)
                band = salts.copy()
                for k in range(ROWS):
                    band = mix(band * np.uint64(MULTIPLIER) + grouped[:, k])
                band_rows.append(band.view(np.int64))
                low = np.zeros(longs * per_long, np.uint64)
                low[:count] = least & np.uint64(2**BITS - 1)
                bit_rows.append(np.bitwise_or.reduce(low.reshape(longs, per_long) << shifts, axis=1).view(np.int64))
            both = np.array(keys, np.uint64).view(np.int64)
            return {"doc_id": batch.column(0), "n_shingles": sizes, "c1": both[:, 0], "c2": both[:, 1], "bands": band_rows, "bits": bit_rows}

        return run

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return per_batch(read, make, "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>, bits array<long>")


def estimate(a: Column, b: Column, count: int) -> Column:
    """Similarity from packed low bits: the share of equal minima, corrected for equality by chance."""
    marks = 0x1111111111111111  # the lowest of every four bits

    def unequal(x: Column) -> Column:
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(F.lit(marks)))

    different = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    chance = 2.0**-BITS
    return (1 - different / F.lit(count) - chance) / (1 - chance)


def shingle_sets(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    def make():
        hashes = WordHashes()

        def run(batch):
            found = [shingle_set(x.as_py() or b"", words, hashes).view(np.int64) for x in batch.column(1)]
            return {"doc_id": batch.column(0), "shingles": found}

        return run

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return per_batch(read, make, "doc_id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity (numerator, denominator)."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("sum"))
    part, whole = similarity
    return both.filter(F.col("shared") * whole >= (F.col("sum") - F.col("shared")) * part).select("a", "b").distinct()


def links_in_blocks(members: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``a, b``: links across components among the members (band, rep, component, members) of each band."""
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "component")
    part, whole = similarity

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["shingles"].map(len).to_numpy()
        names, back, times = np.unique(np.concatenate(frame["shingles"].to_numpy()), return_inverse=True, return_counts=True)
        repeated = np.cumsum(times > 1) - 1  # a shingle of one member is in no intersection
        use = times[back] > 1
        shared = np.zeros((len(frame), len(frame)), np.float32)
        row, column = np.repeat(np.arange(len(frame)), sizes)[use], repeated[back[use]]
        for at in range(0, int(repeated[-1]) + 1 if len(names) else 0, 4096):
            some = (column >= at) & (column < at + 4096)
            held = np.zeros((len(frame), 4096), np.float32)
            held[row[some], column[some] - at] = 1
            shared += held @ held.T
        shared, total = shared.astype(np.float64), sizes[:, None] + sizes[None, :]
        component, own = frame["component"].to_numpy(), frame["own"].to_numpy()
        linked = (shared * whole >= (total - shared) * part) & (component[:, None] != component[None, :])
        if frame["x"].iloc[0] != frame["y"].iloc[0]:
            linked &= own[:, None] != own[None, :]  # pairs inside a block are another group's
        a, b = spanning_forest(linked)
        names = frame["rep"].to_numpy()
        return pd.DataFrame({"a": np.minimum(names[a], names[b]), "b": np.maximum(names[a], names[b])})

    with_sets = dealt.join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    return with_sets.groupBy("band", "x", "y").applyInPandas(link, "a long, b long")


def spanning_forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the symmetric matrix connects."""
    unseen, a, b = np.ones(len(linked), bool), [], []
    for root in range(len(linked)):
        waiting = [root] if unseen[root] else []
        unseen[root] = False
        while waiting:
            i = waiting.pop()
            found = np.flatnonzero(linked[i] & unseen)
            unseen[found] = False
            a.extend([i] * len(found))
            b.extend(found.tolist())
            waiting.extend(found.tolist())
    return np.array(a, np.int64), np.array(b, np.int64)


def near_duplicates(
    docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    doc_id, text = "doc_id", "text"
    ratio = similarity[0] / similarity[1]
    bands = bands_for(ratio)
    count = bands * ROWS
    lowest = ratio - 5 * math.sqrt((ratio * (1 - ratio) + 2.0**-BITS) / count)
    sketch = cut_lineage(sketches(docs, words, bands, doc_id, text))
    nodes = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = nodes.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "bands", "bits")).alias("least"))
    classes = cut_lineage(classes.select("c1", "c2", F.col("least.doc_id").alias("rep"), "least.bands", "least.bits"))
    bits = classes.select("rep", "bits")

    banded = classes.select("rep", F.explode("bands").alias("band"))
    ends = cut_lineage(banded.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high"))
    shared = cut_lineage(banded.join(ends, "band"))
    star = shared.select(F.col("low").alias("a"), F.col("rep").alias("b")).union(shared.select(F.col("rep").alias("a"), F.col("high").alias("b")))
    star = star.filter("a < b").distinct()
    left, right = (bits.select(F.col("rep").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    likely = estimate(F.col("bits_a"), F.col("bits_b"), count) >= lowest
    tried = cut_lineage(star.join(left, "a").join(right, "b").filter(likely).select("a", "b").distinct())
    wanted = shared.select(F.col("rep").alias("_rep")).distinct()
    candidates = docs.join(wanted, F.col(doc_id).cast("long") == F.col("_rep"))
    sets = cut_lineage(shingle_sets(candidates, words, doc_id, text))
    links = cut_lineage(confirmed(tried, sets, similarity))
    components = connected_components(links)

    placed = shared.select("band", "rep").join(components, F.col("rep") == F.col("node"), "left")
    placed = cut_lineage(placed.select("band", "rep", F.coalesce("component", "rep").alias("component")))
    mixed = placed.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("band")
    crossing = cut_lineage(placed.join(cut_lineage(mixed), "band").join(bits, "rep"))
    one, other = (crossing.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "component", "bits")]) for x in "ab")
    apart = (F.col("one.band") == F.col("other.band")) & (F.col("component_a") != F.col("component_b")) & likely
    open_ends = cut_lineage(one.alias("one").join(other.alias("other"), apart, "left_semi"))
    counted = open_ends.join(cut_lineage(open_ends.groupBy("band").agg(F.count("*").alias("members"))), "band")
    few = counted.filter(F.col("members") <= FEW)
    fewer = few.select("band", *[F.col(f"{c}_a").alias(f"{c}_b") for c in ("rep", "component", "bits")])
    across = few.join(fewer, "band").filter((F.col("component_a") < F.col("component_b")) & likely)
    across = across.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
    many = counted.filter(F.col("members") > FEW).select("band", F.col("rep_a").alias("rep"), F.col("component_a").alias("component"), "members")
    in_blocks = links_in_blocks(many, sets, similarity)
    more = cut_lineage(confirmed(across.join(tried, ["a", "b"], "left_anti"), sets, similarity).union(in_blocks).distinct())
    if more.head(1):
        components = connected_components(links.union(more))

    named = classes.select("c1", "c2", "rep").join(components, F.col("rep") == F.col("node"), "left")
    named = cut_lineage(named.select("c1", "c2", F.coalesce("component", "rep").alias("component")))
    found = sketch.select("doc_id", "n_shingles", "c1", "c2").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    found = found.select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
