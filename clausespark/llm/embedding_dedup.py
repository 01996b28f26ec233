"""Embedding near-dedup by a robust-pruned flat graph.

1. Equal vectors are one class, known by its smallest id; a class counts its vectors.
2. Centroids are fitted on a bounded sample; every class goes to its ``OVERLAP`` nearest centroids.
   A cluster with more than ``PART`` classes is dealt into parts by a hash.
3. Build: in each part, nearest neighbours and a few random ones are pruned robustly (a neighbour goes
   if one already kept is clearly nearer to it), reverse edges are added, and the adjacency lists of
   a class in several clusters are united.
4. Search: a class searches the graphs of the ``probes`` clusters whose centroids are nearest to itself,
   each from its medoids, best first; the beam doubles while all of it is in range.
   Queries run in blocks of about ``PART``, and each part of a cluster is searched by all of them.
5. Links found are verified in double precision. Classes are drawn by a hash and compared with all
   others until ``LINKED`` of them have links; recall is the mean over these. Below ``RECALL`` the search is
   repeated with more probes and a wider beam. Once a quarter of the centroids would be probed, all
   classes are compared with all instead, which is exact; where fewer than ``LINKED`` classes have links
   the draws have done that already, and nothing is searched.

Vectors that are null, zero, or hold null or non-finite components are linked with nothing, nor are
vectors of different lengths with each other. Rows without an id have no links and no component.
Rows that repeat an id and vector are counted as vectors of their own. An empty table gives an empty
one. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import connected_components, union_all
from clausespark.session import cut_lineage

OVERLAP, PART, SAMPLE, PER_CLUSTER, MOST_CLUSTERS = 2, 20_000, 20_000, 1_000, 4_096
DEGREE, NEAREST, RANDOM, ALPHA = 24, 48, 12, 1.2
RECALL, AUDITED, LINKED = 0.98, 200, 100
BUCKETS, DRAWN_BYTES = 1_000_000, 64_000_000


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def stacked(column: pd.Series) -> np.ndarray:
    return unit(np.stack(column.to_numpy()).astype(np.float64))


def centroids(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    draw = np.random.default_rng(7)
    centres = sample[draw.choice(len(sample), clusters, replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(sample[i : i + 2048] @ centres.T).argmax(1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def robust_prune(vectors: np.ndarray, seed: int) -> list[np.ndarray]:
    """Neighbours of every vector: near ones that no kept neighbour makes superfluous, and reverse edges."""
    n = len(vectors)
    if n == 1:
        return [np.zeros(0, np.int64)]
    draw, lists = np.random.default_rng(seed), []
    near = min(NEAREST, n - 1)
    single = vectors.astype(np.float32)
    for at in range(0, n, 256):
        own = np.arange(at, min(n, at + 256))
        close = single[own] @ single.T
        close[np.arange(len(own)), own] = -2
        candidates = np.argpartition(-close, near - 1, axis=1)[:, :near]
        candidates = np.hstack([candidates, draw.integers(0, n, (len(own), RANDOM))])
        distance = 1 - np.take_along_axis(close, candidates, 1)
        distance[candidates == own[:, None]] = np.inf
        around = single[candidates]
        kept = np.full((len(own), DEGREE), -1)
        rows = np.arange(len(own))
        left = distance.copy()
        for k in range(DEGREE):
            pick = left.argmin(1)
            good = np.isfinite(left[rows, pick])
            kept[good, k] = candidates[rows, pick][good]
            between = 1 - np.einsum("qcd,qd->qc", around, around[rows, pick])
            left[ALPHA * between <= distance] = np.inf
            left[rows, pick] = np.inf
            if not good.any():
                break
        # the random ones stay, so that no group of near vectors is cut off
        kept = np.hstack([kept, candidates[:, near : near + 4]])
        lists.extend(np.unique(x[(x >= 0) & (x != i)]) for i, x in zip(own.tolist(), kept))
    source = np.repeat(np.arange(n), [len(x) for x in lists])
    target = np.concatenate(lists)
    order = np.argsort(target, kind="stable")
    back = np.split(source[order], np.cumsum(np.bincount(target, minlength=n))[:-1])
    return [np.union1d(x, y[: 2 * DEGREE]) for x, y in zip(lists, back)]


def range_search(
    vectors: np.ndarray, graph: list[np.ndarray], starts: np.ndarray, queries: np.ndarray, least: float, beam: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every query the vectors found with a cosine of ``least`` or more, and the cosines.

    Best first from ``starts``: the nearest vectors held are expanded until all held ones are. The
    beam holds ``beam`` vectors, or all in range and half as many more, whichever is larger, so
    that nothing in range is dropped or left unexpanded.
    """
    n = len(vectors)
    table = np.full((n + 1, max(1, max(map(len, graph)))), n)
    for i, x in enumerate(graph):
        table[i, : len(x)] = x
    padded = np.vstack([vectors, np.zeros((1, vectors.shape[1]))])
    found = []
    for at in range(0, len(queries), 128):
        found.extend(_best_first(padded, table, starts, queries[at : at + 128], least, beam))
    return found


def _best_first(padded: np.ndarray, table: np.ndarray, starts: np.ndarray, queries: np.ndarray, least: float, beam: int):
    q, n = len(queries), len(padded) - 1  # row n stands for no vector
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    seen[:, starts] = True
    held = np.tile(starts, (q, 1))
    near = queries @ padded[starts].T
    done = np.zeros(held.shape, bool)
    while True:
        open_near = np.where(done, -np.inf, near)
        at_once = min(4, held.shape[1])
        pick = np.argpartition(-open_near, at_once - 1, axis=1)[:, :at_once]
        live = np.take_along_axis(open_near, pick, 1) > -np.inf
        if not live.any():
            break
        np.put_along_axis(done, pick, True, 1)
        around = table[np.where(live, np.take_along_axis(held, pick, 1), n)].reshape(q, -1)
        around = np.sort(np.where(seen[rows, around], n, around), axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = n
        around = around[:, (around != n).any(0)]
        if not around.shape[1]:
            continue
        seen[rows, around] = True
        value = np.einsum("qcd,qd->qc", padded[around], queries)
        value[around == n] = -np.inf
        held, near, done = np.hstack([held, around]), np.hstack([near, value]), np.hstack([done, around == n])
        width = max(beam, int((near >= least).sum(1).max()) + beam // 2)
        if held.shape[1] > width:
            keep = np.argpartition(-near, width - 1, axis=1)[:, :width]
            held, near, done = (np.take_along_axis(x, keep, 1) for x in (held, near, done))
    hit = near >= least
    return [(held[k][hit[k]], near[k][hit[k]]) for k in range(q)]


def valid(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that can have links."""
    read = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists("v", lambda x: x != 0)
    return read.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~wrong & ~zero)


def assigned(classes: DataFrame, centres: np.ndarray, near: int) -> DataFrame:
    """``rep, v, clusters``: the numbers of the ``near`` nearest centroids, nearest first."""
    near = min(near, len(centres))

    def run(frames):
        for frame in frames:
            if len(frame):
                sims = stacked(frame["v"]) @ centres.T
                frame["clusters"] = list(np.argsort(-sims, axis=1, kind="stable")[:, :near].astype(np.int32))
                yield frame[["rep", "v", "clusters"]]

    return classes.mapInPandas(run, "rep long, v array<double>, clusters array<int>")


def clusters_of(count: int) -> int:
    return max(1, min(MOST_CLUSTERS, count // PER_CLUSTER))


def found_links(classes: DataFrame, count: int, cosine: float, probes: int, beam: int) -> DataFrame:
    """``a, b``: the pairs of classes (a < b) that the search finds."""
    spark = classes.sparkSession
    share = min(1.0, SAMPLE / max(1, count))
    draw = classes.filter(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) <= int(1_000_000 * share)).select("v").toPandas()
    sample = stacked(draw["v"]) if len(draw) else np.zeros((0, 1))
    if not len(sample):
        return spark.createDataFrame([], "a long, b long")
    centres = centroids(sample, min(len(sample), clusters_of(count)))
    placed = cut_lineage(assigned(classes, centres, max(OVERLAP, probes)))
    near = placed.select("rep", "v", F.posexplode("clusters").alias("at", "c"))
    counts = near.groupBy("c").agg(F.count_if(F.col("at") < OVERLAP).alias("n"), F.count_if(F.col("at") < probes).alias("asks")).collect()
    sizes = [(r["c"], max(1, -(-r["n"] // PART)), max(1, -(-r["asks"] // PART))) for r in counts]
    near = near.join(F.broadcast(spark.createDataFrame(sizes, "c int, parts int, blocks int")), "c")
    members = near.filter(F.col("at") < OVERLAP).withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        vectors, names = stacked(frame["v"]), frame["rep"].to_numpy()
        lists = robust_prune(vectors, seed=int(frame["c"].iloc[0]))
        middle = int((vectors @ vectors.mean(0)).argmax())
        return pd.DataFrame({"rep": names, "near": [names[x] for x in lists], "medoid": np.arange(len(names)) == middle})

    built = members.select("c", "part", "rep", "v").groupBy("c", "part").applyInPandas(build, "rep long, near array<long>, medoid boolean")
    graph = built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("medoid").alias("medoid"))
    graph = cut_lineage(graph)
    nodes = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(graph, "rep")
    queries = near.filter(F.col("at") < probes).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(1)), "blocks").cast("int"))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = F.array().cast("array<bigint>")
    rows = union_all(
        [
            nodes.select("c", "part", "block", "rep", "v", "near", "medoid", F.lit(False).alias("query")),
            queries.select("c", "part", "block", "rep", "v", none.alias("near"), F.lit(False).alias("medoid"), F.lit(True).alias("query")),
        ]
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        asks, has = frame[frame["query"]], frame[~frame["query"]]
        if not len(asks) or not len(has):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        names = has["rep"].to_numpy()
        order = np.argsort(names)
        graph = []
        for x in has["near"]:
            at = np.minimum(np.searchsorted(names, x, sorter=order), len(names) - 1)
            graph.append(order[at][names[order[at]] == x])
        starts = np.flatnonzero(has["medoid"].to_numpy())
        starts = starts if len(starts) else np.zeros(1, np.int64)
        found = range_search(stacked(has["v"]), graph, starts, stacked(asks["v"]), cosine - 1e-9, beam)
        a = np.repeat(asks["rep"].to_numpy(), [len(x) for x, _ in found])
        b = names[np.concatenate([x for x, _ in found])] if len(a) else a
        return pd.DataFrame({"a": np.minimum(a, b)[a != b], "b": np.maximum(a, b)[a != b]})

    return rows.groupBy("c", "part", "block").applyInPandas(search, "a long, b long").distinct()


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine, in double precision, reaches the limit."""
    left, right = (classes.select(F.col("rep").alias(x), F.col("v").alias(f"v_{x}")) for x in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)
    both = pairs.join(left, "a").join(right, "b")
    value = dot("v_a", "v_b") / (F.sqrt(dot("v_a", "v_a")) * F.sqrt(dot("v_b", "v_b")))
    return both.filter(value >= cosine).select("a", "b")


def drawn() -> Column:
    return F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(BUCKETS))


def true_links(classes: DataFrame, count: int, cosine: float, first: int = PART, linked: int | None = None) -> tuple[DataFrame, int]:
    """``a, b``: the links (a < b) of the classes whose hash is below the number returned, by brute force.

    Classes are drawn to the driver by ranges of the hash, ``first`` and then ever more, about
    ``DRAWN_BYTES`` at most at once, until ``linked`` of them have links or all are drawn. Each draw is
    compared with all classes where these lie, so nothing is shuffled but the pairs in range.
    """
    length = classes.select(F.size("v")).first()[0]
    most = max(1, min(PART, DRAWN_BYTES // (8 * length)))
    low, size, seen, parts = 0, first, 0, []
    while low < BUCKETS and (linked is None or seen < linked):
        high = min(BUCKETS, low + max(1, -(-BUCKETS * min(size, most) // max(1, count))))
        mine = (drawn() >= low) & (drawn() < high)
        asked = classes.filter(mine).select("rep", "v").toPandas()
        if len(asked):
            parts.append(cut_lineage(verified(in_range(classes, asked, cosine), classes, cosine)))
            if linked is not None:
                seen += ends(parts[-1]).filter(mine).select("rep").distinct().count()
        low, size = high, size * 4
    links = union_all(parts) if parts else classes.sparkSession.createDataFrame([], "a long, b long")
    return cut_lineage(links.distinct()), low


def ends(links: DataFrame) -> DataFrame:
    return links.withColumn("rep", F.explode(F.array("a", "b")))


def in_range(classes: DataFrame, asked: pd.DataFrame, cosine: float) -> DataFrame:
    """``a, b``: the pairs (a < b) of an asked class and any other, to be verified."""
    names, vectors = asked["rep"].to_numpy(), stacked(asked["v"])

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), 512):
                own = frame.iloc[at : at + 512]
                row, column = np.nonzero(stacked(own["v"]) @ vectors.T >= cosine - 1e-9)
                a, b = own["rep"].to_numpy()[row], names[column]
                yield pd.DataFrame({"a": np.minimum(a, b)[a != b], "b": np.maximum(a, b)[a != b]})

    return classes.select("rep", "v").mapInPandas(run, "a long, b long").distinct()


def audited_recall(links: DataFrame, truth: DataFrame, below: int) -> float:
    """The mean share of its true links that ``links`` holds, over the drawn classes that have links."""
    hit = truth.join(links.withColumn("hit", F.lit(1.0)), ["a", "b"], "left").withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    return ends(hit).filter(drawn() < below).groupBy("rep").agg(F.avg("hit").alias("hit")).agg(F.avg("hit")).first()[0]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    read = valid(vectors, vec_id, vector)
    classes = cut_lineage(read.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    per_length = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    parts = [vectors.sparkSession.createDataFrame([], "a long, b long")]
    for length, count in sorted(per_length.items()):
        own = classes.filter(F.size("v") == length)
        truth, below = true_links(own, count, cosine, AUDITED, LINKED)
        links, probes, beam = truth, 3, 48
        while below < BUCKETS:
            links = cut_lineage(verified(found_links(own, count, cosine, probes, beam), own, cosine))
            if audited_recall(links, truth, below) >= RECALL:
                break
            probes, beam = probes * 2, beam * 2
            if 4 * probes >= clusters_of(count):
                links, below = true_links(own, count, cosine)
        parts.append(links)
    links = union_all(parts)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(classes.select(F.col("rep").alias("b"), "size"), "b").groupBy("a").agg(F.sum("size").alias("others"))
    components = connected_components(links)
    named = classes.join(linked, F.col("rep") == F.col("a"), "left").join(components, F.col("rep") == F.col("node"), "left")
    named = cut_lineage(
        named.select("v", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    keyed = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    joined = keyed.join(named.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left")
    alone = F.col("component_id").isNull() | F.col("vec_id").isNull()
    out = joined.select(
        "vec_id",
        F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
