"""Boosted trees on histograms: one tree of every clause (and of every setting in a search) grows at a time.

1. Term weights are cut into cells, and each term's cells into quantile bins by their exact counts; a term
   that is absent has bin 0. Documents are written once as blocks of a few hundred rows: per term its rows
   and bins.
2. A level of the trees is one job. Each task adds up gradients, hessians and rows of its blocks by
   (clause, node, term, bin), Spark sums them by slices (a clause and a range of terms), and each slice hands
   on its best split per node. So a model takes trees x depth jobs, whatever the number of clauses, and what
   comes to the driver is bounded by slices x nodes.
3. Margins stay with the blocks. They are kept on the executors, computed again from the tree where an
   executor is lost, and written to the shared folder every ``CUT`` trees, so that lineage stays short.

Only the child with fewer rows is summed and shuffled. The sums of a level stay where they were made, as one partition for each
task of the shuffle, and the other child is what its parent has more. Nodes that no setting could split aren't summed at all.

Equal gains (to nine digits) go to the first term and its lowest bin that occurs in the node, so trees don't depend on the order of sums.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.storagelevel import StorageLevel

from clausespark.session import cut_lineage, shared_folder

#: Cells of the weights (0 to 1), rows of a block, ranges of terms, trees between two written states.
CELLS, BLOCK_ROWS, RANGES, CUT = 1_024, 512, 8, 20
#: Sums of a task's blocks that are kept side by side before equal keys are added up.
PENDING = 2_000_000
#: Entries of the blocks that are joined for the fit, cells of a dense sum, bits of a (term, bin) in the key (node, term, bin).
JOINED, DENSE, SHIFT = 2_000_000, 1 << 22, 40
#: The share of the parts' scores that a gain must exceed; less is what rounding leaves in a node of one class.
EXACT = 1e-12


@dataclass(frozen=True)
class Boosting:
    """Settings of the trees of a clause."""

    trees: int = 50
    depth: int = 4
    rate: float = 0.15
    columns: float = 0.4
    rows: float = 1.0
    min_rows: int = 20
    min_hessian: float = 1e-3
    l2: float = 0.0
    leaves: int | None = None
    weighted: bool = True
    pos_weight_mult: float = 1.0
    seed: int = 42
    #: Places of the terms that these trees may use, where several feature spaces lie side by side.
    space: tuple[int, int] | None = None


#: 200 trees of depth 6 with at most 31 leaves and five rows in each.
LARGER = Boosting(trees=200, depth=6, rate=0.1, columns=1.0, min_rows=5, leaves=31)
#: The depth-wise variant: penalised leaves, a least hessian instead of a least number of rows.
HESSIAN = Boosting(trees=100, depth=5, rate=0.1, columns=0.3, rows=0.8, min_rows=1, min_hessian=1.0, l2=1.0)


# ---- bins -----------------------------------------------------------------------------------


def cell(weight: str = "weight"):
    return F.least(F.floor(F.col(weight) * CELLS), F.lit(CELLS - 1)).cast("int")


def bin_edges(weights: DataFrame, bins: int = 32, min_rows: int = 1) -> DataFrame:
    """``term_id, bin, low``: the smallest cell of each bin (from 1 on) of the terms in at least ``min_rows`` documents.

    A cell's bin is the share of the term's rows in smaller cells, in as many steps as the term has groups of
    ``min_rows`` (at least three) rows, ``bins`` at most; empty bins don't exist. No split can part more rows than a
    term has, so rarer terms are of no use.
    """
    counts = weights.groupBy("term_id", cell().alias("cell")).agg(F.count("*").alias("n"))
    term, order = Window.partitionBy("term_id"), Window.partitionBy("term_id").orderBy("cell")  # at most CELLS rows
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(term)
    steps = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor(total / max(min_rows, 3))))
    placed = counts.select("term_id", "cell", total.alias("df"), (steps * before / total).cast("int").alias("part"))
    lows = placed.where(F.col("df") >= min_rows).groupBy("term_id", "part").agg(F.min("cell").alias("low"))
    return lows.select("term_id", F.row_number().over(Window.partitionBy("term_id").orderBy("part")).alias("bin"), "low")


@dataclass
class Bins:
    """All edges on the driver: terms x bins numbers, so bounded by the vocabulary."""

    terms: np.ndarray
    edges: np.ndarray
    starts: np.ndarray
    most: int

    @classmethod
    def of(cls, edges: DataFrame) -> Bins:
        rows = edges.toPandas().sort_values(["term_id", "bin"])
        terms, starts = np.unique(rows["term_id"].to_numpy(np.int64), return_index=True)
        place = np.searchsorted(terms, rows["term_id"].to_numpy(np.int64))
        return cls(terms, place * CELLS + rows["low"].to_numpy(np.int64), starts, int(rows["bin"].max()) if len(rows) else 1)

    def place(self, term_ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which entries have a known term, its place among the terms, and the bin."""
        if not len(self.terms):
            return np.zeros(len(term_ids), bool), np.zeros(0, np.int32), np.zeros(0, np.uint8)
        at = np.minimum(np.searchsorted(self.terms, term_ids), len(self.terms) - 1)
        known = self.terms[at] == term_ids
        cells = np.minimum((weights[known] * CELLS).astype(np.int64), CELLS - 1)
        found = np.searchsorted(self.edges, at[known] * CELLS + cells, side="right") - self.starts[at[known]]
        return known, at[known].astype(np.int32), np.maximum(found, 1).astype(np.uint8)


# ---- blocks ---------------------------------------------------------------------------------


@dataclass
class Block:
    """Some documents by term: rows ``row[ptr[t]:ptr[t + 1]]`` hold term ``t`` in bins ``bin[...]``."""

    ids: list
    ptr: np.ndarray
    row: np.ndarray
    bin: np.ndarray
    y: np.ndarray
    salt: np.ndarray
    held: np.ndarray
    slots: np.ndarray = field(default=None)
    slot: np.ndarray = field(default=None)

    def prepared(self, width: int) -> Block:
        """With the distinct (term, bin) of the block and each entry's place among them."""
        term = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))
        self.slots, slot = np.unique(term * width + self.bin, return_inverse=True)
        self.slot = slot.astype(np.int32)
        return self


def joined(blocks: Iterator[Block]) -> Iterator[Block]:
    """The blocks of a task in fewer ones of some ``JOINED`` entries, whose sums are worth more."""
    some: list[Block] = []
    for block in blocks:
        if some and sum(len(b.row) for b in some) + len(block.row) > JOINED:
            yield as_one(some)
            some = []
        some.append(block)
    if some:
        yield as_one(some)


def as_one(blocks: Sequence[Block]) -> Block:
    if len(blocks) == 1:
        return blocks[0]
    before = np.append(0, np.cumsum([len(b.ids) for b in blocks]))
    term = np.concatenate([np.repeat(np.arange(len(b.ptr) - 1, dtype=np.int32), np.diff(b.ptr)) for b in blocks])
    order = np.argsort(term, kind="stable")
    row = np.concatenate([b.row + n for b, n in zip(blocks, before)]).astype(np.int32)
    ptr = np.sum([b.ptr for b in blocks], axis=0)
    one = {name: np.concatenate([getattr(b, name) for b in blocks]) for name in ("bin", "y", "salt", "held")}
    return Block([i for b in blocks for i in b.ids], ptr, row[order], one["bin"][order], one["y"], one["salt"], one["held"])


def packed(weights: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, i, w``: term ids and weights of every document, as arrays."""
    pairs = F.collect_list(F.struct(F.col("term_id").cast("int").alias("i"), F.col("weight").cast("double").alias("w")))
    listed = weights.groupBy(id_col).agg(pairs.alias("pairs"))
    joined = docs.select(id_col).join(listed, id_col, "left")
    empty = F.array()
    return joined.select(
        id_col,
        F.coalesce(F.col("pairs.i"), empty.cast("array<int>")).alias("i"),
        F.coalesce(F.col("pairs.w"), empty.cast("array<double>")).alias("w"),
    )


def unpacked(rows: DataFrame) -> DataFrame:
    """``term_id, weight`` of every entry of the packed rows."""
    return rows.select(F.explode(F.arrays_zip("i", "w")).alias("e")).select(F.col("e.i").alias("term_id"), F.col("e.w").alias("weight"))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of an Arrow list column and the number of each row."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(np.append(0, np.cumsum(np.array([len(x) for x in column], np.int64))))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in at least as many partitions as the cluster has cores, since every step of a fit goes through all of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def binned_blocks(rows: DataFrame, bins: Bins, clauses: int, id_col: str = "doc_id", held: SparkColumn | None = None) -> DataFrame:
    """``block``: pickled blocks of rows ``id, i, w`` and labels ``y0..``, written once; trees don't learn from ``held`` rows."""
    import pyarrow as pa

    labels = [f"y{k}" for k in range(clauses)]
    shared = rows.sparkSession.sparkContext.broadcast(bins)
    apart = F.lit(False) if held is None else held
    own_labels = [F.col(c).cast("int").alias(c) for c in labels if c in rows.columns]
    read = spread(rows.select(F.col(id_col).alias("id"), "i", "w", F.xxhash64(F.col(id_col)).alias("salt"), apart.alias("held"), *own_labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_bins = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                terms, sizes = flat(batch.column(1))
                weights, _ = flat(batch.column(2))
                known, term, placed = known_bins.place(terms.astype(np.int64), weights.astype(np.float64))
                row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), sizes)[known]
                order = np.argsort(term, kind="stable")
                ptr = np.searchsorted(term[order], np.arange(len(known_bins.terms) + 1))
                y = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5, batch.num_columns)]
                y = np.stack(y, axis=1).astype(np.uint8) if y else np.zeros((batch.num_rows, 0), np.uint8)
                salt = batch.column(3).to_numpy().astype(np.int64).view(np.uint64)
                block = Block(batch.column(0).to_pylist(), ptr, row[order], placed[order], y, salt, batch.column(4).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return cut_lineage(read.mapInArrow(run, "block binary"))


# ---- trees ----------------------------------------------------------------------------------


@dataclass
class Trees:
    """One tree per column, nodes in heap order: the term (-1: a leaf), its lowest bin on the right, the value of a leaf, the gain."""

    term: np.ndarray
    low: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, columns: int, depth: int) -> Trees:
        size = 2 ** (depth + 1) - 1
        return cls(np.full((columns, size), -1, np.int32), np.zeros((columns, size), np.uint8), np.zeros((columns, size)), np.zeros((columns, size)))

    def nodes_of(self, block: Block) -> np.ndarray:
        """The node that each row of the block ends in, rows x columns."""
        columns, size = self.term.shape
        node = np.zeros((columns, len(block.ids)), np.int16)
        for c in range(columns):
            own = node[c]
            for i in np.flatnonzero(self.term[c] >= 0):
                at = slice(block.ptr[self.term[c, i]], block.ptr[self.term[c, i] + 1])
                here = own == i
                right = np.zeros(len(own), bool)
                right[block.row[at][block.bin[at] >= self.low[c, i]]] = True
                own[here] = 2 * i + 1
                own[here & right] = 2 * i + 2
        return node

    def values_of(self, block: Block) -> np.ndarray:
        return np.take_along_axis(self.value, self.nodes_of(block).astype(np.int64), axis=1)


@dataclass(frozen=True)
class Column:
    """What one of the trees that grow together is for: a clause, its settings, the weight of its positives."""

    clause: int
    settings: Boosting
    weight: float


@dataclass
class BoostedModel:
    """Trees of all columns in order, the starting margin of each, the bins and the clause names."""

    clauses: list[str]
    columns: list[Column]
    start: np.ndarray
    trees: list[Trees]
    bins: Bins
    constants: dict[str, float]


def chosen_terms(settings: Boosting, tree: int, terms: int) -> np.ndarray:
    """The terms that a tree of these settings may use."""
    low, high = settings.space or (0, terms)
    chosen = np.zeros(terms, bool)
    chosen[low:high] = True
    if settings.columns < 1:
        chosen[low:high] = np.random.default_rng([settings.seed, tree]).random(high - low) < settings.columns
    return chosen


def chosen_rows(settings: Boosting, tree: int, salt: np.ndarray) -> np.ndarray:
    if settings.rows >= 1:
        return np.ones(len(salt), bool)
    x = salt ^ np.uint64((settings.seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53 < settings.rows


def summed(key: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums (3 x keys) of each."""
    if not len(key) or (key[1:] > key[:-1]).all():
        return key, sums
    order = np.argsort(key, kind="stable")
    key, sums = key[order], sums[:, order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(sums, first, axis=1)


def cells_summed(cell: np.ndarray, row: np.ndarray, g: np.ndarray, h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells that occur, in order, and the sums of gradients, hessians and rows in them."""
    if 8 * len(cell) < cells:
        order = np.argsort(cell, kind="stable")
        return summed(cell[order], np.stack([g[row[order]], h[row[order]], np.ones(len(cell))]))
    n = np.bincount(cell, minlength=cells)
    found = np.flatnonzero(n)
    return found, np.stack([np.bincount(cell, g[row], cells)[found], np.bincount(cell, h[row], cells)[found], n[found]])


def ranges_of(columns: int) -> int:
    """Ranges of terms that each column's sums are cut into; a slice is a column and a range."""
    return -(-4 * RANGES // columns)


def histograms(parts, columns: Sequence[Column], tree: Trees, number: int, level: int, width: int, small: np.ndarray | None = None):
    """(slice, (keys, sums, totals)) of a task: sums by (node, (term, bin)) and by node; ``small`` (columns x nodes) names the nodes.

    One column's sums are made and handed on after the other's. The blocks' sums are added up whenever there are twice as many as
    distinct keys (or ``PENDING``), so a task's memory is bounded by the keys and doesn't grow with its blocks' sums.
    """
    nodes, ranges = 2**level, ranges_of(len(columns))
    first = nodes - 1
    parts = list(parts)
    if not parts:
        return
    terms = len(parts[0][0].ptr) - 1
    ends = [tree.nodes_of(block) - first for block, _ in parts]
    of_settings, masks = None, []
    for c, column in enumerate(columns):
        asked = np.ones(nodes, bool) if small is None else small[c]
        if not asked.any():
            continue
        if column.settings != of_settings:
            chosen, of_settings, masks = chosen_terms(column.settings, number, terms), column.settings, []
            for block, _ in parts:
                entries = np.flatnonzero(np.repeat(chosen, np.diff(block.ptr)))
                of_slots = chosen[block.slots // width]
                masks.append((
                    block.row[entries], (np.cumsum(of_slots, dtype=np.int32) - np.int32(1))[block.slot[entries]], block.slots[of_slots],
                    chosen_rows(column.settings, number, block.salt) & ~block.held,
                ))
        place = np.where(asked, np.cumsum(asked) - 1, -1)  # the nodes that are summed, numbered
        node_of = np.flatnonzero(asked)
        keys, sums, totals, pending, most = [], [], np.zeros((3, nodes)), 0, PENDING
        for (block, margin), end, (rows_of, slot_of, slots, taken) in zip(parts, ends, masks):
            node = np.where(taken & (end[c] >= 0), place[np.maximum(end[c], 0)], -1)
            here = node >= 0
            if not here.any():
                continue
            y = block.y[:, column.clause]
            p = 1.0 / (1.0 + np.exp(-margin[c]))
            w = np.where(y == 1, column.weight, 1.0)
            g, h = (p - y) * w, p * (1.0 - p) * w
            for s, x in enumerate((g, h, np.ones(len(g)))):
                totals[s, node_of] += np.bincount(node[here], x[here], len(node_of))
            row, slot = rows_of, slot_of
            if not here.all():
                at = np.flatnonzero(here[rows_of])
                row, slot = rows_of[at], slot_of[at]
            if not len(row):
                continue
            own = node[row]
            together = max(1, DENSE // len(slots))  # nodes whose cells are summed at a time
            for low in range(0, len(node_of), together):
                count = min(together, len(node_of) - low)
                if count == len(node_of):
                    some_row, cell = row, (slot if count == 1 else own * len(slots) + slot)
                else:
                    at = np.flatnonzero((own >= low) & (own < low + count))
                    some_row, cell = row[at], (own[at] - low) * len(slots) + slot[at]
                found, added = cells_summed(cell, some_row, g, h, count * len(slots))
                keys.append((node_of[low + found // len(slots)] << SHIFT) + slots[found % len(slots)])
                sums.append(added)
                pending += len(found)
            if pending > most:
                key, added = summed(np.concatenate(keys), np.concatenate(sums, axis=1))
                keys, sums, pending, most = [key], [added], len(key), max(PENDING, 2 * len(key))
        key, added = summed(np.concatenate(keys), np.concatenate(sums, axis=1)) if keys else (np.zeros(0, np.int64), np.zeros((3, 0)))
        part = (key & ((1 << SHIFT) - 1)) // width * ranges // terms if ranges > 1 else np.zeros(len(key), np.int64)
        for r in range(ranges):
            at = part == r if ranges > 1 else slice(None)
            yield c * ranges + r, (key[at], added[:, at], totals)


def merged(a, b):
    return (*summed(np.append(a[0], b[0]), np.hstack([a[1], b[1]])), a[2] + b[2])


def level_sums(records, small: np.ndarray | None, going: np.ndarray | None):
    """(slice, (keys, sums, totals, level)) of a task of the shuffle: the sums of all tasks, with the siblings' where the level before is there."""
    before, now = {}, {}
    for at, sums in records:
        if len(sums) > 3:
            before[at] = sums
        else:
            now[at] = merged(now[at], sums) if at in now else sums
    for at, sums in now.items():
        level = before[at][3] + 1 if at in before else 0
        yield at, (*(with_siblings(before.pop(at), sums, small, going, at // ranges_of(len(small))) if level else sums), level)


def with_siblings(before: tuple, now: tuple, small: np.ndarray, going: np.ndarray, column: int) -> tuple:
    """Sums of the nodes that go on: those of the ``small`` children as they are, those of their siblings as the parents' without them."""
    (parents, their, of_parents, _), (key, sums, totals), small = before, now, small[column]
    side = np.where(small[0::2], 0, np.where(small[1::2], 1, -1))  # of each parent: which child is summed
    parent = parents >> SHIFT
    split = np.flatnonzero(side[parent] >= 0)
    others = parents[split] + ((parent[split] + 1 - side[parent[split]]) << SHIFT)  # node 2 p + (1 - side)
    others, rest = summed(np.append(others, key ^ (1 << SHIFT)), np.hstack([their[:, split], -sums]))
    met = np.flatnonzero(rest[2] > 0.5)
    key, sums = np.append(key, others[met]), np.hstack([sums, rest[:, met]])
    kept = np.flatnonzero(going[column][key >> SHIFT])
    kept = kept[np.argsort(key[kept], kind="stable")]
    summed_nodes, totals = np.flatnonzero(small), totals.copy()
    totals[:, summed_nodes ^ 1] = of_parents[:, summed_nodes // 2] - totals[:, summed_nodes]
    return key[kept], sums[:, kept], totals


def best_splits(found, column: int, settings: Boosting, width: int) -> list[tuple]:
    """Rows (column, node, term, bin, gain, sums on the right) of a slice: the best split of each node."""
    key, sums, totals, _ = found
    if not len(key):
        return []
    node, slot = key >> SHIFT, key & ((1 << SHIFT) - 1)
    term = slot // width
    last = np.flatnonzero(np.append((term[1:] != term[:-1]) | (node[1:] != node[:-1]), True))
    passed = np.cumsum(sums, axis=1)
    of = np.repeat(last, np.diff(np.append(-1, last)))
    right = passed[:, of] - passed + sums
    total = totals[:, node]
    left = total - right
    l2 = settings.l2
    with np.errstate(divide="ignore", invalid="ignore"):
        parted = right[0] ** 2 / (right[1] + l2) + left[0] ** 2 / (left[1] + l2)
        gain = parted - total[0] ** 2 / (total[1] + l2)
    fits = (np.minimum(right[2], left[2]) >= settings.min_rows - 0.5) & (np.minimum(right[1], left[1]) >= settings.min_hessian)
    fits &= np.isfinite(gain) & (gain > EXACT * parted)
    rounded = np.where(fits, digits(gain), -np.inf)
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    most = np.maximum.reduceat(rounded, starts)
    top = np.flatnonzero(rounded == np.repeat(most, np.diff(np.append(starts, len(node)))))
    first = top[np.searchsorted(top, starts)]
    first = first[rounded[first] > 0]
    return [
        (column, int(node[i]), int(term[i]), int(slot[i] % width), float(rounded[i]), *map(float, right[:, i])) for i in first
    ]


def digits(x: np.ndarray) -> np.ndarray:
    """Rounded to nine significant digits."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = 10.0 ** (8 - np.floor(np.log10(np.abs(x))))
        return np.where(np.abs(x) > 1e-12, np.round(x * scale) / scale, 0.0)


def grow(state, columns: Sequence[Column], number: int, width: int) -> Trees:
    """The next tree of every column on blocks with margins; a level is one job."""
    depth = max(c.settings.depth for c in columns)
    tree = Trees.empty(len(columns), depth)
    leaves = np.ones(len(columns), np.int64)
    ranges, tasks = ranges_of(len(columns)), max(RANGES, state.context.defaultParallelism)
    kept, small, going = None, None, None
    for level in range(depth):
        first = 2**level - 1
        found = state.mapPartitions(lambda parts, level=level, tree=tree, small=small: histograms(parts, columns, tree, number, level, width, small))
        found = found.partitionBy(tasks, int)
        if kept is not None:
            found = kept.union(found)  # both lie by slice, so nothing is moved
            found = found if found.getNumPartitions() == tasks else found.partitionBy(tasks, int)
        found = found.mapPartitions(lambda records, small=small, going=going: level_sums(records, small, going), True)
        if level + 1 < depth:
            found.persist(StorageLevel.MEMORY_AND_DISK)

        def best(of):
            c = of[0] // ranges
            return c, of[1][2], best_splits(of[1], c, columns[c].settings, width)

        slices = found.map(best).collect()
        if kept is not None:
            kept.unpersist()
        kept = found
        totals = {c: x for c, x, _ in slices}
        chosen: dict[tuple[int, int], tuple] = {}
        for split in (s for _, _, splits in slices for s in splits):
            at = split[:2]
            if at not in chosen or (-split[4], split[2], split[3]) < (-chosen[at][4], chosen[at][2], chosen[at][3]):
                chosen[at] = split
        small, going = np.zeros((2, len(columns), 2 ** (level + 1)), bool)
        done = []
        for c, node, term, low, gain, g, h, n in sorted(chosen.values(), key=lambda s: (s[0], -s[4], s[1])):
            own = columns[c].settings
            if level >= own.depth or (own.leaves is not None and leaves[c] >= own.leaves):
                continue
            i = first + node
            whole = totals[c][:, node]
            tree.term[c, i], tree.low[c, i], tree.gain[c, i] = term, low, gain
            tree.value[c, 2 * i + 2] = -own.rate * g / (h + own.l2)
            tree.value[c, 2 * i + 1] = -own.rate * (whole[0] - g) / (whole[1] - h + own.l2)
            leaves[c] += 1
            done.append((c, node, h, n, 2 * n <= whole[2]))
        for c, node, h, n, fewer in done:
            own = columns[c].settings
            if level + 1 < own.depth and (own.leaves is None or leaves[c] < own.leaves):
                # both parts of a split have so many rows and so much hessian; where entries come twice the right side has less than
                # its sums and the left side has more than the rest, so only the right side is known to be too small
                going[c, 2 * node : 2 * node + 2] = True, n > 2 * own.min_rows - 1.5 and h > 2 * own.min_hessian * (1 - 1e-9)
                small[c, 2 * node + fewer] = True
        if not going.any():
            break
    if kept is not None:
        kept.unpersist()
    return tree


def written(state):
    """The blocks and margins as they are read back from the shared folder."""
    context = state.context
    from pyspark.sql import SparkSession

    path = f"{shared_folder(SparkSession.getActiveSession())}/{uuid.uuid4().hex}"
    state.saveAsPickleFile(path, 1)
    return context.pickleFile(path)


class Booster:
    """Grows trees on binned blocks (``block``, with the labels of the clauses)."""

    def __init__(self, blocks: DataFrame, bins: Bins, columns: Sequence[Column], start: np.ndarray):
        self.columns, self.start, self.width, self.number = list(columns), np.array(start, float), bins.most + 1, 0
        width, margins = self.width, self.start
        rows = blocks.rdd.mapPartitions(lambda parts: joined(pickle.loads(bytes(r[0])) for r in parts))
        self.state = rows.map(lambda b: (b.prepared(width), np.repeat(margins[:, None], len(b.ids), axis=1))).persist()
        self.older = None

    def step(self) -> Trees:
        tree = grow(self.state, self.columns, self.number, self.width)
        if self.older is not None:
            self.older.unpersist()
        self.number += 1
        added = self.state.map(lambda x: (x[0], x[1] + tree.values_of(x[0])))
        self.older, self.state = self.state, (written(added) if self.number % CUT == 0 else added).persist()
        return tree

    def confusions(self) -> np.ndarray:
        """True positives, false positives and false negatives of every column at 0.5 on the held rows (3 x columns)."""
        columns = self.columns

        def count(x) -> np.ndarray:
            block, margin = x
            y = np.stack([block.y[:, c.clause] == 1 for c in columns]) & block.held
            said = (margin >= 0) & block.held
            return np.stack([(said & y).sum(axis=1), (said & ~y).sum(axis=1), (~said & y).sum(axis=1)])

        return self.state.map(count).reduce(lambda a, b: a + b)

    def keep(self, which: Sequence[int]) -> None:
        """Go on with some of the columns only."""
        which = list(which)
        self.columns = [self.columns[c] for c in which]
        self.state = self.state.map(lambda x: (x[0], x[1][which]))

    def close(self) -> None:
        for rdd in (self.older, self.state):
            if rdd is not None:
                rdd.unpersist()


def column_of(clause: int, n_pos: float, n_neg: float, settings: Boosting) -> tuple[Column, float]:
    """A clause's column and its starting margin, the log odds of its weighted labels."""
    weight = max(1.0, n_neg / max(n_pos, 1.0)) * settings.pos_weight_mult if settings.weighted else 1.0
    return Column(clause, settings, weight), float(np.log(n_pos * weight / n_neg))


def fit(
    blocks: DataFrame, bins: Bins, counts: Sequence[tuple[float, float]], clauses: Sequence[str], settings: Boosting = Boosting(),
    min_positives: int = 2,
) -> BoostedModel:
    """Trees of every clause; one with a single class or too few positives gets none and scores 0."""
    chosen = [i for i, (n1, n0) in enumerate(counts) if n1 >= min_positives and n0 > 0]
    made = [column_of(i, *counts[i], settings) for i in chosen]
    model = BoostedModel(
        list(clauses), [c for c, _ in made], np.array([s for _, s in made]), [], bins,
        {c: 0.0 for i, c in enumerate(clauses) if i not in chosen},
    )
    return grown(model, blocks, settings.trees) if made else model


def fit_columns(blocks: DataFrame, bins: Bins, columns: Sequence[Column], start: Sequence[float], trees: int) -> BoostedModel:
    """Trees of columns of any settings, all with as many trees."""
    return grown(BoostedModel([], list(columns), np.array(start), [], bins, {}), blocks, trees)


def grown(model: BoostedModel, blocks: DataFrame, trees: int) -> BoostedModel:
    booster = Booster(blocks, model.bins, model.columns, model.start)
    for _ in range(trees):
        model.trees.append(booster.step())
        drawn = any(c.settings.rows < 1 or c.settings.columns < 1 for c in model.columns)
        if not drawn and not (model.trees[-1].term >= 0).any():
            break  # no later tree could split either
    booster.close()
    return model


def score(model: BoostedModel, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, clause, prob) of rows ``id, i, w`` in one pass; the model is broadcast, its size is bounded by its settings."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[id_col].dataType
    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("clause", pa.string()), ("prob", pa.float64())])

    def run(batches):
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                terms, sizes = flat(batch.column(1))
                known, term, placed = own.bins.place(terms.astype(np.int64), flat(batch.column(2))[0].astype(np.float64))
                row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), sizes)[known]
                order = np.argsort(term, kind="stable")
                ptr = np.searchsorted(term[order], np.arange(len(own.bins.terms) + 1))
                block = Block(list(range(batch.num_rows)), ptr, row[order], placed[order], None, None, None)
                margin = np.repeat(own.start[:, None], batch.num_rows, axis=1)
                for tree in own.trees:
                    margin += tree.values_of(block)
                prob = np.zeros((len(own.clauses), batch.num_rows))
                for i, c in enumerate(own.clauses):
                    prob[i] = own.constants.get(c, 0.0)
                prob[[c.clause for c in own.columns]] = 1.0 / (1.0 + np.exp(-margin))
                n = batch.num_rows
                ids = batch.column(0).take(pa.array(np.tile(np.arange(n), len(own.clauses))))
                names = pa.array(np.repeat(np.array(own.clauses, object), n), pa.string())
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(prob.ravel())], schema=arrow)

    return rows.select(id_col, "i", "w").mapInArrow(run, f"`{id_col}` {kind.simpleString()}, clause string, prob double")


def table(model: BoostedModel, vocabulary: DataFrame) -> DataFrame:
    """``clause, tree, node, term_id, term, low, gain, value``: every node of the trees, inner ones with their term and lowest cell."""
    lows = {(int(t), b + 1): int(e % CELLS) for k, t in enumerate(model.bins.terms) for b, e in enumerate(_edges(model.bins, k))}
    rows = []
    for t, tree in enumerate(model.trees):
        for k, column in enumerate(model.columns):
            reached = [0]
            for i in reached:
                place = int(tree.term[k, i])
                if place >= 0:
                    reached += [2 * i + 1, 2 * i + 2]
                    term = int(model.bins.terms[place])
                    low = lows[term, int(tree.low[k, i])] / CELLS if tree.low[k, i] > 1 else 0.0
                    rows.append((model.clauses[column.clause], t, i, term, low, float(tree.gain[k, i]), None))
                else:
                    rows.append((model.clauses[column.clause], t, i, None, None, None, float(tree.value[k, i])))
    schema = "clause string, tree int, node int, term_id int, low double, gain double, value double"
    nodes = vocabulary.sparkSession.createDataFrame(rows, schema)
    return nodes.join(vocabulary.select("term_id", "term"), "term_id", "left")


def _edges(bins: Bins, place: int) -> np.ndarray:
    end = bins.starts[place + 1] if place + 1 < len(bins.starts) else len(bins.edges)
    return bins.edges[bins.starts[place] : end]


def importances(model: BoostedModel, vocabulary: DataFrame) -> DataFrame:
    """``clause, term, weight, splits``: share of a clause's gain that each used term brings, and its number of splits."""
    inner = table(model, vocabulary).where(F.col("term_id").isNotNull())
    summed_gain = inner.groupBy("clause", "term_id", "term").agg(F.sum("gain").alias("gain"), F.count("*").alias("splits"))
    whole = summed_gain.groupBy("clause").agg(F.sum("gain").alias("whole"))  # a row per clause
    return summed_gain.join(F.broadcast(whole), "clause").select("clause", "term", (F.col("gain") / F.col("whole")).alias("weight"), "splits")


def save(model: BoostedModel, path: str) -> None:
    """The model as one file of the shared store at ``path``; trees and edges are plain arrays."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    content = spark.createDataFrame([(bytearray(pickle.dumps(model)),)], "model binary")
    content.write.mode("overwrite").parquet(path)


def load(spark, path: str) -> BoostedModel:
    return pickle.loads(bytes(spark.read.parquet(path).first()["model"]))
