"""A prefix trie of conversations by ROLLUP.

A turn is known by an id, 128 bits of a hash of its role and text. A conversation becomes rows of
``BLOCK`` positional turn columns, each row keyed by the node that the blocks before it lead to. One
ROLLUP over the columns then aggregates every prefix of every conversation; ``grouping_id`` tells how
many columns a prefix has. Long conversations are only more rows, and no group is gathered: all that
a node knows of its members are counts, sums and the smallest id, combined inside each task.

A node is known by its depth and the exclusive-or of position-salted hashes of its turns (2 x 64 bits).
Sums over subtrees follow from the members alone. A conversation is the smallest member of the nodes
from one depth (its head) to its end, so the nodes below ``v`` are dealt out among the members of ``v``:
each has those from its head on, the smallest member all of its own. So a first ROLLUP finds smallest
members and heads, a second one sums per node what the members have.

Order in a conversation and what lies before a block are running sums over range slices, in which a
conversation of any length spreads over many tasks.

Null roles and texts count as empty; turns that are equal in number come in the order of their turn id (md5
of role length, role and text), null numbers first. Rows without a conversation id are left out. Repeated
rows are repeated turns. An empty table gives the root alone, with no members and no smallest one. Extra columns
are not read; any number of turns and texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.llm.common import _arrow_schema
from clausespark.session import cut_lineage

#: Turns in a row of the ROLLUP; member ids that become one string before they are hashed.
BLOCK, IDS = 8, 1_024


def before(df: DataFrame, key: str, order: Sequence[Column], sums: Sequence[str] = (), xors: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``before_<column>``: the sum or exclusive-or of a column over the earlier rows of the same key.

    Rows are range-partitioned and run through in order. A key may go on in the next slices: only keys at
    the ends of slices do, so their totals are a few rows per slice, which come to the driver. Slices are written once.
    """
    spark = df.sparkSession
    columns = [*sums, *xors]
    whole = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), *(f"before_{c} long" for c in columns), "slice int"])
    arrow = _arrow_schema(df, whole)
    at = {c: df.columns.index(c) for c in [key, *columns]}

    def run(batches):
        last, carried = None, dict.fromkeys(columns, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at[key]).to_numpy()
            first = np.append(keys[0] != last, keys[1:] != keys[:-1])
            start = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))  # 0 too where the key goes on
            found = []
            for c in columns:
                own = batch.column(at[c]).to_numpy().astype(np.int64)
                if c in sums:
                    passed = np.cumsum(own) - own
                    found.append(passed - passed[start] + np.where(start == 0, 0 if first[0] else carried[c], 0))
                    carried[c] = int(found[-1][-1] + own[-1])
                else:
                    passed = np.bitwise_xor.accumulate(own) ^ own
                    found.append(passed ^ passed[start] ^ np.where(start == 0, 0 if first[0] else carried[c], 0))
                    carried[c] = int(found[-1][-1] ^ own[-1])
            last = keys[-1]
            number = np.full(len(keys), TaskContext.get().partitionId(), np.int32)
            arrays = [*batch.columns, *(pa.array(x, pa.int64()) for x in found), pa.array(number)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(slices, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    cut = cut_lineage(cut.mapInArrow(run, whole))
    ends = cut.groupBy("slice").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    low, high = ({r[x] for r in ends} for x in ("low", "high"))
    open_keys = [k for k in low & high if sum(r["low"] == k or r["high"] == k for r in ends) > 1]
    if not open_keys:
        return cut.drop("slice")
    totals = cut.filter(F.col(key).isin(open_keys)).groupBy(key, "slice")
    totals = totals.agg(*[F.sum(c).alias(c) for c in sums], *[F.bit_xor(c).alias(c) for c in xors])
    rows, carried = [], {}
    for r in sorted(totals.collect(), key=lambda r: (r[key], r["slice"])):
        so_far = carried.get(r[key], [0] * len(columns))
        rows.append((r[key], r["slice"], *so_far))
        carried[r[key]] = [x + r[c] if c in sums else x ^ r[c] for c, x in zip(columns, so_far)]
    offsets = spark.createDataFrame(rows, f"{key} long, slice int, " + ", ".join(f"off_{c} long" for c in columns))
    joined = cut.join(F.broadcast(offsets), [key, "slice"], "left")
    plus = {c: F.col(f"before_{c}") + F.coalesce(f"off_{c}", F.lit(0)) for c in sums}
    plus |= {c: F.col(f"before_{c}").bitwiseXOR(F.coalesce(f"off_{c}", F.lit(0).cast("long"))) for c in xors}
    return joined.select(*df.columns, *[x.alias(f"before_{c}") for c, x in plus.items()])


def turn_rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, at, id, n``: position, turn id and code points of the text of every original turn."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    whole = F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary")
    read = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.unhex(F.md5(whole)).alias("id"), F.length(said).cast("long").alias("n"), F.lit(1).cast("long").alias("one"),
    )
    placed = before(read, "conv_id", [F.col("turn").asc_nulls_first(), F.col("id")], sums=["one"])
    return placed.select("conv_id", F.col("before_one").alias("at"), "id", "n")


def rebuilt(turns: DataFrame, family: int = 100, borrow: int = 6) -> tuple[DataFrame, DataFrame]:
    """All conversations (``conv_id``), and their turns after each took its first ones from the head of its family.

    The head has the next lower multiple of ``family`` as its id; a conversation takes the first crc32(id) modulo
    ``borrow`` turns of it and keeps its own from there on.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    asked = F.crc32(F.col("conv_id").cast("string").cast("binary")) % borrow
    conversations = cut_lineage(turns.groupBy("conv_id").agg(F.count("*").alias("turns")))
    heads = conversations.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("lent"))
    joined = conversations.select("conv_id", base.alias("base"), asked.alias("asked")).filter("conv_id <> base").join(heads, "base", "left")
    taken = cut_lineage(joined.withColumn("got", F.least("asked", F.coalesce("lent", F.lit(0)))))
    lent = turns.filter((F.col("conv_id") % family == 0) & (F.col("at") < borrow - 1)).withColumnRenamed("conv_id", "base")
    borrowed = taken.filter("got > 0").select("conv_id", "base", "got").join(lent, "base").filter("at < got").select("conv_id", "at", "id", "n")
    own = turns.filter(F.col("conv_id") % family != 0).filter(F.col("at") >= asked).join(taken.select("conv_id", "asked", "got"), "conv_id")
    own = own.select("conv_id", (F.col("at") - F.col("asked") + F.col("got")).alias("at"), "id", "n")
    heads_own = turns.filter(F.col("conv_id") % family == 0).select("conv_id", "at", "id", "n")
    return conversations.select("conv_id"), heads_own.union(own).union(borrowed)


def lanes(turn: Column, at: Column) -> list[Column]:
    """Two hashes of a turn at its place; the exclusive-or over a prefix names its node."""
    return [F.xxhash64(at.cast("long"), turn["id"]), F.xxhash64(turn["id"], at.cast("long"))]


def block_rows(turns: DataFrame) -> DataFrame:
    """``conv_id, block, t0.., b1, b2, base_n, x1, x2, n``: columns of turns, the node and text length before the block, its own."""
    placed = F.struct("at", F.struct("id", "n").alias("turn"))
    rows = turns.groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(placed)).alias("turns"))

    def lane(i: int) -> Column:
        return F.aggregate("turns", F.lit(0).cast("long"), lambda total, t: total.bitwiseXOR(lanes(t["turn"], t["at"])[i]))

    length = F.aggregate("turns", F.lit(0).cast("long"), lambda total, t: total + t["turn"]["n"])
    rows = rows.select("conv_id", "block", "turns", lane(0).alias("x1"), lane(1).alias("x2"), length.alias("n"), F.size("turns").cast("long").alias("k"))
    rows = before(rows, "conv_id", [F.col("block")], sums=["n"], xors=["x1", "x2"])
    columns = [F.get("turns", F.lit(i))["turn"].alias(f"t{i}") for i in range(BLOCK)]
    return cut_lineage(
        rows.select(
            "conv_id", "block", *columns, F.col("before_x1").alias("b1"), F.col("before_x2").alias("b2"),
            F.col("before_n").alias("base_n"), "x1", "x2", "n", "k",
        )
    )


def prefixes(blocks: DataFrame, measures: Sequence[str] = ()) -> DataFrame:
    """One row per node but the root: ``depth, c1, c2, p1, p2, n, above, n_convs, conv_id`` and the sums of the measures.

    c and p name the node and its parent, n is the length of its last text and ``above`` that of all before it.
    """
    turns = [f"t{i}" for i in range(BLOCK)]
    sums = "".join(f", sum({m}) AS {m}" for m in measures)
    groups = blocks.sparkSession.sql(
        f"SELECT block, b1, b2, base_n, {', '.join(turns)}, grouping_id() AS rolled, count(*) AS n_convs, min(conv_id) AS conv_id{sums}"
        f" FROM {{blocks}} GROUP BY block, b1, b2, base_n, ROLLUP ({', '.join(turns)})",
        blocks=blocks,
    )
    width = (F.lit(BLOCK) - F.bit_count("rolled")).cast("int")
    groups = groups.withColumn("width", width).withColumn("last", F.get(F.array(*turns), F.col("width") - 1))
    groups = groups.filter((F.col("width") > 0) & F.col("last").isNotNull())
    at = F.col("block") * BLOCK
    named = []
    for i in (0, 1):
        parts = [F.coalesce(F.when(F.col(t).isNotNull(), lanes(F.col(t), at + k)[i]), F.lit(0).cast("long")) for k, t in enumerate(turns)]
        named.append(reduce(lambda a, b: a.bitwiseXOR(b), parts, F.col(f"b{i + 1}")))
    own = lanes(F.col("last"), at + F.col("width") - 1)
    lengths = reduce(lambda a, b: a + b, [F.coalesce(F.col(t)["n"], F.lit(0).cast("long")) for t in turns], F.col("base_n"))
    found = groups.select(
        (at + F.col("width")).cast("long").alias("depth"), named[0].alias("c1"), named[1].alias("c2"), own[0].alias("l1"), own[1].alias("l2"),
        F.col("last")["n"].alias("n"), lengths.alias("through"), "n_convs", "conv_id", *measures,
    )
    return found.select(
        "depth", "c1", "c2", F.col("c1").bitwiseXOR(F.col("l1")).alias("p1"), F.col("c2").bitwiseXOR(F.col("l2")).alias("p2"),
        "n", (F.col("through") - F.col("n")).alias("above"), "n_convs", "conv_id", *measures,
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """``depth, c1, c2, n_ends, ends_sha256`` of the nodes in which conversations (``conv_id``) end.

    Ids are joined in blocks of ``IDS`` numbers; the strings of a node run in order through one hash, which
    holds none of them.
    """
    blocks = ends.groupBy("depth", "c1", "c2", F.shiftright("conv_id", IDS.bit_length() - 1).alias("part"))
    strings = blocks.agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.count("*").alias("n_ends")
    )
    schema = "depth long, c1 long, c2 long, n_ends long, ends_sha256 string"
    arrow = _arrow_schema(ends, schema)

    def run(batches):
        node, total, digest = None, 0, None
        for batch in batches:
            done = []
            for *own, ids, n in zip(*(c.to_pylist() for c in batch.columns)):
                if own != node:
                    if node:
                        done.append((*node, total, digest.hexdigest()))
                    node, total, digest = own, 0, hashlib.sha256()
                digest.update((("," if total else "") + ids).encode())
                total += n
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done) if done else [[]] * 5, arrow)], schema=arrow)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*node, total, digest.hexdigest()), arrow)], schema=arrow)

    in_order = strings.repartition("depth", "c1", "c2").sortWithinPartitions("depth", "c1", "c2", "part")
    return in_order.select("depth", "c1", "c2", "ids", "n_ends").mapInArrow(run, schema)


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over turns (``conv_id, at, id, n``); conversations (``conv_id``) without turns end in the root.

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    blocks = block_rows(turns)
    nodes = cut_lineage(prefixes(blocks))
    whole = blocks.groupBy("conv_id").agg(F.sum("k").alias("depth"), F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"), F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    whole = conversations.join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("depth", "c1", "c2", "total")])
    whole = cut_lineage(whole)
    ends = cut_lineage(end_hashes(whole.select("depth", "c1", "c2", "conv_id")))
    node = ["depth", "c1", "c2"]

    # where each conversation begins to be the smallest member, and whether it ends in a childless node
    childless = nodes.join(ends.select(*node, "n_ends"), node).filter("n_ends = n_convs").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    heads = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "above", "p1", "p2")).alias("head")).select("conv_id", "head.*")
    heads = cut_lineage(heads.withColumnRenamed("depth", "head"))
    parents = nodes.select(F.col("depth").alias("up"), F.col("c1").alias("p1"), F.col("c2").alias("p2"), F.col("conv_id").alias("parent"))
    below_root = heads.filter("head > 1").withColumn("up", F.col("head") - 1)
    parent_of = below_root.join(parents, ["up", "p1", "p2"]).select("conv_id", "parent")
    known = whole.select("conv_id", "total").join(heads.select("conv_id", "head", "above"), "conv_id", "left")
    known = known.join(childless, "conv_id", "left").join(parent_of, "conv_id", "left")
    own = F.when(F.col("head").isNotNull(), F.col("total") - F.col("above")).otherwise(zero)
    known = cut_lineage(known.select("conv_id", "total", own.alias("own"), F.coalesce("leaf", zero).alias("leaf"), "head", "parent"))

    summed = prefixes(blocks.join(known.select("conv_id", "total", "own", "leaf"), "conv_id"), ["total", "own", "leaf"])
    least = known.select("conv_id", F.col("total").alias("least_total"), F.col("own").alias("least_own"), "head", "parent")
    children = cut_lineage(nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count("*").alias("n_children")))
    everything = known.agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.coalesce(F.sum("total"), zero).alias("total"),
        F.coalesce(F.sum("own"), zero).alias("own"), F.coalesce(F.sum("leaf"), zero).alias("leaf"),
    ).first()
    root_id = F.lit(everything["conv_id"]).cast("long")
    parent = F.when(F.col("depth") > F.col("head"), F.col("conv_id")).when(F.col("depth") == 1, root_id).otherwise(F.col("parent"))
    beneath = F.col("own") - F.col("least_own") + F.col("least_total") - F.col("above")  # text in the nodes from here down
    inner = summed.join(least, "conv_id").select(
        "conv_id", *node, parent.alias("parent_conv_id"), "n_convs", F.col("leaf").alias("n_leaves"),
        (F.col("total") - F.col("n_convs") * F.col("above") - beneath).alias("saved_tokens"),
    )
    # the root: no text, a leaf itself where nothing is below it
    root = turns.sparkSession.range(1).select(
        root_id.alias("conv_id"), zero.alias("depth"), zero.alias("c1"), zero.alias("c2"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(everything["n_convs"]).cast("long").alias("n_convs"), F.lit(everything["leaf"] or 1).cast("long").alias("n_leaves"),
        F.lit(everything["total"] - everything["own"]).cast("long").alias("saved_tokens"),
    )
    found = inner.union(root).join(children, node, "left").join(ends, node, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(
    conversations: DataFrame, family: int = 100, borrow: int = 6,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """The trie of all conversations after each took its first turns from the head of its family."""
    members, turns = rebuilt(turn_rows(conversations, conv_id, turn, role, text), family, borrow)
    return trie(turns, members)
