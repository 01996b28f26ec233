"""Benchmark decontamination: word windows of documents against the hash set of a benchmark's windows.

Everything is DataFrame expressions. The windows of a document are hashed inside its row and exploded into a
broadcast hash join with the benchmark's windows in the same stage, so only hits leave it; a hit is verified by
its words there too. The hash tables are broadcast in parts of at most ``PART`` windows, whose size is so
bounded (some 200 bytes a window); a larger benchmark takes more parts in the same pass. Nothing but hits and
one row of numbers per document is shuffled. Documents are filtered or cut by a join with the hashes of
the texts that have hits.

Null texts have no words. An item without words or without an id has no window; one with fewer words
than a window is one window. Repeated rows of documents give repeated rows, repeated items count
once. No documents give no rows, no items no hits. Extra columns are not read. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows in one broadcast hash table.
PART = 250_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; letters outside ASCII stay as they are."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    parts = F.split(lowered, BETWEEN_WORDS)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def hash_sql(length: int) -> str:
    """SQL of the hash of the ``length`` words whose hashes are in ``h`` from position ``i`` on."""
    return f"xxhash64({length}, " + ", ".join(f"get(h, i + {k})" for k in range(length)) + ")"


def words_sql(length: int) -> str:
    return "concat_ws(' ', " + ", ".join(f"get(w, i + {k})" for k in range(length)) + ")"


def windows_of_items(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """``n, window, hash, item_id`` of every window of every item: its number of words, words and hash."""
    split = items.filter(F.col(item_id).isNotNull())
    split = split.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    split = split.withColumn("n", F.least(F.size("w"), F.lit(window))).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    at = split.select("item_id", "n", "w", "h", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("i"))
    by_length = lambda sql: F.expr("case n " + " ".join(f"when {n} then {sql(n)}" for n in range(1, window + 1)) + " end")
    return at.select("n", by_length(words_sql).alias("window"), by_length(hash_sql).alias("hash"), "item_id").distinct()


class BenchmarkWindows:
    """The windows of a benchmark, ready to be looked for in documents: ``n, window, hash, item_id``, and how many of each length."""

    def __init__(self, items: DataFrame, window: int = 10, item_id: str = "item_id", text: str = "text", part: int = PART):
        self.table = cut_lineage(windows_of_items(items, window, item_id, text))
        self.lengths = {r["n"]: r["c"] for r in self.table.groupBy("n").agg(F.count("*").alias("c")).collect()}
        self.parts = max(1, -(-sum(self.lengths.values()) // part))

    def part(self, k: int) -> DataFrame:
        """The ``k``-th hash table: windows are dealt by the low bits of their hash."""
        own = self.table.filter(F.pmod("hash", F.lit(self.parts)) == k)
        return own.select(F.col("hash").alias(f"hash{k}"), F.col("window").alias(f"window{k}"), F.col("item_id").alias(f"item{k}"))

    def windows(self) -> Column:
        """``array<struct<at, length, hash>>``: all windows of a row with hashed words ``h``, of the lengths that items have."""
        return F.concat(
            F.expr("array(struct(-1 as at, 0 as length, cast(null as bigint) as hash))"),  # a row for the document itself
            *[
                F.expr(
                    f"transform(if(size(h) < {n}, array(), sequence(0, size(h) - {n})),"
                    f" i -> struct(i as at, {n} as length, {hash_sql(n)} as hash))"
                )
                for n in sorted(self.lengths)
            ],
        )


def hashed(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``w`` and ``h``: the words of a text and their hashes."""
    return docs.select(*keep, words(F.col(text)).alias("w")).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))


def hits(docs: DataFrame, benchmark: BenchmarkWindows, text: str = "text", **keep: Column) -> DataFrame:
    """The columns ``keep`` with ``n_words, at, length, item_id``: a row per verified hit and item, and one of nulls per document."""
    read = hashed(docs, text, *[c.alias(name) for name, c in keep.items()]).withColumn("n_words", F.size("w").cast("long"))
    # the words stay with the exploded rows but are only copied where a row leaves the join
    rows = read.select(*keep, "n_words", "w", F.explode(benchmark.windows()).alias("f")).select(*keep, "n_words", "w", "f.at", "f.length", "f.hash")
    for k in range(benchmark.parts):
        rows = rows.join(F.broadcast(benchmark.part(k)), F.col("hash") == F.col(f"hash{k}"), "left")
    parts = range(benchmark.parts)
    found = rows.withColumn("window", F.coalesce(*[f"window{k}" for k in parts])).withColumn("item_id", F.coalesce(*[f"item{k}" for k in parts]))
    found = found.filter((F.col("at") < 0) | F.col("window").isNotNull())
    own_words = F.array_join(F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("length")), " ")
    found = found.filter((F.col("at") < 0) | (own_words == F.col("window")))
    hit = F.col("at") >= 0
    return found.select(*keep, "n_words", F.when(hit, F.col("at")).alias("at"), F.when(hit, F.col("length")).alias("length"), "item_id")


def contamination(docs: DataFrame, benchmark: BenchmarkWindows, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans`` of every document; spans: (first word, words) hit."""
    found = hits(docs, benchmark, text, _row=F.monotonically_increasing_id(), doc_id=F.col(doc_id).cast("long"))
    span = F.when(F.col("at").isNotNull(), F.struct("at", "length"))
    summed = found.groupBy("_row", "doc_id", "n_words").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set(span)).alias("spans")
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    return summed.select(
        "doc_id",
        "n_words",
        F.size(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def text_key(text: str) -> Column:
    """A text by 96 bits of hash."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def whole_rows(docs: DataFrame, text: str) -> DataFrame:
    """``d, k``: all columns of a row in one, so that no name clashes, and the key of its text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), text_key(text).alias("k"))


def without_hits(docs: DataFrame, benchmark: BenchmarkWindows, text: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, all their columns kept."""
    if not benchmark.lengths:
        return docs
    found = hits(docs, benchmark, text, k=text_key(text)).filter(F.col("at").isNotNull()).select("k").distinct()
    kept = whole_rows(docs, text).join(found, "k", "left_anti")
    return kept.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: BenchmarkWindows, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``: the words outside all hits, lower-cased and joined by spaces, where there are hits; other texts unchanged."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not benchmark.lengths:
        return read
    found = hits(read, benchmark, "text", k=text_key("text")).filter(F.col("at").isNotNull())
    spans = found.groupBy("k").agg(F.collect_set(F.struct("at", "length")).alias("f"))  # at most one per word and length of the text
    joined = read.withColumn("k", text_key("text")).join(spans, "k", "left").withColumn("w", words(F.col("text")))
    covered = F.flatten(F.transform("f", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    positions = F.array_except(F.sequence(F.lit(0), F.size("w") - 1), covered)
    kept = F.transform(positions, lambda i: F.get("w", i))
    return joined.select("doc_id", F.when(F.col("f").isNotNull(), F.array_join(kept, " ")).otherwise(F.col("text")).alias("text"))
