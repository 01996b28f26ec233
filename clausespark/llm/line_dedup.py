"""Line dedup by distinct-site spread: lines that many sites share are boilerplate.

Everything is DataFrame expressions. Per line hash, HyperLogLog sketches of the sites are merged by
aggregation, partly inside each task, so a line that a third of all documents holds never gathers in
one place. Lines whose estimate is near the threshold get an exact distinct count, which alone
decides for them. A boilerplate line stays where it occurs first (smallest document id, then
position) and goes everywhere else; a line is known by 96 bits of hash.

Blank lines are never boilerplate. Null texts have no lines and stay null; empty ones stay empty.
Null sites are not counted. Rows without an id neither count nor lose lines. Repeated rows lose the
same lines; of lines repeated inside the first document only the first stays. Empty tables give empty
ones. Columns other than the three named are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.session import cut_lineage

#: Logarithm of the number of registers of a sketch; its relative error is about 1.04 / sqrt(2**LG_K).
LG_K = 12


def line_rows(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """``doc_id, key, site, at, h1, h2`` of every line that isn't blank; key: the hash of the whole text."""
    read = docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(site).cast("string").alias("site"),
        F.posexplode(F.split(text, "\n")).alias("at", "line"),
    )
    return read.filter(F.trim("line") != "").select("doc_id", "key", "site", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """``h1, h2, first``: lines on at least ``min_sites`` distinct sites and where each occurs first."""
    margin = 4 * 1.04 / 2 ** (LG_K / 2) * min_sites + 1
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate")
    spread = lines.groupBy("h1", "h2").agg(estimate, F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("first"))
    spread = cut_lineage(spread.filter((F.col("n") >= min_sites) & (F.col("estimate") > min_sites - margin)))
    near = spread.filter(F.col("estimate") <= min_sites + margin)
    counted = lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"))
    decided = near.join(counted, ["h1", "h2"]).filter(F.col("sites") >= min_sites)
    sure = spread.filter(F.col("estimate") > min_sites + margin)
    return cut_lineage(sure.select("h1", "h2", "first").union(decided.select("h1", "h2", "first")))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each behind as many more underscores as it takes to differ from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def dedup_lines(
    docs: DataFrame, min_sites: int = 8, doc_id: str = "doc_id", text: str = "text", site: str = "source"
) -> DataFrame:
    """All rows and columns of ``docs`` with the text after removal, and the numbers of its lines and of removed ones, under the
    ``free_names`` of ``_n_lines`` and ``_n_removed``."""
    lines = line_rows(docs, doc_id, text, site)
    found = boilerplate(lines, min_sites)
    goes = lines.join(found, ["h1", "h2"]).filter(F.struct("doc_id", "at") != F.col("first"))
    cut = goes.groupBy(F.col("doc_id").alias("cut_id"), F.col("key").alias("cut_key")).agg(F.collect_set("at").alias("cut"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(doc_id).cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"))
    joined = whole.join(cut, (F.col("own_id") == F.col("cut_id")) & (F.col("own_key") == F.col("cut_key")), "left")
    own = F.col("d").getField(text)
    joined = joined.withColumn("lines", F.split(own, "\n"))
    kept = F.array_join(kept_lines(F.col("lines"), F.col("cut")), "\n")
    n_lines, n_removed = free_names(docs.columns, "_n_lines", "_n_removed")
    out = {c: F.col("d").getField(c) for c in docs.columns} | {
        text: F.when(F.col("cut").isNull(), own).otherwise(kept),
        n_lines: F.when(own.isNull(), 0).otherwise(F.size("lines")).cast("long"),
        n_removed: F.coalesce(F.size("cut"), F.lit(0)).cast("long"),
    }
    return joined.select(*[c.alias(name) for name, c in out.items()])


def kept_lines(lines: Column, cut: Column) -> Column:
    """The lines whose position isn't in ``cut``."""
    positions = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    return F.transform(positions, lambda i: F.get(lines, i))
