"""URL filters: rules first, then path templates learnt per host from labelled pages.

A path is a list of segments; runs of digits in them read `#`. Per host the segments form a tree that
is generalised from the root down, one level at a time, on counts of (host, masked path), never on
pages:

- variable: under a node with more than ``many`` children, those with less than ``share`` of its
  pages are one wildcard `*`;
- similar: children whose share of bad labels doesn't differ from their node's by ``z`` standard
  errors are merged into `*` too, so what stays apart is frequent and tells labels.

Segments after ``depth`` are one tail `**`. A template is rejected if its purity, the share of good
labels smoothed by ``weight`` labels of the overall share, is below ``least``. A page without a
rule has the verdict of its template; templates without labels have the overall share.

Null urls and urls without `://` have an empty host and path, no rule, and the verdict of the empty
template. Without labels every template is allowed. Several labels of one page count as bad if one does.
Repeated pages give repeated rows, empty tables empty ones. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausespark.session import cut_lineage

#: Host, path prefix, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(prefix))
        found = F.when(fits, F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def masked(path: Column) -> Column:
    """Segments of a path, digits masked."""
    inner = F.regexp_replace(path, "^/", "")
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(inner, "[0-9]+", "#"), "/"))


def templates(counts: DataFrame, many: int = 20, share: float = 0.05, z: float = 3.0, depth: int = 8) -> DataFrame:
    """``counts`` (host, mask, n, labelled, bad) with the column ``template``."""
    deepest = counts.agg(F.max(F.size("mask"))).first()[0] or 0
    tree = counts.withColumn("template", F.lit(""))
    for level in range(min(depth, deepest)):
        segment = F.get("mask", F.lit(level))
        here = tree.filter(segment.isNotNull()).groupBy("host", "template", segment.alias("segment"))
        children = cut_lineage(here.agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]))
        totals = [F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad")]
        nodes = cut_lineage(children.groupBy("host", "template").agg(F.count("*").alias("children"), *totals))
        both = children.join(nodes, ["host", "template"])
        rate = (F.col("all_bad") + 0.5) / (F.col("all_labelled") + 1)
        distance = F.abs(F.col("bad") - F.col("labelled") * rate)
        similar = distance < z * F.sqrt(F.col("labelled") * rate * (1 - rate)) + 1e-9
        rare = (F.col("children") > many) & (F.col("n") < share * F.col("all_n"))
        only = F.col("children") == 1
        kept = F.when(~rare & (only | (F.col("labelled") == 0) & (F.col("children") <= many) | (F.col("labelled") > 0) & ~similar), F.col("segment"))
        named = cut_lineage(both.select("host", F.col("template").alias("_node"), F.col("segment").alias("_segment"), F.coalesce(kept, F.lit("*")).alias("_token")))
        tree = tree.join(
            named.withColumnRenamed("host", "_host"),
            (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_node")) & (segment == F.col("_segment")),
            "left",
        )
        grown = F.when(F.col("_token").isNotNull(), F.concat("template", F.lit("/"), "_token")).otherwise(F.col("template"))
        tree = cut_lineage(tree.withColumn("template", grown).select(*counts.columns, "template"))
    tail = F.when(F.size("mask") > depth, F.concat("template", F.lit("/**"))).otherwise(F.col("template"))
    return tree.withColumn("template", tail)


def judge(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]],
    page_id: str = "page_id",
    url: str = "url",
    label_id: str = "doc_id",
    good: str = "quality",
    least: float = 0.7,
    weight: float = 10.0,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every page.

    A page's label is that of the document whose number is the first one in its path.
    """
    host, path = host_and_path(F.col(url))
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    read = read.withColumn("mask", masked(F.col("path")))
    number = F.expr("try_cast(nullif(regexp_extract(path, '(?:^|/)([0-9]{1,18})(?:[^0-9]|$)', 1), '') as bigint)")
    bad = labels.filter(F.col(good).isNotNull()).groupBy(F.col(label_id).cast("long").alias("label_id"))
    bad = bad.agg(F.max((F.col(good) == 0).cast("int")).alias("bad"))
    linked = read.select("host", "mask", number.alias("label_id")).filter("label_id is not null").join(bad, "label_id")
    told = linked.groupBy("host", "mask").agg(F.count("*").alias("labelled"), F.sum("bad").alias("bad"))
    counts = read.groupBy("host", "mask").agg(F.count("*").alias("n")).join(told, ["host", "mask"], "left")
    counts = cut_lineage(counts.fillna(0, ["labelled", "bad"]))
    tree = cut_lineage(templates(counts))
    whole = tree.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    overall = 1 - whole["bad"] / whole["labelled"] if whole["labelled"] else 1.0
    purity = (F.col("labelled") - F.col("bad") + weight * overall) / (F.col("labelled") + weight)
    pure = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    pure = cut_lineage(pure.select("host", "template", purity.alias("purity")))
    known = tree.select("host", "mask", "template").join(pure, ["host", "template"])
    known = cut_lineage(known.select(F.col("host").alias("_host"), F.col("mask").alias("_mask"), "template", "purity"))
    judged = read.join(known, (F.col("host") == F.col("_host")) & (F.col("mask") == F.col("_mask")))
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("purity") < least, "block").otherwise("allow")
    return judged.withColumn("_rule", rule).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learnt).alias("verdict"), "template", "purity"
    )
