"""Exact running totals and ranks over ordered data that no single task could hold.

A window partitioned by clause would put every document of a clause into one task. Here the rows
are range-partitioned by (keys, order), each slice is summed on its own and the small table of
slice totals is turned into offsets. Slices are written once, so both branches see the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clausespark.session import cut_lineage


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    totals: dict[str, str],
    slices: int | None = None,
) -> DataFrame:
    """Add, per key and in order, the inclusive running sum of each source column.

    ``order`` must tell the rows of a key apart (group equal values first). ``totals`` maps a new
    column to the column it sums.
    """
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    cut = cut_lineage(cut.withColumn("_slice", F.spark_partition_id()))
    group = [*keys, "_slice"]

    sums = [F.sum(source).alias(f"_sum_{name}") for name, source in totals.items()]
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per slice and key boundary: slices + keys rows in all.
    offsets = cut.groupBy(*group).agg(*sums).select(
        *[F.col(c).alias(f"_key_{c}") for c in group],
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in totals],
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", *[F.sum(source).over(inside).alias(name) for name, source in totals.items()])
    matched = F.lit(True)
    for c in group:
        matched = matched & (local[c] == offsets[f"_key_{c}"])
    joined = local.join(F.broadcast(offsets), matched)
    return joined.select(
        *df.columns,
        *[(F.col(name) + F.col(f"_off_{name}")).alias(name) for name in totals],
    )


def global_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Row number per key (or over everything with no key), counted from 1."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    if keys:
        return running_totals(one, keys, order, {name: "_one"}).drop("_one")
    keyed = one.withColumn("_all", F.lit(0))
    return running_totals(keyed, ["_all"], order, {name: "_one"}).drop("_one", "_all")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per key from a value histogram, without holding a key in one task."""
    if not keys:
        keyed = df.withColumn("_all", F.lit(0))
        return exact_percentiles(keyed, ["_all"], value, shares).drop("_all")
    histogram = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_totals(histogram, keys, [F.col(value)], {"_upto": "_n"})
    totals = ranked.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    joined = ranked.join(F.broadcast(totals), list(keys))
    columns = []
    for name, share in shares.items():
        position = (F.col("_total") - 1) * F.lit(float(share))
        low = F.min(F.when(F.col("_upto") > F.floor(position), F.col(value)))
        high = F.min(F.when(F.col("_upto") > F.ceil(position), F.col(value)))
        part = F.max(position - F.floor(position))
        columns.append((low + (high - low) * part).cast("double").alias(name))
    return joined.groupBy(*keys).agg(*columns)
