"""Dense feature tables: grouping of feature names and train-fitted standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.fixed.patterns import FEATURE_GROUPS


def feature_groups(spark: SparkSession, features: Sequence[str]) -> DataFrame:
    """(feature, grp) for every group one of whose name fragments occurs in the feature name."""
    rows = [(f, g) for g, parts in FEATURE_GROUPS.items() for f in features if any(p in f for p in parts)]
    return spark.createDataFrame(rows, "feature string, grp string")


#: Steps of the grid on which moments are summed.
MOMENT_STEPS = 1_000_000


def standardize(df: DataFrame, features: Sequence[str], fit_on: Column) -> DataFrame:
    """z-scores with mean and population deviation of the rows where ``fit_on`` holds; a constant feature keeps scale 1.

    Moments are sums of whole numbers, values and squares on a grid of ``1 / MOMENT_STEPS``, so they don't depend on the order
    of rows or on partitions. They are one row, read by a scalar subquery.
    """
    on_grid = {f: F.floor(F.col(f).cast("double") * MOMENT_STEPS + 0.5).cast("decimal(18,0)") for f in features}
    sums = [F.count("*").cast("double").alias("n")]
    sums += [F.sum(x).cast("double").alias(f"s_{f}") for f, x in on_grid.items()]
    sums += [F.sum((x * x).cast("decimal(38,0)")).cast("double").alias(f"q_{f}") for f, x in on_grid.items()]
    moments = df.where(fit_on).agg(*sums).select(F.struct("*").alias("m")).scalar()
    own = [c for c in df.columns if c not in features]
    joined = df.select(F.struct(*own).alias("own"), *[F.col(f).cast("double").alias(f) for f in features], moments.alias("m"))
    m = F.col("m")
    scaled = []
    for f in features:
        mean = m[f"s_{f}"] / m["n"]
        variance = m[f"q_{f}"] / m["n"] - mean * mean
        scale = F.when(variance > 0, F.sqrt(variance) / MOMENT_STEPS).otherwise(1.0)
        scaled.append(((F.col(f) - mean / MOMENT_STEPS) / scale).alias(f))
    return joined.select(*[F.col("own")[c].alias(c) for c in own], *scaled)
