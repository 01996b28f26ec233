"""Risk levels and the clause dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark.fixed.taxonomy import CLAUSES, METADATA_CLAUSES, RISK_VERSIONS


def taxonomy_table(spark: SparkSession, version: str = "production") -> DataFrame:
    """(clause, ord, is_metadata, risk_level): 41 rows, safe to broadcast."""
    rows = [(c, i, c in METADATA_CLAUSES, level_of(c, version)) for i, c in enumerate(CLAUSES)]
    return spark.createDataFrame(rows, "clause string, ord int, is_metadata boolean, risk_level string")


def level_of(clause: str, version: str = "production") -> str:
    for level, clauses in RISK_VERSIONS[version].items():
        if clause in clauses:
            return level
    return "LOW"


def risk_level(clause: Column, version: str = "production", other: str = "LOW") -> Column:
    lists = RISK_VERSIONS[version]
    level = F.when(clause.isin(lists["HIGH"]), "HIGH").when(clause.isin(lists["MEDIUM"]), "MEDIUM")
    return level.otherwise(other)


def risk_versions(clauses: DataFrame) -> DataFrame:
    """(clause, version, level) of every clause in every version of the risk lists; names are compared without regard to case."""
    rows = [(v, level, c.lower()) for v, lists in RISK_VERSIONS.items() for level, listed in lists.items() for c in listed]
    known = clauses.sparkSession.createDataFrame(rows, "version string, level string, key string")
    every = clauses.select("clause", F.lower("clause").alias("key"), F.explode(F.array(*map(F.lit, RISK_VERSIONS))).alias("version"))
    found = every.join(F.broadcast(known), ["key", "version"], "left")
    return found.select("clause", "version", F.coalesce("level", F.lit("LOW")).alias("level"))


def is_high_risk(clause: Column, version: str = "production") -> Column:
    return clause.isin(RISK_VERSIONS[version]["HIGH"])


def clause_order(clause: Column) -> Column:
    """Position in the taxonomy, counted from 1; 0 for a name outside it."""
    return F.array_position(F.array(*[F.lit(c) for c in CLAUSES]), clause).cast("int")


def drop_metadata(labels: DataFrame) -> DataFrame:
    """Keep risk clauses only."""
    metadata = labels.sparkSession.createDataFrame([(c,) for c in METADATA_CLAUSES], "clause string")
    return labels.join(F.broadcast(metadata), "clause", "left_anti")
