"""Scoring of documents as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_arriving(
    spark: SparkSession, path: str, schema: StructType | str, file_format: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    """A stream over the files that appear under ``path``."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def analyze_stream(
    arriving: DataFrame,
    analyze: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score each micro-batch with a frozen model and write its records under ``out``.

    Scoring a document needs that document only, so no state and no watermark are kept. Each batch
    owns one folder that a repeated run overwrites, so a retried batch leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        analyze(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
