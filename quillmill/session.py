"""A session with the settings this engine counts on. Jobs also run on any session they are given."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Shuffle partitions are cut by size at run time, and skewed ones split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches to Python are bounded by bytes as well as rows, whatever the length of the texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def session(master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("quillmill")
    builder = builder.master(master) if master else builder
    for k, v in (SETTINGS | (settings or {})).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
