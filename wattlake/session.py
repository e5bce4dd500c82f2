"""Session construction with the settings every job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "wattlake", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session.

    Shuffle width is left to the cluster; adaptive execution coalesces small partitions, splits skewed joins
    and turns a join into a broadcast only when the measured side is below the size threshold.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
