"""A SparkSession with the settings that the engine's results and plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; shuffle partitions only where asked (local runs), else the cluster's."""
    b = SparkSession.builder.appName("tallyloom")
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
