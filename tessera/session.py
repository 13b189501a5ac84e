"""The Spark session that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Strict arithmetic and casts: division by zero, overflow and malformed text raise.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # TIMESTAMP of the dialect has no time zone.
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "false",
}


def build_session(name: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; the cluster's own settings decide sizes and partitions."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_ansi(spark: SparkSession) -> None:
    """Statements rely on strict errors, so a session that switched them off is set back."""
    if spark.conf.get("spark.sql.ansi.enabled") != "true":
        spark.conf.set("spark.sql.ansi.enabled", "true")
