"""A session with the settings the operators are meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Times are UTC throughout; adaptive execution splits skewed joins and merges small partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(name: str = "lodeplan", **settings: str) -> SparkSession:
    """A session; ``settings`` are added, with ``__`` for dots (``spark__master="local[8]"``)."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
