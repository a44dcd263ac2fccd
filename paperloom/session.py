"""A session with the settings the engine is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "paperloom", **settings: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    } | settings
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
