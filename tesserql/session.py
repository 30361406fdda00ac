"""Sessions with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(app: str = "tesserql", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    return builder.config(map=SETTINGS | settings).getOrCreate()
