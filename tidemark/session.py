"""A session with the settings that the engine's exactness rests on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",  # nanoseconds stay exact integers
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("tidemark")
    for key, value in (SETTINGS | conf).items():
        builder = builder.config(key, value)
    return (builder.master(master) if master else builder).getOrCreate()
