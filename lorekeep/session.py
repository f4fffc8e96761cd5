"""A session as the engine expects it: UTC, and adaptive plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **config: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName("lorekeep").config(map=settings | {k.replace("__", "."): v for k, v in config.items()})
    return (builder.master(master) if master else builder).getOrCreate()
