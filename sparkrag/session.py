"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; further settings by name, dots as double underscores."""
    builder = SparkSession.builder.master(master) if master else SparkSession.builder
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
