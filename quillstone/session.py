"""A Spark session with the settings that this library counts on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "quillstone", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; on a cluster, sizes come from its own defaults."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if (master or os.environ.get("SPARK_MASTER", "")).startswith("local"):
        builder = builder.config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
