"""A session with the settings the plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """Gets or makes a session. Adaptive execution splits skewed joins and merges small partitions;
    Arrow carries the few Python functions; times are UTC."""
    builder = SparkSession.builder.appName("evalstrata")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    fixed = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": os.environ.get("EVALSTRATA_UI", "false"),
    }
    return builder.config(map=fixed | settings).getOrCreate()
