"""Session factory: one place for the settings every query relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "glyphmill", cpus: int | str | None = None, partitions: int | None = None) -> SparkSession:
    """The running session, or a local one for tests and benchmarks.

    UTC everywhere, AQE on (partition coalescing and skew-join splitting), Arrow for
    the Python boundary. On a cluster the master comes from spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and SparkSession.getActiveSession() is None:
        builder = builder.master(f"local[{cpus or '*'}]").config("spark.driver.memory", "12g")
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
