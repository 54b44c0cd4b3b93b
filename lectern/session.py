"""Session factory used by tests, the benchmark and local runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "lectern", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings every operator expects: UTC, AQE on, few shuffle partitions.

    On a cluster the session comes from the caller; nothing in the library depends on this function.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LECTERN_DRIVER_MEMORY", "8g"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
