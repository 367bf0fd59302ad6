"""A session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tidelight", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a running one is used as it is.

    The master, memory and number of shuffle partitions belong to the
    deployment (``spark-submit``); locally they come from ``BENCH_CPUS``.
    """
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        cpus = os.environ.get("BENCH_CPUS", "8")
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
