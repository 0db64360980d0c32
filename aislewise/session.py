"""Spark session settings used by the tests, the bench and command-line runs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session. On a cluster the caller brings its own session and nothing here applies."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("aislewise")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
