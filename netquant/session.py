"""Session builder for tests, benches and notebooks; clusters bring their own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "netquant", cpus: int | str = "*", driver_memory: str = "16g") -> SparkSession:
    """A local session with the settings the library expects from a cluster as well."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
