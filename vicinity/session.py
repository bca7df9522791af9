"""Session settings that the engine is meant to run with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
