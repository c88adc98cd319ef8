"""SparkSession factory used by tests, benchmarks and ad-hoc runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "lodestone", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow; on a cluster, build your own and pass it in."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
