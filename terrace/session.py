"""Session construction for local runs, tests and benchmarks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "terrace", cpus: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with the settings that tests and the benchmark share; a cluster supplies its own."""
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
