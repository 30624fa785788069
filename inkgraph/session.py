"""A session with the settings the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution on, UTC; ``partitions`` only for small local data."""
    b = SparkSession.builder.master(master).appName("inkgraph")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
