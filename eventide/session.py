"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "eventide", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and UTC; partition counts are left to the cluster."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
