"""Session with settings that hold from one machine to a large cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "folioforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; settings given by the caller or the cluster win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
