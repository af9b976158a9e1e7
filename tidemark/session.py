"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What the engine's results depend on (UTC) and what its plans profit from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "tidemark", **settings: str) -> SparkSession:
    """A session with the engine's settings; an existing session is reused and only given what is missing."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
