"""A session with the settings the operators assume; everything else is the cluster's."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidewatch", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**base, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
