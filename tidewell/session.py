"""Session builder with the settings every operator assumes."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "tidewell", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides (dots as ``__``)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
