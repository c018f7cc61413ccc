"""SparkSession factory with the settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "stratagraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on.

    ``master`` is left to spark-submit when it is not given; ``conf`` overrides any setting.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()
