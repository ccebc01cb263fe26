"""SparkSession factory with the settings that the operators rely on."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session's application, once, so that they can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="siltstone-"), "siltstone"), "zip", root, "siltstone")
        spark.sparkContext.addPyFile(made)
        _shipped.add(app)


def session(name: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """UTC clock, ANSI casts, AQE with skew handling; anything in `conf` (dots as `__`) wins."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
