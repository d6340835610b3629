"""Session builder with the settings the engine is planned for, and the package for its executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; Spark hands it to those that start later too."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lectern-"), "lectern.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("lectern", os.path.relpath(full, top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def session(name: str = "lectern", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow; ``conf`` overrides (dots as double underscores)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.appName(name).config(map=settings).getOrCreate()
    ship(spark)
    return spark
