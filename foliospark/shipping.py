"""Sends this package to the executors' Python workers, which need not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_foliospark_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="foliospark"), "foliospark.zip")
    with zipfile.ZipFile(at, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("foliospark", os.path.relpath(path, home)))
    sc.addPyFile(at)
    sc._foliospark_shipped = True
