"""Gives the executors the package, where they don't have it by their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Add the package's modules to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_vellumark", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="vellumark-"), "vellumark.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(ROOT, "vellumark")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    context._vellumark = True
