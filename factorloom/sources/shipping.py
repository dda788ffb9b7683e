"""Make this package importable in Spark's Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the session's workers once, as Spark sends any Python file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    path = os.path.join(tempfile.mkdtemp(prefix="factorloom-"), "factorloom.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    context.addPyFile(path)


def shipped(query):
    """The query, run after its package is at the workers."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run
