"""What a Spark session needs to run this package on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once a session.

    Python workers import task functions by name, and need not share the driver's folders."""
    context = spark.sparkContext
    here = os.path.dirname(os.path.abspath(__file__))
    if getattr(context, "_foliospark_shipped", False) or not os.path.isdir(here):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="foliospark-"), "foliospark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(here)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(target)
    context._foliospark_shipped = True
