"""Give Python workers this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of ``spark``, once per application.

    Functions that run in tasks refer to it by name, so workers need it unless it is installed on every node or the
    driver was started in its folder. Spark's own file distribution copies it to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in sorted(os.walk(here)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tidemark", os.path.relpath(full, here)))
    context.addPyFile(path)
    context._tidemark_shipped = True
