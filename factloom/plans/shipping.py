"""Getting the package to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import factloom


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python workers can import it wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_factloom_sent", False):
        return
    root = os.path.dirname(os.path.abspath(factloom.__file__))
    if os.path.isdir(root):  # an installed archive is where workers find it
        archive = os.path.join(tempfile.mkdtemp(prefix="factloom-code-"), "factloom.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for name in sorted(files):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("factloom", os.path.relpath(path, root)))
        context.addPyFile(archive)
    context._factloom_sent = True
