"""Sends this package to the executors, so that Python workers find it wherever Spark runs."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: adds the package as a zip file to the workers' path."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        copy = os.path.join(folder, "package")
        shutil.copytree(here, os.path.join(copy, os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
        kept = os.path.join(tempfile.mkdtemp(prefix="varstrata-"), "varstrata.zip")
        shutil.make_archive(kept[:-4], "zip", copy)
    spark.sparkContext.addPyFile(kept)
    _sent.add(app)
