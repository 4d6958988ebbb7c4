"""Sending the package to the Python workers of a session, so that they need no installation."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package as an archive, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.mkdtemp(prefix="dossier-"), "dossier")
    context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), os.path.basename(package)))
    _SENT.add(context.applicationId)
