"""Gives the executors' Python workers this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

import parcelgrid

_SHIPPED: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once per application.

    Functions that run in Python workers are then pickled by name, so what a
    worker compiled for one task (tokenizer tables) serves its next tasks too.
    The archive is sent by Spark itself; no shared or local folder is assumed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(parcelgrid.__file__))
    folder = tempfile.mkdtemp(prefix="parcelgrid-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "parcelgrid_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED[context.applicationId] = archive
