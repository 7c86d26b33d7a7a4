"""Sends the package to the executors, whose Python need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

from leafmill.storage import package_files

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per Spark application: a zip of this package, added as a Python file."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = package_files()
    path = os.path.join(tempfile.mkdtemp(prefix="leafmill-code-"), "leafmill_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, subfolders, files in os.walk(os.path.join(root, "leafmill")):
            subfolders[:] = sorted(d for d in subfolders if d != "__pycache__")
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)  # the driver serves it; every executor fetches it before its first task
    _SENT.add(app)
