"""Sends this package to executors that don't have it, once for each Spark application."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Python workers import the package by name; wherever the driver runs, they find it."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="strata-package-")) / "strata_package.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(path))  # served by the driver
    _done.add(sc.applicationId)
