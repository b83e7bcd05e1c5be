"""Sending a package's code to the executors, so that functions it defines can be run there by name."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path
from types import ModuleType

from pyspark.sql import SparkSession

import graticule

SHIPPED: set[tuple[str, str]] = set()  # application and package


def ship(spark: SparkSession, package: ModuleType = graticule) -> None:
    """Adds the package to the session's Python files, once. The driver serves the archive to executors as they start, so
    it stays until the driver ends."""
    context = spark.sparkContext
    sent = (context.applicationId, package.__name__)
    if sent in SHIPPED:
        return
    root = Path(package.__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="graticule-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(root, Path(folder, "code", package.__name__), ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
    context.addPyFile(shutil.make_archive(str(Path(folder, f"{package.__name__}-code")), "zip", Path(folder, "code")))
    SHIPPED.add(sent)
