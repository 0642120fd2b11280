"""The session: this package made importable in Python workers, wherever they run."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to all executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:  # on the driver: Spark serves the archive to executors from there
        copy = Path(folder) / "tree"
        shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(tempfile.mkdtemp(prefix="quarry-") + "/quarry", "zip", copy)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
