"""This package on Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, so that Python workers need no path to it."""
    context = spark.sparkContext
    if getattr(context, "_lorekeep_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else it was shipped itself
        archive = Path(tempfile.mkdtemp(prefix="lorekeep-")) / "lorekeep.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
    context._lorekeep_shipped = True
