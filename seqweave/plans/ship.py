"""Sends this package to the Python workers of a session's executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Once a context: workers may run where the package is not on the path."""
    context = spark.sparkContext
    if getattr(context, "_seqweave_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="seqweave-")) / "seqweave_package.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(at))
    context._seqweave_shipped = True
