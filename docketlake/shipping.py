"""Sending this package to the executors, so that their Python workers can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship_package(spark: SparkSession) -> None:
    """Once per session; the archive holds code alone and Spark hands it out."""
    context = spark.sparkContext
    if getattr(context, "_docketlake_sent", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():
        to = Path(tempfile.mkdtemp()) / "docketlake_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(to))
    context._docketlake_sent = True
