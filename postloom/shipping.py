"""Ships this package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Workers import what functions sent to them refer to; once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_postloom_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="postloom-")) / "postloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, file.relative_to(top.parent))
    context.addPyFile(str(target))
    context._postloom_shipped = True
