"""The package's code for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each Spark context. Spark copies the archive to every executor."""
    context = spark.sparkContext
    if getattr(context, "_trialstream_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="trialstream-"), "trialstream_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(_PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    context._trialstream_shipped = True
