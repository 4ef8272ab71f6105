"""Sending this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors, once per session."""
    spark = spark or SparkSession.active()
    context = spark.sparkContext
    if getattr(context, "_passagelab_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "passagelab_code.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for source in sorted(PACKAGE.rglob("*.py")):
            bundle.write(source, f"{PACKAGE.name}/{source.relative_to(PACKAGE)}")
    context.addPyFile(str(target))
    context._passagelab_shipped = True


