"""The package's own modules on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, so that they import wherever the driver found them."""
    if getattr(spark, "_stratakv_sent", False):
        return
    spark._stratakv_sent = True
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="stratakv-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/stratakv.zip", "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, str(path.relative_to(top.parent)))
    spark.sparkContext.addPyFile(f"{folder}/stratakv.zip")
