"""Code for the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that functions can be pickled by reference."""
    sc = spark.sparkContext
    if getattr(sc, "_arbora_sent", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="arbora-send-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "arbora_engine.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(target)
    sc._arbora_sent = True
