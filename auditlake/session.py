"""Shipping of the package to Python workers, and what bounds their memory."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Bytes of a batch of rows that a Python worker gets, where the session leaves Spark's own limit (64 MB).
BATCH_BYTES, SPARK_BATCH_BYTES = 16 << 20, 64 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of spark, once per context, and bound their batches."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) in (str(SPARK_BATCH_BYTES), f"{SPARK_BATCH_BYTES}b"):
        spark.conf.set(limit, str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_auditlake_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="auditlake-ship-"))
    shutil.copytree(top, folder / "tree" / top.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / top.name), "zip", folder / "tree"))
    shutil.rmtree(folder / "tree")
    sc._auditlake_shipped = True
