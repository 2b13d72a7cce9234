"""Make this library importable in Python workers that weren't started with it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the library to the executors, once a Spark context.

    Rows here are whole texts: a session that leaves the size of Arrow batches
    at Spark's 10,000 rows gets 2,000, a fifth of the memory a Python worker.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "2000")
    if getattr(sc, "_textloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(path))
    sc._textloom_shipped = True
