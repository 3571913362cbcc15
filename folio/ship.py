"""Readies a session: the package on its executors, and Arrow batches that suit whole documents."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Applications that have it.
SHIPPED: set[str] = set()
#: Rows of an Arrow batch where the session has Spark's default, which suits numbers rather than texts of some kilobytes.
BATCH_ROWS, DEFAULT_ROWS = "2000", "10000"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Once for an application: a zip of the package's sources, served by the driver to every Python worker."""
    if spark.conf.get(BATCH, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    context = spark.sparkContext
    if context.applicationId in SHIPPED:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="folio_code_")
    path = os.path.join(folder, "folio_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"{top.name}/{f.relative_to(top)}")
    context.addPyFile(path)
    SHIPPED.add(context.applicationId)
