"""The library's code on every executor, for the functions that run there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
# Rows of a batch for Python: rows hold whole texts, so fewer than Spark's default.
BATCH_ROWS = "1000"
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Add the package to the job once per application; executors fetch it from the driver.

    Also keeps Spark's batches for Python small, unless the session sets their size.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == "10000":
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    name = str(Path(tempfile.mkdtemp(prefix="code-")).resolve() / "plumbline-code.zip")
    with zipfile.ZipFile(name, "w") as out:
        for file in sorted((root / "plumbline").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)
