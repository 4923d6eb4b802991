"""Makes this package importable in Spark's Python workers wherever the driver was started from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of rows that a worker is given at once; sessions that keep Spark's 64 MB, which is too much for long texts beside
#: a full heap, are set to this.
BATCH_BYTES = "4m"
_BATCH_SETTING, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def ship(spark: SparkSession) -> None:
    """Give the package's sources to the executors with ``addPyFile``, once per application, and bound Arrow's batches."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_SETTING).lower() in (f"{_SPARKS_OWN}b", str(_SPARKS_OWN), "64m", "64mb"):
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-sextant-"), "sextant_sources.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("sextant", os.path.relpath(full, package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
