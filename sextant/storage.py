"""Tables written to the cluster's shared folder, used to cut lineage so that a lost executor costs one re-read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a folder of our own that goes when Python ends, but only
    if the session runs in one process; on a cluster other machines would not see it, so there it is a ValueError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = context.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-sextant-", dir="/tmp")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        folder = _own[app]
    return folder.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the plan above starts from files."""
    path = f"{shared_folder(df.sparkSession)}/sextant-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sextant_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that nothing will read any more, such as an iteration's former state."""
    path = getattr(df, "_sextant_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
