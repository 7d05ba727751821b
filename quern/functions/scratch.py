"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own if driver and tasks share one machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
        _made.append(where)
    return where if "://" in where or where.startswith("file:") else "file://" + where


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator.  It is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a URI, and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _forget() -> None:
    for uri in reversed(_made):
        try:
            fs, path = open_fs(uri)
            fs.delete_dir(path)
        except OSError:  # never written, or gone already
            pass


atexit.register(_forget)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
