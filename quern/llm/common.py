"""Row identity and tables; scratch tables of the shared folder are the library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scratch import open_fs, scratch, stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share a doc_id; fp is null for a null text.  Rows equal in both columns count as one document."""
    return F.struct(doc_id.alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("fp"))
