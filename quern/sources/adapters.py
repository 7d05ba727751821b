"""A Python data source over recorded answers of public interfaces; nothing here reaches a network.

format("recorded") reads JSON lines of {adapter, query, status, fetched_at, body}, one partition a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions.scratch import open_fs

ADAPTERS = ("label", "approvals", "trial", "drug_name", "literature", "adverse_event")
SCHEMA = "adapter string, query string, status int, fetched_at string, body string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [x for x in options.get("paths", options.get("path", "")).split(",") if x]
        self.adapter = options.get("adapter")
        if self.adapter and self.adapter not in ADAPTERS:
            raise ValueError(f"unknown adapter {self.adapter}")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, path = open_fs(partition.path if "://" in partition.path or partition.path.startswith("file:") else f"file://{partition.path}")
        with fs.open_input_stream(path) as f:
            for line in f.read().decode().split("\n"):
                if line.strip():
                    r = json.loads(line)
                    if self.adapter is None or r["adapter"] == self.adapter:
                        yield r["adapter"], r["query"], r["status"], r["fetched_at"], json.dumps(r["body"], sort_keys=True)


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recorded)
