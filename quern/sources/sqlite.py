"""A Python data source over tables of SQLite files, and the tool calls of agent sessions kept in one.

format("sqlite_table") takes the options path (a file that all executors see), table, partitions (ranges of rowid, 8 by
default) and where (a JSON list of [column, operator, value], all of which must hold), which each range's query applies.
Conditions are given when a table is loaded: the filters that Spark 4.1 pushes into a Python source by itself stay with the
loaded table, so a frame that was filtered once would stay filtered.  Files are opened read-only.  An empty table gives one
empty partition; rowids may have gaps; a table without rowid is read as one partition; NULLs stay null; a value that doesn't
fit its column's declared type is an error.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

KINDS = [("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double")]
OPERATORS = {"=": "{0} = ?", "<>": "{0} <> ?", ">": "{0} > ?", ">=": "{0} >= ?", "<": "{0} < ?", "<=": "{0} <= ?", "starts": "substr({0}, 1, length(?)) = ?", "in": None, "null": "{0} IS NULL", "not null": "{0} IS NOT NULL"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)


def condition(column: str, operator: str, value=None) -> tuple[str, list]:
    """One condition as SQL with parameters."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator}")
    if operator == "in":
        return f"{quoted(column)} IN ({', '.join('?' * len(value))})", list(value)
    sql = OPERATORS[operator].format(quoted(column))
    return sql, [value] * sql.count("?")


@dataclass
class Range(D.InputPartition):
    low: int | None
    high: int | None

    def __post_init__(self) -> None:
        super().__init__(None)


class Reader(D.DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, columns: list[tuple[str, str]], where: list):
        self.path, self.table, self.parts, self.columns = path, table, parts, columns
        self.where = [condition(*c) for c in where]

    def partitions(self) -> list[D.InputPartition]:
        with opened(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [Range(None, None)]
        if low is None:
            return [Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        clauses = list(self.where) + ([("rowid BETWEEN ? AND ?", [partition.low, partition.high])] if partition.low is not None else [])
        where = " WHERE " + " AND ".join(f"({sql})" for sql, _ in clauses) if clauses else ""
        names = ", ".join(quoted(n) for n, _ in self.columns)
        with opened(self.path) as db:
            yield from db.execute(f"SELECT {names} FROM {quoted(self.table)}{where}", [v for _, values in clauses for v in values])


class SQLiteTable(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def columns(self) -> list[tuple[str, str]]:
        with opened(self.options["path"]) as db:
            rows = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not rows:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return [(name, next((kind for part, kind in KINDS if part in (declared or "").upper()), "string")) for _, name, declared, *_ in rows]

    def schema(self) -> str:
        return ", ".join(f"`{n}` {kind}" for n, kind in self.columns())

    def reader(self, schema) -> D.DataSourceReader:
        return Reader(self.options["path"], self.options["table"], int(self.options.get("partitions", 8)), self.columns(), json.loads(self.options.get("where", "[]")))


def table(spark: SparkSession, path: str, name: str, partitions: int = 8, where: list[tuple] | None = None) -> DataFrame:
    """A table's rows; where: (column, operator, value) that must all hold, operators as in OPERATORS."""
    spark.dataSource.register(SQLiteTable)
    return spark.read.format("sqlite_table").option("path", path).option("table", name).option("partitions", partitions).option("where", json.dumps(where or [])).load()


_CALLS = "array<struct<id: string, name: string, arguments: string, function: struct<name: string, arguments: string>>>"


def tool_calls(messages: DataFrame) -> DataFrame:
    """(session_id, user_turn, seq, tool_call_id, name, arguments, result): each call of an assistant's message with its result.

    messages: session_id, seq, role, content, tool_calls (JSON), tool_call_id.  Calls before any user turn have turn 0; a
    tool_calls that is no JSON list has none; of several results of a call the last by seq counts; a call without id has none.
    """
    from quern.operators.evaluation import turn_groups

    t = turn_groups(messages)
    calls = t.where("role = 'assistant'").select("session_id", "user_turn", "seq", F.posexplode(F.from_json("tool_calls", _CALLS)).alias("place", "c"))
    calls = calls.select("session_id", "user_turn", "seq", "place", F.col("c.id").alias("tool_call_id"), F.coalesce("c.name", "c.function.name").alias("name"), F.coalesce("c.arguments", "c.function.arguments").alias("arguments"))
    results = messages.where("role = 'tool' and tool_call_id is not null").groupBy("session_id", "tool_call_id").agg(F.max_by("content", "seq").alias("result"))
    return calls.join(results, ["session_id", "tool_call_id"], "left").select("session_id", "user_turn", "seq", "place", "tool_call_id", "name", "arguments", "result")
