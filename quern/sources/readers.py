"""Readers of documents, JSON lines, pinned bytes, linked notes and event logs.

Defined cases: an empty folder gives no rows, a missing path is an error of Spark's; null contents have null digests; files are read
whole, whatever their length; repeated names stay apart by their paths; extra columns of rows that are passed in are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X
from quern.functions.scratch import open_fs
from quern.operators import core
from quern.operators.evaluation import turn_groups

MOST_BYTES = 32 << 20


def json_objects(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a file; a file that isn't one fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, audit: bool = False) -> DataFrame:
    """Blank lines are skipped.  audit keeps bad lines, with their file, in _corrupt_record."""
    if not audit:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").json(path).withColumn("source_file", F.col("_metadata.file_path"))


def folder(spark: SparkSession, path: str, pattern: str = "*.json", leave_out: str | None = "manifest.json") -> DataFrame:
    """path and content of every file below, but those of one name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    rows = rows if leave_out is None else rows.where(F.col("_metadata.file_name") != leave_out)
    return rows.select("path", "length", "content")


def snapshots(files: DataFrame) -> DataFrame:
    """Digests and the parsed body of the same bytes."""
    text = F.decode("content", "UTF-8")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), X.git_blob_sha1(F.col("content")).alias("git_sha1"), text.alias("text"), F.try_parse_json(text).alias("body"))


def pin_violations(files: DataFrame, pins: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, rule) where a pinned file (path, length, sha256, git_sha1) is missing, too large or different."""
    own = files.select("path", F.col("length").alias("n"), F.sha2("content", 256).alias("h"), X.git_blob_sha1(F.col("content")).alias("g"))
    both = pins.join(own, "path", "full")
    rules = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "MISSING"), F.when(F.col("length").isNull(), "EXTRA"), F.when(F.col("n") > most, "TOO_LARGE"), F.when(F.col("n") != F.col("length"), "LENGTH"),
        F.when(F.col("h") != F.col("sha256"), "SHA256"), F.when(F.col("g") != F.col("git_sha1"), "GIT_SHA1"),
    ))
    return both.select("path", F.explode(rules).alias("rule"))


def family_cases(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """Cases of family manifests (path, body as text) with the files at their relative paths; missing files are null."""
    kind = "struct<family_id: string, status: string, cases: array<struct<case_id: string, variant_type: string, split: string, path: string>>>"
    m = manifests.select(F.regexp_replace("path", "[^/]*$", "").alias("base"), F.from_json("text", kind).alias("m"))
    c = m.select("base", "m.family_id", "m.status", F.explode("m.cases").alias("c")).select("family_id", "status", "c.case_id", "c.variant_type", "c.split", F.concat("base", F.col("c.path")).alias("path"))
    return c.join(files.select("path", F.decode("content", "UTF-8").alias("case_json")), "path", "left")


def notes(spark: SparkSession, path: str, skip: str = r"/(\.|templates|reports)[^/]*/") -> DataFrame:
    """Markdown notes: name, front matter as a map, body, links to other notes by base name."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    rows = rows.withColumn("path", F.col("_metadata.file_path")).where(~F.col("path").rlike(skip))
    head = F.regexp_extract("value", r"^---\n([\s\S]*?)\n---\n?([\s\S]*)$", 1)
    body = F.when(F.col("value").rlike(r"^---\n"), F.regexp_extract("value", r"^---\n([\s\S]*?)\n---\n?([\s\S]*)$", 2)).otherwise(F.col("value"))
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[^\s:][^:]*:"))
    fields = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", "")))))
    links = F.array_distinct(F.transform(F.regexp_extract_all("value", F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), lambda x: F.regexp_replace(F.trim(x), r"^.*/", "")))
    return rows.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("name"), fields.alias("fields"), body.alias("body"), links.alias("links"))


def note_edges(rows: DataFrame) -> DataFrame:
    """(a, b) links and backlinks between notes that exist."""
    e = rows.select(F.col("name").alias("a"), F.explode("links").alias("b"))
    return core.both_ways(e.join(rows.select(F.col("name").alias("b")), "b", "left_semi").select("a", "b").where("a <> b"), "a", "b")


def markdown_sections(rows: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """(name, number, heading, text) of each section; text before a first heading has a null heading."""
    parts = rows.select(name, F.posexplode(F.split(F.col(body), r"(?m)^(?=#{1,6} )")).alias("number", "part")).where(F.trim("part") != "")
    heading = F.nullif(F.regexp_extract("part", r"^#{1,6} +(.*)", 1), F.lit(""))
    return parts.select(name, "number", heading.alias("heading"), F.regexp_replace(F.regexp_replace("part", r"^#{1,6} .*\n?", ""), r"^\s+|\s+$", "").alias("text"))


def event_log(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Last session meta, token count and completion of each run's log (run, line_no, type, payload)."""
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("payload")), F.when(F.col("type") == kind, F.col("line_no")))
    return rows.groupBy(run).agg(last("session_meta").alias("meta"), last("token_count").alias("tokens"), last("task_complete").alias("completion"), F.count(F.lit(1)).alias("events"))


def xml_sections(spark: SparkSession, path: str, row_tag: str = "section") -> DataFrame:
    """Title and text of each section of label documents."""
    return spark.read.format("xml").option("rowTag", row_tag).schema("title string, text string").load(path)


def relation_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of an ingest file {entities: [{name, type}], relations: [{subject, predicate, object}]}.

    JSON is read by Spark; YAML, if its parser is installed, on the driver (an ingest file is written by hand).
    """
    if path.endswith((".yaml", ".yml")):
        import yaml

        fs, local = open_fs(path if ":" in path else f"file://{path}")
        with fs.open_input_stream(local) as f:
            body = yaml.safe_load(f.read().decode()) or {}
        e = [(x.get("name"), x.get("type")) for x in body.get("entities") or []]
        r = [(x.get("subject"), x.get("predicate"), x.get("object")) for x in body.get("relations") or []]
        return spark.createDataFrame(e, "name string, type string"), spark.createDataFrame(r, "subject string, predicate string, object string")
    one = json_objects(spark, path, "entities array<struct<name: string, type: string>>, relations array<struct<subject: string, predicate: string, object: string>>")
    return one.select(F.explode("entities").alias("x")).select("x.*"), one.select(F.explode("relations").alias("x")).select("x.*")


def session_turns(messages: DataFrame) -> DataFrame:
    """A row per user turn of agent sessions: its text, steps and tool results that follow it, in order of seq.

    messages: session_id, seq, role, content, tool_call_id.  Messages before any user turn are turn 0.
    """
    t = turn_groups(messages)
    calls = F.collect_list(F.when(F.col("role") == "assistant", F.struct("seq", "content", "tool_call_id")))
    results = F.collect_list(F.when(F.col("role") == "tool", F.struct("seq", "content", "tool_call_id")))
    return t.groupBy("session_id", "user_turn").agg(F.max(F.when(F.col("role") == "user", F.col("content"))).alias("text"), F.array_sort(calls).alias("steps"), F.array_sort(results).alias("results"))
