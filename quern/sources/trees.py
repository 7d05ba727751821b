"""Nested documents as rows: sections of XML labels, and headings, lists and fenced fields of Markdown.

Each row names its parent, so depth and order stay.  XML is read as a stream, element by element; Markdown is split and
linked by built-in expressions and windows.  Null and empty contents give no rows; XML that can't be parsed gives one row with
its error; files with equal paths are one document in Markdown and are kept apart by their rows in XML; an empty table gives
an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SECTION = "path string, number int, parent int, depth int, version string, title string, text string, error string"
_KINDS = [("path", pa.string()), ("number", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("version", pa.string()), ("title", pa.string()), ("text", pa.string()), ("error", pa.string())]


def _plain(element: ET.Element) -> str:
    return " ".join(" ".join(element.itertext()).lower().split())


def sections_of(content: bytes, tag: str = "section", title: str = "title", text: str = "text", version: str = "versionNumber") -> list[tuple]:
    """(number, parent, depth, version, title, text) of nested sections in document order; number 0 is above the outermost."""
    open_: list[dict] = []
    done, stack, edition, count = [], [], None, 0
    for event, element in ET.iterparse(io.BytesIO(content), ("start", "end")):
        name = element.tag.rsplit("}", 1)[-1]
        if event == "start":
            stack.append(name)
            if name == version and edition is None:
                edition = element.get("value")
            if name == tag:
                count += 1
                open_.append({"number": count, "parent": open_[-1]["number"] if open_ else 0, "depth": len(open_) + 1, "title": None, "text": None})
            continue
        stack.pop()
        if open_ and stack and stack[-1] == tag and name in (title, text):
            kind = "title" if name == title else "text"
            if open_[-1][kind] is None:
                open_[-1][kind] = _plain(element)
        if name == tag:
            done.append(open_.pop())
            element.clear()  # a section's elements are needed no more
    kept = [s for s in sorted(done, key=lambda s: s["number"]) if s["title"] or s["text"]]
    return [(s["number"], s["parent"], s["depth"], edition, s["title"] or "", s["text"] or "") for s in kept]


def xml_tree(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, number, parent, depth, version, title, text, error) of the sections of XML files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"]):
                if not data.is_valid or not len(data.as_buffer()):
                    continue
                try:
                    rows = [(name, *s, None) for s in sections_of(data.as_py())]
                except ET.ParseError as e:
                    rows = [(name, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, _SECTION)


def lineage(tree: DataFrame, path: str = "path", most_depth: int = 32) -> DataFrame:
    """tree with `titles`: the titles from the outermost section to the row's own.  A join per level that there is."""
    rows = tree.where("number is not null")
    deepest = min(rows.agg(F.max("depth")).first()[0] or 0, most_depth)
    out = rows.withColumn("titles", F.array("title")).withColumn("__up", F.col("parent"))
    for _ in range(deepest - 1):
        above = rows.select(F.col(path).alias("__p"), F.col("number").alias("__n"), F.col("title").alias("__t"), F.col("parent").alias("__g"))
        out = out.join(above, (F.col(path) == F.col("__p")) & (F.col("__up") == F.col("__n")), "left")
        out = out.withColumn("titles", F.when(F.col("__n").isNotNull(), F.concat(F.array("__t"), "titles")).otherwise(F.col("titles"))).withColumn("__up", F.coalesce("__g", F.lit(0))).drop("__p", "__n", "__t", "__g")
    return out.drop("__up")


def markdown_tree(notes: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """(name, number, level, parent, heading, text): sections with the section of a higher level that each is under (null: none)."""
    parts = notes.select(name, F.posexplode(F.split(F.col(body), r"(?m)^(?=#{1,6} )")).alias("number", "part")).where(F.trim("part") != "")
    mark = F.regexp_extract("part", r"^(#{1,6}) ", 1)
    rows = parts.select(name, "number", F.length(mark).alias("level"), F.nullif(F.regexp_extract("part", r"^#{1,6} +([^\n]*)", 1), F.lit("")).alias("heading"), F.regexp_replace(F.regexp_replace("part", r"^#{1,6} [^\n]*\n?", ""), r"^\s+|\s+$", "").alias("text"))
    before = Window.partitionBy(name).orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("number")), ignorenulls=True).over(before) for k in range(1, 6)]
    rows = rows.withColumns({f"__l{k}": c for k, c in enumerate(last, 1)})
    parent = F.greatest(*[F.when(F.col("level") > k, F.col(f"__l{k}")) for k in range(1, 6)])
    return rows.withColumn("parent", parent).select(name, "number", "level", "parent", "heading", "text")


def fenced_fields(body: Column) -> Column:
    """array<struct<key, value, item>> of the first fenced YAML block: scalars, and items of lists under their key."""
    lines = F.split(F.regexp_extract(body, r"```yaml\n([\s\S]*?)\n```", 1), "\n")
    none = F.struct(F.lit(None).cast("string").alias("key"), F.lit(False).alias("list"), F.array().cast("array<struct<key: string, value: string, item: boolean>>").alias("out"))

    def step(a: Column, raw: Column) -> Column:
        line = F.trim(raw)
        key, value = F.trim(F.substring_index(line, ":", 1)), F.regexp_replace(F.trim(F.regexp_replace(line, r"^[^:]*:", "")), r"""^['"]+|['"]+$""", "")
        item = F.struct(a["key"].alias("key"), F.trim(F.substring(line, F.lit(3), F.length(line))).alias("value"), F.lit(True).alias("item"))
        scalar = F.struct(key.alias("key"), value.alias("value"), F.lit(False).alias("item"))
        return (
            F.when(F.startswith(line, F.lit("- ")) & a["list"], F.struct(a["key"].alias("key"), a["list"].alias("list"), F.concat(a["out"], F.array(item)).alias("out")))
            .when(F.contains(line, F.lit(":")), F.struct(key.alias("key"), (value == "").alias("list"), F.when(value == "", a["out"]).otherwise(F.concat(a["out"], F.array(scalar))).alias("out")))
            .otherwise(a)
        )

    return F.aggregate(lines, none, step, lambda a: a["out"])


def list_items(text: Column) -> Column:
    """The items of a list written with dashes."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("- "))), lambda x: F.trim(F.substring(x, F.lit(3), F.length(x))))


def anchors(text: Column) -> Column:
    """array<struct<id, name, text>> of scale anchors: list items that begin with a bold id."""
    pattern = r"^- \*\*(U\d)\s*([^*]*)\*\*：(.+)"
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(pattern))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("id"), F.trim(F.regexp_extract(x, pattern, 2)).alias("name"), F.trim(F.regexp_extract(x, pattern, 3)).alias("text")))
