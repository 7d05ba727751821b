"""Words for a reviewer's eye, small readers of semi-structured text, and ordered ladders of labels.

A null text gives no rows or null; an empty table gives an empty result; rows that repeat are read each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X

#: Six categories of review cues.
REVIEW_CUES = {
    "negation": r"没有|未曾|尚未|并非|不是|否认|不再|无",
    "uncertainty": r"不清楚|不知道|不确定|可能|也许|好像|似乎|记不清",
    "correction": r"更正|纠正|说错|记错|改口|不是.{0,12}而是",
    "person": r"妈妈|母亲|爸爸|父亲|孩子|儿子|女儿|丈夫|妻子|家人|本人|我",
    "time": r"今天|昨天|前天|刚才|之前|以后|去年|上周|本周|\d+\s*(?:年|月|天|小时|分钟)",
    "question": r"[?？]|是否|是不是|有没有|怎么办|为什么|能不能|吗",
}


def review_spans(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, category, start, end, said) of every cue; none of them decides anything."""
    found = texts.select(key, F.col(text).alias("__t"), F.explode(X.spans(F.col(text), REVIEW_CUES)).alias("c"))
    return found.select(key, F.col("c.kind").alias("category"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.substring(F.col("__t"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("said"))


def parts_of(text: Column) -> Column:
    """Distinct trimmed parts of a text between / , 、 ; and ；."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[/,、;；]"), lambda x: F.trim(x)), lambda x: x != ""))


def stage(status: Column) -> Column:
    """The stage that a development status tells; the first rung of the ladder that fits."""
    upper = F.upper(status)
    has = lambda *words: F.array_contains(F.array(*[F.contains(status, F.lit(w)) for w in words]), True)
    return (
        F.when(has("上市") | F.contains(upper, F.lit("APPROVED")), "MARKETED").when(F.contains(upper, F.lit("NDA")) | has("递交", "受理"), "REGULATORY")
        .when(has("III", "Ⅲ"), "PHASE3").when(has("II", "Ⅱ"), "PHASE2").when(has("I"), "PHASE1").otherwise("UNKNOWN")
    )


def node_type(label: Column, ladder: list[tuple[str, str]], default: str) -> Column:
    """The type of the first pattern (type, pattern) that a label holds."""
    out = F.lit(default)
    for name, pattern in reversed(ladder):
        out = F.when(F.coalesce(label.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


LINK = r"\[\[([^\[\]|#]+)(#[^\[\]|]*)?(?:\|([^\[\]]*))?\]\]"


def links(notes: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """(name, target) of every wikilink of a note."""
    return notes.select(F.col(name).alias("name"), F.explode(F.regexp_extract_all(F.col(body), F.lit(LINK), F.lit(1))).alias("target")).select("name", F.trim("target").alias("target"))


def links_repaired(notes: DataFrame, renamed: DataFrame, name: str = "name", body: str = "body") -> DataFrame:
    """Notes whose wikilinks follow renamed (old, new), and whose links to no note are plain text.

    A link [[target]] or [[target|shown]] keeps what it shows.  A note's links are few; each meets the names by an
    equi-join, and the body is put together again from what stands between them.
    """
    pieces = F.split(F.col(body), LINK, -1)
    parts = lambda g: F.regexp_extract_all(F.col(body), F.lit(LINK), F.lit(g))
    own = notes.select(F.col(name).alias("name"), F.col(body).alias("body"), pieces.alias("between"), parts(1).alias("targets"), parts(2).alias("anchors"), parts(3).alias("shown"))
    each = own.select("name", F.posexplode(F.arrays_zip("targets", "anchors", "shown")).alias("at", "l")).select("name", "at", F.trim("l.targets").alias("target"), F.col("l.anchors").alias("anchor"), F.col("l.shown").alias("shown"))
    moved = each.join(renamed.select(F.col("old").alias("target"), "new").distinct(), "target", "left").withColumn("to", F.coalesce("new", "target"))
    known = moved.join(notes.select(F.col(name).alias("to"), F.lit(True).alias("known")).distinct(), "to", "left")
    label = F.when(F.col("shown") != "", F.col("shown")).otherwise(F.col("to"))
    link = F.concat(F.lit("[["), "to", "anchor", F.when(F.col("shown") != "", F.concat(F.lit("|"), "shown")).otherwise(""), F.lit("]]"))
    said = known.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("known"), link).otherwise(label).alias("s")))).alias("said"))
    j = own.join(said, "name", "left")
    woven = F.array_join(F.flatten(F.transform("between", lambda x, i: F.array(x, F.coalesce(F.get(F.col("said.s"), i), F.lit(""))))), "")
    return j.select("name", F.when(F.col("said").isNull(), F.col("body")).otherwise(woven).alias("body"))


FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def fenced_json(text: Column) -> Column:
    """The JSON text of a model's output: what stands in a fence, else from the first brace to the last; null if it doesn't parse."""
    fenced = F.trim(F.regexp_extract(text, FENCE, 1))
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    body = F.when(fenced != "", fenced).when(F.startswith(F.ltrim(text), F.lit("{")), F.trim(text)).otherwise(braced)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def json_at(text: Column, path: str) -> Column:
    """The scalar at a dotted path (a.b, or a[0].b) of a JSON text as text; null where the path or the text has none."""
    return F.try_variant_get(F.try_parse_json(text), f"$.{path}", "string")


def pointer_path(pointer: str) -> str:
    """A JSON pointer as the path that json_at() takes."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in pointer.split("/")[1:]]
    return re.sub(r"^\.", "", "".join(f"[{s}]" if s.isdigit() else f".{s}" if re.fullmatch(r"\w+", s) else f"['{s}']" for s in steps))


def merged(base: Column, patch: Column, drop: Column) -> Column:
    """A map of dotted paths to values with those of `patch` over those of `base`, without the paths of `drop` and below.

    A patch at a.b takes the place of a value at a, and one at a that of all values below it, as in nested objects.
    """
    below = lambda k, d: F.startswith(k, F.concat(d, F.lit(".")))
    keys = F.map_keys(patch)
    kept = F.map_filter(base, lambda k, _: ~F.exists(keys, lambda p: (p == k) | below(k, p) | below(p, k)))
    return F.map_filter(F.map_concat(kept, patch), lambda k, _: ~F.exists(drop, lambda d: (k == d) | below(k, d)))


def context_lines(lines: DataFrame, keys: list[str], line: str, position: str, most: int = 6) -> DataFrame:
    """The first `most` different lines of each key in the order of position, as an array."""
    first = lines.groupBy(*keys, line).agg(F.min(position).alias("__at"))
    kept = F.slice(F.array_sort(F.collect_list(F.struct("__at", F.col(line).alias("l")))), 1, most)
    return first.groupBy(*keys).agg(F.transform(kept, lambda x: x["l"]).alias("lines"))


#: What must not appear in a public release.
RELEASE_RULES = {
    "EMAIL": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "MOBILE": r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", "LONG_NUMBER": r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])",
    "SECRET": r"(?i)(?:api[_-]?key|token|secret|password)\s*[:=]", "LOCAL_PATH": r"(?:/Users/|/home/|[A-Z]:\\\\)",
}


def release_violations(rows: DataFrame, key: str, text: str, provenance: list[str], rules: dict[str, str] | None = None) -> DataFrame:
    """(key, rule) of texts that hold something private, and of rows without a field of their provenance."""
    own = RELEASE_RULES if rules is None else rules
    found = [F.when(F.coalesce(F.col(text).rlike(p), F.lit(False)), n) for n, p in own.items()]
    found += [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", f"MISSING_{c.upper()}") for c in provenance]
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("rule"))
