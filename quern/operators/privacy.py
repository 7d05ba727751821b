"""Cues of what may identify a person, and the redaction of approved spans.

Cues are for review: a text without any is not proven safe.  Offsets are characters of the original text, ends
exclusive.  Cues may overlap; spans approved for redaction must not, which violations() tells before redacted()
is asked.  A null text has no cues and stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import core

#: Patterns of the seven kinds; where a pattern names a group, the group is the span.
CUES = {
    "email": r"(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "mobile": r"(?<![A-Za-z0-9])(?:\+?86[ -]?)?1[3-9][0-9][ -]?[0-9]{4}[ -]?[0-9]{4}(?![A-Za-z0-9])",
    "national_id": r"(?<![A-Za-z0-9])[1-8][0-9]{16}[0-9Xx](?![A-Za-z0-9])",
    "contact_handle": r"(?i)(?:微信(?:号)?|微号|QQ(?:号)?|联系账号|社交账号|账号|账户)\s*(?:[:：]|是|为)\s*(?P<value>[A-Za-z][A-Za-z0-9_-]{4,31}|[1-9][0-9]{4,11})(?![A-Za-z0-9_-])",
    "name": r"(?:患者姓名|姓名|联系人)\s*(?:[:：]|是|为)\s*(?P<value>[一-鿿]{2,4})(?=[\s，,。；;！？!?]|$)",
    "address": r"(?:家庭地址|居住地址|收件地址|联系地址|住址)\s*(?:[:：]|是|为)\s*(?P<value>[^\s，,。；;！？!?\r\n][^，,。；;！？!?\r\n]{2,79})",
    "url": r"(?i)(?:https?://|www\.)[^\s<>\"'（），,。！？!；;]+",
}
#: Years that a number's birth date may have.
YEARS = (1800, 2099)


def plausible_id(number: Column) -> Column:
    """Whether an 18-character number has a real date in its places 7 to 14 and a sequence other than 000."""
    day = F.try_to_timestamp(F.substring(number, 7, 8), F.lit("yyyyMMdd"))
    return F.coalesce(F.year(day).between(*YEARS) & (F.substring(number, 15, 3) != "000"), F.lit(False))


def _edges(texts: list[str], cue: re.Pattern, part: str | int) -> pa.ListArray:
    """For each text one flat list: start, end, start, end of a cue's matches."""
    flat, sizes = array("i"), array("i", [0])
    for t in texts:
        flat.extend(chain.from_iterable(m.span(part) for m in cue.finditer(t)))
        sizes.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))


def cue_spans(text: Column, cues: dict[str, str] | None = None) -> Column:
    """array<struct<kind, start, end>> of every match, in reading order; dates of numbers are not looked at.

    Tasks give the edges of each kind's matches as a column of numbers; spans are made of them and sorted by Spark.
    """
    cues = CUES if cues is None else cues
    parts = {kind: "value" if "(?P<value>" in p else 0 for kind, p in cues.items()}
    names = [f"k{n}" for n in range(len(cues))]

    @F.arrow_udf("struct<" + ", ".join(f"{n}: array<int>" for n in names) + ">")
    def edges(values: pa.Array) -> pa.Array:
        texts = values.fill_null("").to_pylist()
        return pa.StructArray.from_arrays([_edges(texts, re.compile(p), parts[kind]) for kind, p in cues.items()], names)

    def of(kind: str, flat: Column) -> Column:
        pairs = F.filter(F.transform(flat, lambda x, i: F.struct(x.alias("start"), F.get(flat, i + 1).alias("end"), F.lit(kind).alias("kind"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
        return F.transform(pairs, lambda s: F.struct(s["start"], s["end"], s["kind"]))

    # a column of Python stands outside of lambdas, so it is bound once by a list of one
    made = lambda z: F.transform(F.array_sort(F.concat(*[of(kind, z[n]) for kind, n in zip(cues, names)])), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.isNotNull(), F.get(F.transform(F.array(edges(text)), made), F.lit(0)))


def scan(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, kind, start, end) of every cue; numbers without a plausible date are none."""
    rows = texts.select(key, F.col(text).alias("__t"), F.explode(cue_spans(F.col(text))).alias("c")).select(key, "__t", "c.*")
    value = F.substring(F.col("__t"), F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.where((F.col("kind") != "national_id") | plausible_id(value)).drop("__t")


def violations(texts: DataFrame, approved: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, start, rule) of approved spans (key, kind, start, end) that can't be used.

    OUT_OF_BOUNDS: empty, or not inside the text; BAD_KIND: not a lower-case identifier; OVERLAP: begins before an
    earlier one of the text ends.
    """
    j = approved.join(texts.select(key, F.length(text).alias("__n")), key, "left")
    before = F.max("end").over(Window.partitionBy(key).orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1))
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("__n"))
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(inside, F.lit(False)), "OUT_OF_BOUNDS"),
        F.when(~F.coalesce(F.col("kind").rlike("^[a-z][a-z0-9_]*$"), F.lit(False)), "BAD_KIND"),
        F.when(F.col("start") < F.col("__before"), "OVERLAP"),
    ))
    return j.withColumn("__before", before).select(key, "start", F.explode(rules).alias("rule"))


def redacted(texts: DataFrame, approved: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, replacements) with every approved span replaced by [REDACTED_<KIND>_<n>].

    A kind's equal values share a number over all texts; numbers follow the first occurrence in the order of key and
    place.  Spans that violations() names must be settled before: they raise here.
    """
    bad = violations(texts, approved, key, text).limit(1).collect()
    if bad:
        raise ValueError(f"approved spans can't be used: {bad[0].asDict()}")
    spans = approved.join(texts.select(key, F.col(text).alias("__t")), key).select(key, "kind", "start", "end", F.substring(F.col("__t"), F.col("start") + 1, F.col("end") - F.col("start")).alias("value"))
    first = spans.groupBy("kind", "value").agg(F.min(F.struct(key, "start")).alias("at"))
    numbered = core.numbered(first, ["kind"], "at", "n").select("kind", "value", "n")
    name = F.concat(F.lit("[REDACTED_"), F.upper("kind"), F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    named = spans.join(numbered, ["kind", "value"]).select(key, F.struct("start", "end", "kind", name.alias("replacement")).alias("r"))
    own = named.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("replacements"))  # the spans of one text
    j = texts.select(key, F.col(text).alias("__t")).join(own, key, "left").withColumn("replacements", F.coalesce("replacements", F.array().cast("array<struct<start: int, end: int, kind: string, replacement: string>>")))
    spliced = F.aggregate(
        "replacements", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, r: F.struct(F.concat(s["out"], F.substring(F.col("__t"), s["at"] + 1, r["start"] - s["at"]), r["replacement"]).alias("out"), r["end"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(F.col("__t"), s["at"] + 1, F.length("__t"))),
    )
    return j.select(key, F.when(F.col("__t").isNotNull(), spliced).alias("text"), "replacements")
