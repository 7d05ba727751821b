"""Lineage of candidate records from protected references: exclusive evidence, decisions by pair, mosaics.

Records are a case_id and one text column for each field, JSON or plain.  What a reference shares with the allowed
corpus is no evidence; what only protected records hold is.  Pairs are found by equi-joins: an exclusive anchor, an equal
core, an equal exclusive field or span, a common exclusive identifier, or concepts across languages; only those are
scored.  A set of hashes is made once for each record, field and span, and sent once to each block of references.  A candidate without such a pair is allowed, and names no nearest reference.

Defined cases: null, empty, [] and {} fields are empty and match nothing; records without text are allowed; a case_id
should be unique, rows that repeat are one record; empty tables give empty results, and without references all are
allowed; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import concepts as C
from quern.functions import text as X
from quern.functions.scratch import scratch, stored

from .core import pick

#: Thresholds of decisions.
RECORD_BLOCK, RECORD_REVIEW, FIELD_NEAR, SPAN_BLOCK, SPAN_REVIEW, DENSE = 0.88, 0.70, 0.90, 0.95, 0.82, 0.62
MOSAIC_REFERENCES, MOSAIC_SIMILARITY, MOSAIC_ANCHORS, MOSAIC_TOTAL, MOSAIC_RISK = 2, 0.52, 8, 16, 0.96
CROSS_RISK, SCRIPT_CONCEPTS, SPANS_LISTED = 0.94, 5, 24
RANK = {"ALLOW": 0, "REVIEW": 1, "BLOCK": 2}
KEY = ["candidate_id", "reference_id"]
_STRINGS, _LONGS = "array<string>", "array<long>"


def _read(text: str):
    try:
        value = json.loads(text)
    except ValueError:
        return text
    return value if isinstance(value, (dict, list)) else text


#: Characters, hashes and pairs that a task's Python turns out at once, and rows that it looks at at once, however
#: many rows Spark hands it.
CHARS, HASHES, PAIRS, ROWS = 1 << 22, 1 << 20, 1 << 16, 512


def _pieces(values: Iterator, size: Callable[[object], int], limit: int, kind: pa.DataType) -> Iterator[pa.Array]:
    """The values in arrays that end with the value that reaches the limit."""
    out, held = [], 0
    for v in values:
        out.append(v)
        held += 1 + (0 if v is None else size(v))
        if held >= limit:
            yield pa.array(out, kind)
            out, held = [], 0
    if out:
        yield pa.array(out, kind)


def _parsed(text: Column) -> Column:
    """struct<canonical, form, part, leaves>: a field's canonical JSON, its word form, its part of the record's form, long leaf strings."""
    leaf = pa.struct([("path", pa.string()), ("text", pa.string())])
    kind = pa.struct([("canonical", pa.string()), ("form", pa.string()), ("part", pa.string()), ("leaves", pa.list_(leaf))])

    def one(s: str | None) -> dict | None:
        value = None if s is None else _read(s)
        if value is None or value in ("", [], {}):
            return None
        canonical = X.canonical_text(value)
        form = X.plain_form(value if isinstance(value, str) else canonical)
        return {"canonical": canonical, "form": form, "part": X.plain_form(canonical), "leaves": X.leaves_of(value)}

    @F.arrow_udf("struct<canonical: string, form: string, part: string, leaves: array<struct<path: string, text: string>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:  # the leaves are parts of the text, too
            yield from _pieces((one(v.as_py()) for v in values), lambda p: 3 * len(p["canonical"]), CHARS, kind)

    return run(text)


def gram_hashes(form: Column, n: int = 4) -> Column:
    """Sorted distinct 64-bit hashes of the n-grams of characters; a shorter text is its own; an empty one has none."""

    def of(s: str) -> np.ndarray:
        a = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(a) < n:
            a = np.append(a, np.zeros(n - len(a), np.uint64)) if len(a) else a
        if not len(a):
            return np.zeros(0, np.int64)
        h = np.zeros(len(a) - n + 1, np.uint64)
        for k in range(n):
            h = (h ^ a[k : len(a) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h.view(np.int64))

    @F.arrow_udf(_LONGS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield from _pieces((of(v.as_py()) if v.is_valid else None for v in values), len, HASHES, pa.list_(pa.int64()))

    return run(form)


def _item(kind: str, name: str | None = None, case: str = "case_id") -> Column:
    """The name of a record, field or span."""
    return F.concat_ws("\x1f", F.lit(kind), F.col(case), *([F.col(name)] if name else [])).alias("item")


#: Hashes of reference items that a task holds, and hashes of candidate items that are sent past them.
HELD, PASSED = 1 << 21, 1 << 24


def _intersections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    at = None
    common = lambda a, b: int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) and len(b) else 0
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
    table = lambda out: pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["a", "b", "iw", "ig", "nw", "ng"])
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        out: list[tuple] = []
        sets = [[np.asarray(v.values) if v.is_valid else np.zeros(0, np.int64) for v in batch[c]] for c in ("words", "grams")]
        for k, (cell, item, others) in enumerate(zip(*(batch[c].to_pylist() for c in ("cell", "item", "others")))):
            if cell != at:
                held, at = {}, cell
            words, grams = sets[0][k], sets[1][k]
            if others is None:
                held[item] = (words, grams)
                continue
            for name in others:
                w, g = held[name]
                out.append((item, name, common(words, w), common(grams, g), len(words) + len(w), len(grams) + len(g)))
                if len(out) >= PAIRS:
                    yield table(out)
                    out = []
        yield table(out)


def similarities(pairs: DataFrame, left: DataFrame, right: DataFrame, path: str) -> DataFrame:
    """(a, b, similarity) of stored pairs (a, b) of items, each with its hashed sets (item, words, grams).

    No pair carries a set: right items are dealt into blocks that a task can hold, a left item goes once to each block that it
    has partners in, and is compared there with all of them.  Blocks meet many left items in several tasks.
    """
    left, right = stored(left, f"{path}/left"), stored(right, f"{path}/right")
    volume = lambda df: (df.agg(F.sum(F.size("words") + F.size("grams")).alias("n")).first()["n"] or 0)
    blocks, tasks = -(-volume(right) // HELD) or 1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    salts = max(-(-volume(left) // PASSED), -(-tasks // blocks))
    cell = lambda b, salt: (b * F.lit(salts) + salt).cast("int").alias("cell")
    asked = stored(pairs.groupBy("a", block("b").alias("block")).agg(F.collect_list("b").alias("others")), f"{path}/asked")  # a block's items at most
    moving = asked.join(left, F.col("a") == F.col("item")).select(cell(F.col("block"), F.pmod(F.xxhash64("a", F.lit(1)), F.lit(salts))), "item", "words", "grams", "others")
    fixed = right.select("item", "words", "grams", block("item").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    fixed = fixed.select(cell(F.col("block"), F.col("salt")), "item", "words", "grams", F.lit(None).cast(_STRINGS).alias("others"))
    rows = fixed.union(moving).withColumn("late", F.col("others").isNotNull()).repartitionById(blocks * salts, "cell").sortWithinPartitions("cell", "late")
    found = rows.drop("late").mapInArrow(_intersections, "a string, b string, iw long, ig long, nw long, ng long")
    dice = lambda i, n: F.when(F.col(n) == 0, 1.0).otherwise(2.0 * F.col(i) / F.col(n))
    return found.select("a", "b", F.round(0.58 * dice("iw", "nw") + 0.42 * dice("ig", "ng"), 6).alias("similarity"))


def _words(form: Column) -> Column:
    return F.array_distinct(F.filter(F.split(form, " "), lambda x: x != ""))


class Records:
    """Tables of a set of records, each stored once: fields, leaves and whole records."""

    def __init__(self, rows: DataFrame, fields: list[str], labs: str | None = None):
        path = scratch(rows.sparkSession, "lineage")
        rows = pick(rows, ["case_id"], [F.to_json(F.struct(*[F.col(f).cast("string") for f in fields]))]).where("case_id is not null")
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in sorted(fields)])).alias("x")
        parsed = rows.select("case_id", each).select("case_id", "x.field", _parsed(F.col("x.text")).alias("p"))
        self.fields = stored(parsed.where("p is not null").select("case_id", "field", "p.*"), f"{path}/fields")
        # a record's form has every field's name, and null where a field is empty
        held = self.fields.select("case_id", F.struct("field", "part", "canonical").alias("f"))
        held = held.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("f.field"), F.col("f")))).alias("m"))
        form = F.concat_ws(" ", *[F.concat_ws(" ", F.lit(f), F.when(F.col("m").isNull() | F.try_element_at("m", F.lit(f)).isNull(), "null").otherwise(F.col("m")[f]["part"])) for f in sorted(fields)])
        core = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.try_element_at("m", F.lit(f))["canonical"], F.lit("null")) for f in sorted(fields)]), 256)
        codes = F.array_distinct(F.flatten(F.transform(F.map_values("m"), lambda f: C.identifiers(f["canonical"]))))
        quantity = F.col(labs).cast("string") if labs else F.lit(None).cast("string")
        whole = rows.select("case_id", quantity.alias("labs")).join(held, "case_id", "left").select("case_id", "labs", F.trim(form).alias("form"), core.alias("core"), F.coalesce(codes, F.array().cast(_STRINGS)).alias("ids"))
        self.whole = stored(
            whole.select(
                "case_id", "core", "form", "ids", F.md5(F.col("form").cast("binary")).alias("print"), X.content_words(F.col("form"), lambda c: c).alias("content"),
                C.concepts(F.col("form")).alias("concepts"), C.numbers(F.col("form")).alias("numbers"), C.language(F.col("form")).alias("lang"), F.coalesce(C.roles(F.col("labs")), F.array().cast(_STRINGS)).alias("roles"),
            ),
            f"{path}/whole",
        )

    @property
    def leaves(self) -> DataFrame:
        """(case_id, field, path, span)"""
        return self.fields.select("case_id", "field", F.explode("leaves").alias("l")).select("case_id", "field", F.concat("field", F.col("l.path")).alias("path"), F.col("l.text").alias("span"))

    def column(self, name: str, one: str) -> DataFrame:
        return self.whole.select("case_id", F.explode(name).alias(one))

    def items(self, of: list[DataFrame]) -> DataFrame:
        """(item, words, grams): hashed sets of whole records, fields and spans that are named in `of` (item)."""
        each = [self.whole.select(_item("w"), "form"), self.fields.select(_item("f", "field"), "form"), self.leaves.select(_item("s", "path"), F.col("span").alias("form"))]
        wanted = reduce(DataFrame.union, of).distinct()
        rows = reduce(DataFrame.union, each).distinct().join(wanted, "item", "left_semi")
        words = F.array_sort(F.array_distinct(F.transform(_words(F.col("form")), lambda w: F.xxhash64(w))))
        return rows.select("item", words.alias("words"), gram_hashes(F.col("form")).alias("grams"))


def _as(side: str, df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("case_id", f"{side}_id")


def reference_index(references: Records, allowed: Records, high_signal: list[str]) -> dict[str, DataFrame]:
    """What protected references have and the allowed corpus has not: anchors, identifiers, fields and spans with their anchors."""
    path = scratch(references.whole.sparkSession, "index")
    known = stored(allowed.column("content", "word").select("word").distinct(), f"{path}/known")
    spans = references.leaves.join(allowed.leaves.select("field", "span").distinct(), ["field", "span"], "left_anti")
    tokens = spans.select("case_id", "field", "path", F.explode(X.content_words(F.col("span"), lambda c: c)).alias("word")).join(known, "word", "left_anti")
    anchors = tokens.groupBy("case_id", "field", "path").agg(F.array_sort(F.collect_set("word")).alias("anchors"))
    fields = references.fields.where(F.col("field").isin(high_signal))
    return {
        "anchors": stored(references.column("content", "word").join(known, "word", "left_anti"), f"{path}/anchors"),
        "ids": references.column("ids", "id").join(allowed.column("ids", "id").select("id").distinct(), "id", "left_anti"),
        "fields": stored(fields.join(allowed.fields.select("field", "form").distinct(), ["field", "form"], "left_anti"), f"{path}/fields"),
        "spans": stored(spans.join(anchors, ["case_id", "field", "path"], "left").withColumn("anchors", F.coalesce("anchors", F.array().cast(_STRINGS))), f"{path}/spans"),
    }


def span_pairs(candidates: Records, spans: DataFrame) -> DataFrame:
    """Pairs of spans of one field that are equal, or share an exclusive anchor: paths, whether they are equal, shared anchors."""
    c = _as("candidate", candidates.leaves).select("candidate_id", "field", F.col("path").alias("c_path"), F.col("span").alias("c_span"))
    r = _as("reference", spans).select("reference_id", "field", F.col("path").alias("r_path"), F.col("span").alias("r_span"), "anchors")
    anchors = r.select("field", F.explode("anchors").alias("word")).distinct()
    words = c.select("candidate_id", "field", "c_path", F.explode(X.content_words(F.col("c_span"), lambda x: x)).alias("word")).join(anchors, ["field", "word"], "left_semi")
    near = words.join(r.select("reference_id", "field", "r_path", F.explode("anchors").alias("word")), ["field", "word"])
    near = near.select(*KEY, "c_path", "r_path", F.lit(False).alias("equal"), "word")
    same = c.join(r.withColumn("c_span", F.col("r_span")), ["field", "c_span"]).select(*KEY, "c_path", "r_path", F.lit(True).alias("equal"), F.lit(None).cast("string").alias("word"))
    return near.union(same).groupBy(*KEY, "c_path", "r_path").agg(F.bool_or("equal").alias("equal"), F.array_sort(F.collect_set("word")).alias("shared"))


def _by_concepts(candidates: Records, references: Records) -> DataFrame:
    """Pairs of unlike languages that share three concepts or more: they share one of each other's concepts past the last two by name."""
    some = lambda r: r.whole.where(F.size("concepts") >= 3).select("case_id", "lang", "concepts", F.explode(F.slice(F.array_sort("concepts"), F.lit(1), F.size("concepts") - 2)).alias("c"))
    a, b = some(candidates), some(references)
    j = a.alias("a").join(b.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.lang") != F.col("b.lang")))
    return j.where(F.size(F.array_intersect("a.concepts", "b.concepts")) >= 3).select(F.col("a.case_id").alias("candidate_id"), F.col("b.case_id").alias("reference_id")).distinct()


def pairs(candidates: DataFrame, references: DataFrame, allowed: DataFrame, fields: list[str], high_signal: list[str] | None = None, labs: str | None = None) -> DataFrame:
    """A row for each candidate and reference with any evidence: similarities, overlaps, reasons, risk, decision, matching spans."""
    cand, ref, free = Records(candidates, fields, labs), Records(references, fields, labs), Records(allowed, fields)
    index = reference_index(ref, free, fields if high_signal is None else high_signal)
    path = scratch(candidates.sparkSession, "pairs")
    c_, r_ = (lambda df: _as("candidate", df)), (lambda df: _as("reference", df))

    words = cand.column("content", "word").join(index["anchors"].select("word").distinct(), "word", "left_semi")
    by_anchor = stored(c_(words).join(r_(index["anchors"]), "word").groupBy(KEY).agg(F.array_sort(F.collect_set("word")).alias("shared_anchors")), f"{path}/anchors")
    by_id = stored(c_(cand.column("ids", "id")).join(r_(index["ids"]), "id").groupBy(KEY).agg(F.array_sort(F.collect_set("id")).alias("shared_ids")), f"{path}/ids")
    by_core = c_(cand.whole.select("case_id", "core")).join(r_(ref.whole.select("case_id", "core")), "core").select(*KEY, F.lit(True).alias("same_core"))
    near_spans = stored(span_pairs(cand, index["spans"]), f"{path}/near-spans")
    exact = c_(cand.fields.select("case_id", "field", "form")).join(r_(index["fields"].select("case_id", "field", "form")), ["field", "form"]).select(KEY)

    # spans first: only those that are alike count as evidence
    item = lambda kind, side, name=None: _item(kind, name, f"{side}_id")
    both = lambda df, kind, a=None, b=None: df.select(item(kind, "candidate", a).alias("a"), item(kind, "reference", b).alias("b"))
    named = lambda df, side: df.select(F.col(side).alias("item"))
    unlike = stored(both(near_spans.where("not equal"), "s", "c_path", "r_path"), f"{path}/span-items")
    span_sim = stored(similarities(unlike, cand.items([named(unlike, "a")]), ref.items([named(unlike, "b")]), f"{path}/span-sets"), f"{path}/span-sim")
    spans = near_spans.withColumns({"a": item("s", "candidate", "c_path"), "b": item("s", "reference", "r_path")}).join(span_sim, ["a", "b"], "left")
    spans = spans.withColumn("similarity", F.when(F.col("equal"), 1.0).otherwise(F.col("similarity"))).where(F.col("similarity") >= SPAN_REVIEW)
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("order"), "c_path", "r_path", "similarity", "shared"))), 1, SPANS_LISTED)
    blocks = (F.col("similarity") >= SPAN_BLOCK) & ((F.col("similarity") == 1.0) | (F.size("shared") > 0))
    by_span = spans.groupBy(KEY).agg(F.max("similarity").alias("max_span"), F.count(F.lit(1)).alias("spans"), F.bool_or(blocks).alias("span_blocks"), F.bool_or(F.size("shared") > 0).alias("span_anchored"), listed.alias("l"))
    by_span = stored(by_span.withColumn("span_matches", F.transform("l", lambda x: x.dropFields("order"))).drop("l"), f"{path}/spans")
    found = stored(reduce(DataFrame.union, [x.select(KEY) for x in (by_anchor, by_id, by_core, by_span, exact, _by_concepts(cand, ref))]).distinct(), f"{path}/found")

    # records and fields of the pairs found: names and prints travel, sets go once to each block of references
    print_ = F.md5(F.col("canonical").cast("binary"))
    a = c_(cand.fields.select("case_id", "field", print_.alias("a_print")))
    b = r_(index["fields"].select("case_id", "field", print_.alias("b_print")))
    per_field = stored(found.join(a, "candidate_id").join(b, ["reference_id", "field"]).select(*KEY, "field", (F.col("a_print") == F.col("b_print")).alias("same")), f"{path}/field-pairs")
    asked = stored(both(found, "w").union(both(per_field.where("not same"), "f", "field", "field")), f"{path}/items")
    sim = stored(similarities(asked, cand.items([named(asked, "a")]), ref.items([named(asked, "b")]), f"{path}/sets"), f"{path}/sim")
    per_field = per_field.withColumns({"a": item("f", "candidate", "field"), "b": item("f", "reference", "field")}).join(sim, ["a", "b"], "left").withColumn("s", F.when(F.col("same"), 1.0).otherwise(F.col("similarity")))
    names = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("field"))))
    by_field = per_field.groupBy(KEY).agg(F.max("s").alias("max_field"), names(F.col("same")).alias("exact_fields"), names(F.col("s") >= FIELD_NEAR).alias("near_fields"))

    totals = r_(index["anchors"].groupBy("case_id").agg(F.count(F.lit(1)).alias("all_anchors")))
    j = found.withColumns({"a": item("w", "candidate"), "b": item("w", "reference")}).join(sim.withColumnRenamed("similarity", "record_similarity"), ["a", "b"], "left").drop("a", "b")
    for part in (by_anchor, by_id, by_core, by_span, by_field):
        j = j.join(part, KEY, "left")
    read = ["case_id", "print", "concepts", "numbers", "lang", "roles"]
    j = j.join(totals, "reference_id", "left").join(c_(cand.whole.select(read)).alias("c"), "candidate_id").join(r_(ref.whole.select(read)).alias("r"), "reference_id")
    return _decided(j)


def _decided(j: DataFrame) -> DataFrame:
    """The rules, in four steps: evidence of the pair, of languages, of review, of measured quantities."""
    none = F.array().cast(_STRINGS)
    both = lambda name: F.array_sort(F.array_intersect(f"c.{name}", f"r.{name}"))
    j = j.withColumns({
        "record_similarity": F.when(F.col("c.print") == F.col("r.print"), 1.0).otherwise(F.col("record_similarity")),
        **{name: F.coalesce(name, none) for name in ("shared_anchors", "shared_ids", "exact_fields", "near_fields")},
        **{name: F.coalesce(name, F.lit(0.0)) for name in ("max_field", "max_span")}, "spans": F.coalesce("spans", F.lit(0)),
        **{name: F.coalesce(name, F.lit(False)) for name in ("same_core", "span_blocks", "span_anchored")},
        "shared_concepts": both("concepts"), "shared_numbers": both("numbers"), "cross_language": F.col("c.lang") != F.col("r.lang"), "candidate_language": F.col("c.lang"), "reference_language": F.col("r.lang"),
        "role_conflict": (F.size("c.roles") > 0) & (F.size("r.roles") > 0) & ~F.arrays_overlap("c.roles", "r.roles"),
    })
    rec, anchors, near = F.col("record_similarity"), F.size("shared_anchors"), F.size("near_fields")
    own = F.array_compact(F.array(
        F.when(F.col("same_core"), "EXACT_SEMANTIC_CORE"), F.when(F.size("exact_fields") > 0, "PROTECTED_EXCLUSIVE_FIELD_REUSE"), F.when(F.col("span_blocks"), "PROTECTED_EXCLUSIVE_SPAN_REUSE"),
        F.when((rec >= RECORD_BLOCK) & (anchors > 0), "ANCHORED_HIGH_RECORD_NEAR_DUPLICATE"), F.when((near >= 2) & (rec >= DENSE) & (anchors > 0), "ANCHORED_MULTI_FIELD_NEAR_REUSE"), F.when((anchors >= 3) & (rec >= DENSE), "DENSE_PROTECTED_ANCHOR_REUSE"),
    ))
    density = F.when(anchors > 0, 0.62 + 0.25 * anchors / F.greatest(F.lit(1), F.coalesce("all_anchors", F.lit(1)))).otherwise(0.0)
    risk = F.round(F.least(F.lit(1.0), F.greatest(rec, 0.92 * F.col("max_field"), 0.96 * F.col("max_span"), density)), 6)
    review = ((rec >= RECORD_REVIEW) & (anchors > 0)) | ((near > 0) & (anchors > 0)) | F.col("span_anchored") | ((anchors >= 2) & (rec >= MOSAIC_SIMILARITY))
    j = j.withColumns({"own": own, "risk": risk}).withColumn("decision", F.when(F.size("own") > 0, "BLOCK").when(review, "REVIEW").otherwise("ALLOW"))

    ids, shared = F.size("shared_ids"), F.size("shared_concepts")
    across = F.col("cross_language") & ((ids >= 2) | ((ids > 0) & (shared >= 3)) | ((shared >= 7) & (F.size("shared_numbers") >= 2)))
    strong = ((rec >= RECORD_REVIEW) & (anchors > 0)) | ((near >= 2) & (anchors > 0)) | F.col("span_anchored") | ((anchors >= MOSAIC_ANCHORS) & (rec >= MOSAIC_SIMILARITY))
    boundary = F.size(F.array_intersect("shared_concepts", F.array(*[F.lit(b) for b in C.BOUNDARY])))
    script = F.col("cross_language") & (F.col("candidate_language") == "ko") & (shared >= SCRIPT_CONCEPTS) & (boundary >= 2)
    j = j.withColumns({"across": across, "script": script})
    added = F.array_compact(F.array(F.when(F.col("across"), "MULTILINGUAL_SEMANTIC_LINEAGE_REUSE"), F.when(F.col("script"), "SCRIPT_SEMANTIC_LINEAGE_REUSE")))
    raised = F.col("across") | F.col("script")
    j = j.withColumns({
        "reasons": F.concat("own", added), "risk": F.when(raised, F.greatest("risk", F.lit(CROSS_RISK))).otherwise(F.col("risk")),
        "decision": F.when(raised, "BLOCK").when((F.col("decision") == "REVIEW") & ~strong, "ALLOW").otherwise(F.col("decision")),
    })
    only_dense = (F.size("reasons") == 1) & F.array_contains("reasons", "DENSE_PROTECTED_ANCHOR_REUSE")
    clean = F.col("role_conflict") & (F.col("decision") == "BLOCK") & only_dense & (ids == 0) & (F.size("exact_fields") == 0) & (near == 0)
    j = j.withColumn("typed_clean", clean)
    return j.select(
        *KEY, "record_similarity", "risk", F.when(F.col("typed_clean"), "ALLOW").otherwise(F.col("decision")).alias("decision"),
        F.when(F.col("typed_clean"), F.array(F.lit("TYPED_MEASUREMENT_ROLE_MISMATCH"))).otherwise(F.array_sort("reasons")).alias("reasons"),
        anchors.alias("n_anchors"), "shared_anchors", "exact_fields", "near_fields", "max_field", "spans", "max_span", F.coalesce("span_matches", F.array().cast("array<struct<c_path: string, r_path: string, similarity: double, shared: array<string>>>")).alias("span_matches"),
        "shared_ids", "shared_concepts", "shared_numbers", "candidate_language", "reference_language", "role_conflict", F.col("script").alias("script_match"), "typed_clean",
    )


def decisions(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per candidate: the worst pair (by decision, risk, similarity; ties: the smallest reference), raised by a mosaic.

    reasons are those of the worst pair and of the mosaic; typed_references and script_references name all pairs of these kinds.
    """
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("decision")]
    dense = (F.col("record_similarity") >= MOSAIC_SIMILARITY) & (F.col("n_anchors") >= MOSAIC_ANCHORS)
    worst = F.struct((-rank).alias("a"), (-F.col("risk")).alias("b"), (-F.col("record_similarity")).alias("c"), "reference_id", "decision", "risk", "record_similarity", "reasons")
    of = lambda keep: F.array_sort(F.collect_set(F.when(keep, F.col("reference_id"))))
    mosaic = (F.count_if(dense) >= MOSAIC_REFERENCES) & (F.coalesce(F.sum(F.when(dense, F.col("n_anchors"))), F.lit(0)) >= MOSAIC_TOTAL)
    g = scored.groupBy("candidate_id").agg(F.min(worst).alias("w"), mosaic.alias("m"), of(dense).alias("mosaic_references"), of(F.col("typed_clean")).alias("typed_references"), of(F.col("script_match")).alias("script_references"))
    j = candidates.select(F.col("case_id").alias("candidate_id")).where("candidate_id is not null").distinct().join(g, "candidate_id", "left")
    raised, empty = F.coalesce("m", F.lit(False)), F.array().cast(_STRINGS)
    reasons = F.array_sort(F.array_distinct(F.concat(F.coalesce("w.reasons", empty), F.when(raised, F.array(F.lit("MULTI_PROTECTED_REFERENCE_MOSAIC"))).otherwise(empty))))
    return j.select(
        "candidate_id", F.when(F.col("w.decision") != "ALLOW", F.col("w.reference_id")).alias("nearest_reference_id"), F.coalesce("w.record_similarity", F.lit(0.0)).alias("record_similarity"),
        F.when(raised, F.greatest(F.lit(MOSAIC_RISK), F.col("w.risk"))).otherwise(F.coalesce("w.risk", F.lit(0.0))).alias("risk"), F.when(raised, "BLOCK").otherwise(F.coalesce("w.decision", F.lit("ALLOW"))).alias("decision"), reasons.alias("reasons"),
        *[F.coalesce(c, empty).alias(c) for c in ("mosaic_references", "typed_references", "script_references")],
    )
