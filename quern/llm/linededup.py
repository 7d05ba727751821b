"""Line dedup over overlapping windows of three lines.

Lines are what newlines part, without blanks at their ends; blank lines don't count, and stay.  Every
three consecutive lines of a document are a window, known by a 128-bit hash.  The first occurrence of
a window over all documents, in the order of doc_id and position, stays; all later ones are removed,
whichever windows overlap them: a line goes if any removed window covers it.

The windows' first places are aggregated before the shuffle and stored, so the join back to the windows has
plain shuffles on both sides: Spark splits a window that a third of all documents hold.

Defined cases: documents of under three lines have no window and stay as they are, so do null and
empty texts; null ids come last; rows equal in id and text are one document and lose the same lines;
an empty table gives an empty result; extra columns stay, those named like the results are replaced.

Passages inside lines have no such window.  passages() finds every run of PASSAGE words, wherever lines
end: the first occurrence of a run stays, all words that later ones cover go.  A run's least seed of SEED
words is the same wherever the run occurs, so only runs whose least seed occurs twice are hashed; no
repeated run is missed.  A run that overlaps its own first occurrence is not a later one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textkernel as K

WINDOW = 3
PASSAGE, SEED = 51, 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def without(text: str, starts: list[int], window: int = WINDOW) -> tuple[str, int]:
    """text without the lines that windows beginning at these counted lines cover, and how many these are."""
    lines = text.split("\n")
    counted = np.array([bool(x.strip(BLANKS)) for x in lines])
    covered = np.zeros(int(counted.sum()) + window, bool)
    at = np.array(starts, np.int64)
    for k in range(window):
        covered[at + k] = True
    gone = np.zeros(len(lines), bool)
    gone[counted] = covered[: int(counted.sum())]
    return "\n".join(x for x, g in zip(lines, gone.tolist()) if not g), int(gone.sum())


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("removed", T.IntegerType())]))
def _without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, starts in batches:
        pairs = [(None, 0) if t is None or s is None else without(t, s) for t, s in zip(texts.to_pylist(), starts.to_pylist())]
        yield pa.StructArray.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int32())], ["text", "removed"])


def windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each window: the document (id, th), the first line's number `at`, and the hash (h1, h2)."""
    hashed = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.transform(_lines(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))).alias("l")
    )
    at = F.explode(F.transform(F.sequence(F.lit(0), F.size("l") - WINDOW), lambda i: F.struct(i.alias("at"), F.xxhash64(*[F.get("l", i + k)["a"] for k in range(WINDOW)]).alias("h1"), F.xxhash64(*[F.get("l", i + k)["b"] for k in range(WINDOW)]).alias("h2"))))
    return hashed.where(F.size("l") >= WINDOW).select("id", "th", at.alias("w")).select("id", "th", "w.*")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text cleaned, n_lines (lines that counted before) and removed_lines."""
    every = windows(docs, doc_id, text)
    place = F.struct(F.col("id").isNull().alias("n"), "id", "th", "at")
    first = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = common.stored(first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"), common.scratch(docs.sparkSession, "first-windows"))
    later = every.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where(~place.eqNullSafe(F.col("first")))
    gone = later.groupBy("id", "th").agg(F.collect_set("at").alias("__starts")).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "__starts")
    joined = docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    cut = _without(F.when(F.col("__starts").isNotNull(), F.col(text)), F.col("__starts"))
    return (
        joined.withColumn("__cut", cut)
        .withColumn("n_lines", F.coalesce(F.size(_lines(F.col(text))), F.lit(0)).cast("long"))
        .withColumn("removed_lines", F.coalesce(F.col("__cut.removed"), F.lit(0)).cast("long"))
        .withColumn(text, F.coalesce("__cut.text", text))
        .drop("__id", "__th", "__starts", "__cut")
    )


def least_seeds(h: np.ndarray, words: int = PASSAGE, seed: int = SEED) -> np.ndarray:
    """Of each run of `words` word hashes, the place of its least seed (the first of equals)."""
    if len(h) < words:
        return np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(K.ngrams(h, seed), words - seed + 1)
    return seen.argmin(axis=1) + np.arange(len(seen))


def _lists(counts: list[int], parts: list[list[np.ndarray]], names: list[str], kinds: list[pa.DataType]) -> pa.ListArray:
    """A list of structs for each text, of columns that come in parts."""
    cols = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.StructArray.from_arrays([pa.array(c.view(np.int64), pa.int64()).cast(k) for c, k in zip(cols, kinds)], names))


def _seeder(words: int, seed: int):
    @F.arrow_udf("array<struct<at: int, h: long>>")
    def seeds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, at, hashes = [], [], []
            for w in K.words(texts):
                for r in range(w.hi - w.lo):
                    h = w.hashes[w.ptr[r] : w.ptr[r + 1]]
                    places = np.unique(least_seeds(h, words, seed))
                    counts.append(len(places))
                    at.append(places)
                    hashes.append(K.ngrams(h, seed)[places])
            yield _lists(counts, [at, hashes], ["at", "h"], [pa.int32(), pa.int64()])

    return seeds


def _runner(words: int, seed: int):
    @F.arrow_udf("array<struct<at: int, h1: long, h2: long>>")
    def runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, seeds in batches:
            counts, at, one, two = [], [], [], []
            for w in K.words(texts):
                for r in range(w.hi - w.lo):
                    h = w.hashes[w.ptr[r] : w.ptr[r + 1]]
                    places = np.flatnonzero(np.isin(least_seeds(h, words, seed), np.array(seeds[w.lo + r].as_py(), np.int64)))
                    counts.append(len(places))
                    at.append(places)
                    one.append(K.ngrams(h, words)[places])
                    two.append(K.ngrams(K.mix(h + np.uint64(0xA24BAED4963EE407)), words)[places])
            yield _lists(counts, [at, one, two], ["at", "h1", "h2"], [pa.int32(), pa.int64(), pa.int64()])

    return runs


def without_passages(text: str, ranges: list[tuple[int, int]]) -> tuple[str, int, int]:
    """text without the words of these ranges (ends exclusive), how many words go and how many stay."""
    spans = [m.span() for m in WORD.finditer(text)]
    gone = np.zeros(len(spans) + 1, np.int8)
    for a, b in ranges:
        gone[a + 1 : b + 1] = 1
    turn = np.flatnonzero(np.diff(np.append(gone, 0))).reshape(-1, 2).tolist()
    out, at = [], 0
    for a, b in turn:
        last, after = (spans[a - 1][1] if a else 0), (spans[b][0] if b < len(spans) else len(text))
        before, behind = text[last : spans[a][0]], text[spans[b - 1][1] : after]
        out += [text[at:last], before if not a or (b < len(spans) and "\n" in before) else behind]
        at = after
    removed = sum(b - a for a, b in turn)
    return "".join([*out, text[at:]]), removed, len(spans) - removed


def _passage_cutter():
    @F.arrow_udf("text string, removed long, stay long")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            rows = [(None, 0, None) if t is None or s is None else without_passages(t, [(x["a"], x["b"]) for x in s]) for t, s in zip(texts.to_pylist(), ranges.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["text", "removed", "stay"])

    return cut


def _ranger(words: int):
    """array<struct<a, b>>: the words that runs from an array of starts cover; b is exclusive."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    @F.arrow_udf("array<struct<a: int, b: int>>")
    def ranges(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            out = []
            for v in lists:
                at = np.unique(v.values.to_numpy())
                new = np.flatnonzero(np.diff(at) > words) + 1
                heads, tails = at[np.append(0, new)], at[np.append(new, len(at)) - 1] + words
                out.append([{"a": a, "b": b} for a, b in zip(heads.tolist(), tails.tolist())])
            yield pa.array(out, kind)

    return ranges


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """docs with text cleaned of repeated runs, removed_words, and emptied (no word is left of some).

    What is joined back (seeds that occur twice, first places, ranges that go) is stored first, so that Spark knows its size and
    sends it to the other side where it is small; where it is not, both sides are plain shuffles, and one hot seed is split.
    """
    path = common.scratch(docs.sparkSession, "passages")
    own = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    seeds = common.stored(own.select("id", "th", F.explode(_seeder(words, seed)(F.col("t"))).alias("s")).select("id", "th", "s.*"), f"{path}/seeds")
    twice = common.stored(seeds.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"), f"{path}/twice")
    some = seeds.join(twice, "h").groupBy(F.col("id").alias("i"), F.col("th").alias("x")).agg(F.collect_set("at").alias("seeds"))
    some = common.stored(some, f"{path}/some")
    held = own.join(some, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("x"))).select("id", "th", F.explode(_runner(words, seed)(F.col("t"), F.col("seeds"))).alias("r"))
    every = common.stored(held.select("id", "th", "r.*"), f"{path}/runs")
    place = F.struct(F.col("id").isNull().alias("n"), "id", "th", "at")
    first = every.groupBy(F.col("h1").alias("f1"), F.col("h2").alias("f2")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    first = common.stored(first, f"{path}/first")
    near = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")) & (F.col("at") < F.col("first.at") + words)
    later = every.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where(~near)
    gone = later.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("at").alias("at"))
    gone = gone.select("__id", "__th", _ranger(words)(F.col("at")).alias("__gone"))
    gone = common.stored(gone, f"{path}/gone")
    joined = docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    cut = _passage_cutter()(F.when(F.col("__gone").isNotNull(), F.col(text)), F.col("__gone"))
    return (
        joined.withColumn("__cut", cut)
        .withColumn("removed_words", F.coalesce(F.col("__cut.removed"), F.lit(0)).cast("long"))
        .withColumn("emptied", F.coalesce(F.col("__cut.stay") == 0, F.lit(False)))
        .withColumn(text, F.coalesce("__cut.text", text))
        .drop("__id", "__th", "__gone", "__cut")
    )
