"""Mixing sources to target weights by pivotal dependent rounding.

Sources in the order of their code points (null last) weigh WEIGHTS, repeating.  Together they are to
give SHARE times the words of all documents, each by its weight but at most MOST times its own words;
what is above is shared anew by weight.  A source's target over its words is the rate at which each of
its documents is to be copied: the whole part of the rate is sure, the rest is a probability.

Rounding pairs two documents of a source and moves words of expected mass from one to the other, either
way with the odds that keep both expectations, until one of them is settled at 0 or 1 copies; the other
meets the next.  So a source's expected words never change.  Documents are dealt by hash into blocks of
about BLOCK; a block settles all of its documents but one, and these residuals are combined FAN blocks at
a time, in tasks, round by round.  The last residual of a source is settled by its probability.

The words that this last draw adds or lacks can be those of a long document.  So short documents of a
source, enough of them that the words of its longest fit into their rates SLACK times, wait: they are
rounded after the others, at a rate that takes up what the draw before them added or lacked (on average
nothing, so no expectation changes).  TIERS such tiers leave an error about the size of a short document.
Where all shorter documents together hold less, their rate stops at 0 or MOST, and the rest is the error.

All draws follow from a seed and the place in the reduction, and places from the rows' values alone:
reruns agree, on any cluster.

Defined cases: a null or empty text has size 0 and gives 0 words; a null source is a source; null ids
take part; rows equal in id, source and size are documents each; ties go by id; sources without words have
target 0; an empty table gives an empty result; extra columns, also those named like the results, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.core import numbered

from . import common
from . import textkernel as K

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK, FAN = 1024, 1024
TIERS = 3
#: The waiting documents' rates hold the words of the longest document before them so many times.
SLACK = 2
SEED = 20


@F.arrow_udf(T.LongType())
def n_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        n = np.zeros(len(texts), np.int64)
        for w in K.words(texts, hashed=False):
            n[w.lo : w.hi] = np.diff(w.ptr)
        yield pa.array(n)


def duel(a: float, size_a: int, b: float, size_b: int, u: float) -> tuple[float, float]:
    """New masses of two documents (0 < mass < size) after moving words from one to the other; one of them is 0 or full."""
    there, back = min(a, size_b - b), min(size_a - a, b)
    if u * (there + back) < back:
        return (0.0 if there == a else a - there), (float(size_b) if there == size_b - b else b + there)
    return (float(size_a) if back == size_a - a else a + back), (0.0 if back == b else b - back)


def pivot(sizes: list[int], masses: list[float], draws: np.ndarray) -> tuple[list[int], int | None, float]:
    """Copies (0 or 1) of documents in this order, the one left unsettled (or None), and its mass."""
    copies, held, mass = [0] * len(sizes), None, 0.0
    for k, (size, own) in enumerate(zip(sizes, masses)):
        if not 0 < own < size:
            copies[k] = int(size > 0 and own >= size)
            continue
        if held is None:
            held, mass = k, own
            continue
        old, new = duel(mass, sizes[held], own, size, draws[k])
        if 0 < old < sizes[held]:
            copies[k] = int(new > 0)
            mass = old
            continue
        copies[held] = int(old > 0)
        held, mass = (k, new) if 0 < new < size else (None, 0.0)
        if held is None:
            copies[k] = int(new > 0)
    return copies, held, mass


def waiting(classes: list[int], words: list[int], longest: list[int], rate: float, tiers: int = TIERS, most: float = MOST) -> list[int]:
    """Falling size classes: documents up to the k-th wait for tier k + 1.  classes rise; words and the longest document of each.

    The least that hold the words of the longest before them SLACK times within their rates wait; if none do, all shorter
    ones that hold anything, once.
    """
    room = min(rate, most - rate)
    upto = np.cumsum(np.array(words, dtype=float))
    out, top = [], len(classes) - 1
    while len(out) < tiers - 1 and top > 0 and room > 0 and upto[top - 1]:
        enough = np.flatnonzero(upto[:top] * room >= SLACK * longest[top])
        out.append(classes[int(enough[0])] if len(enough) else classes[top - 1])
        if not len(enough):
            break
        room -= longest[top] / upto[enough[0]]  # the most that the draw before can ask for
        top = int(enough[0])
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _waiting(classes: pa.Array, words: pa.Array, longest: pa.Array, rate: pa.Array) -> pa.Array:
    return pa.array([waiting(*row) for row in zip(classes.to_pylist(), words.to_pylist(), longest.to_pylist(), rate.to_pylist())], pa.list_(pa.int32()))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with sid (their number) and target."""
    order = F.struct(F.col("source").isNull().alias("n"), F.col("source").alias("s"))
    own = numbered(sources.withColumn("__o", order), [], "__o", "sid").drop("__o")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("sid") - 1) % len(weights)).cast("int"))
    own = common.stored(own.withColumn("weight", weight), common.scratch(sources.sparkSession, "sources"))
    cap = F.col("source_size") * F.lit(most)
    level, full = 0.0, None
    while True:  # water rises in all sources that aren't full; each pass fills at least one more, or ends
        now = F.col("weight") * F.lit(level) > cap
        r = own.agg(F.sum("source_size").alias("all"), F.sum(F.when(now, cap)).alias("held"), F.sum(F.when(~now & (F.col("source_size") > 0), F.col("weight"))).alias("open"), F.count_if(now).alias("full")).first()
        if not r["all"] or not r["open"] or r["full"] == full:
            break
        level, full = (share * r["all"] - (r["held"] or 0.0)) / r["open"], r["full"]
    target = F.least(F.col("weight") * F.lit(level), cap)
    if share >= most:
        target = cap
    return own.withColumn("target", target).drop("weight")


_OUT = "sid long, tier int, block long, blocks long, doc_id long, source string, size long, copy long, source_size long, target double, base int, mass double, copies int, carry double"
_KEEP = ["sid", "tier", "doc_id", "source", "size", "copy", "source_size", "target"]


def _settle(seed: int, level: int):
    """Blocks of documents in order to their copies; a block's residual goes on, or is drawn if its source has but this block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            sid, tier, block, blocks = (t[c][0].as_py() for c in ("sid", "tier", "block", "blocks"))
            sizes, rng = t["size"].to_pylist(), np.random.default_rng([seed, sid, tier, level, block])
            draws = rng.random(len(sizes) + 1)
            copies, left, mass = pivot(sizes, t["mass"].to_pylist(), draws)
            carry: list = [None] * len(sizes)
            total = [b + c for b, c in zip(t["base"].to_pylist(), copies)]
            masses: list = [None] * len(sizes)
            if left is not None and blocks == 1:
                taken = int(draws[-1] * sizes[left] < mass)
                total[left] += taken
                carry[left] = mass - taken * sizes[left]
            elif left is not None:
                total[left], masses[left] = None, mass
            new = {"block": pa.array([block // FAN] * len(sizes), pa.int64()), "blocks": pa.array([-(-blocks // FAN)] * len(sizes), pa.int64()), "mass": pa.array(masses, pa.float64())}
            own = [new[c] if c in new else t[c].combine_chunks() for c in ("sid", "tier", "block", "blocks", "doc_id", "source", "size", "copy", "source_size", "target", "base", "mass")]
            return pa.RecordBatch.from_arrays([*own, pa.array(total, pa.int32()), pa.array(carry, pa.float64())], names=["sid", "tier", "block", "blocks", *_KEEP[2:], "base", "mass", "copies", "carry"])

        for batch in batches:
            keys = list(zip(batch["sid"].to_pylist(), batch["block"].to_pylist()))
            lo = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[lo]:
                    if held and keys[lo] != at:
                        yield close()
                        held = []
                    at = keys[lo]
                    held.append(batch.slice(lo, k - lo))
                    lo = k
        if held:
            yield close()

    return run


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, and taken: the words that the mix takes of each document."""
    spark = docs.sparkSession
    path = common.scratch(spark, "mixing")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy")
    light = common.stored(rows.groupBy("doc_id", "source", "size").count().select("doc_id", "source", "size", copy), f"{path}/light")
    kind = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")
    hist = light.groupBy("source", kind.alias("class")).agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("words"), F.max("size").alias("longest"))
    hist = common.stored(hist, f"{path}/hist")
    sources = targets(hist.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)

    # which classes of a source wait, and how many blocks each tier has
    by_class = hist.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("class", "docs", "words", "longest"))).alias("h"))  # at most 64 rows a source
    plan = sources.join(by_class.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0))
    plan = common.stored(plan.withColumn("ends", _waiting("h.class", "h.words", "h.longest", "rate")), f"{path}/plan")
    tier_of = lambda c: F.size(F.filter("ends", lambda e: c <= e))
    tiers = plan.select("sid", F.col("source").alias("s"), "source_size", "target", "rate", "ends", F.explode("h").alias("x")).withColumn("tier", tier_of(F.col("x.class")))
    tiers = tiers.groupBy("sid", "tier").agg(F.sum("x.docs").alias("docs"), F.sum("x.words").alias("words"))
    tiers = common.stored(tiers.withColumn("blocks", F.ceil(F.col("docs") / BLOCK)), f"{path}/tiers")
    shape = {r["tier"]: r["blocks"] for r in tiers.groupBy("tier").agg(F.max("blocks").alias("blocks")).collect()}  # a row a tier

    # rates rise or fall from tier to tier by what the draw before added or lacked, over all words that still wait
    now = plan.select("sid", "rate")
    known = plan.select("sid", F.col("source").alias("s"), "source_size", "target", "ends")
    items = light.join(known, F.col("source").eqNullSafe(F.col("s"))).withColumn("tier", tier_of(kind)).drop("s", "ends")
    items = common.stored(items, f"{path}/items")
    done = []
    for tier in sorted(shape):
        own = tiers.where(F.col("tier") == tier).select(F.col("sid").alias("i"), "blocks").join(now.withColumnRenamed("sid", "j"), F.col("i") == F.col("j")).drop("j")
        own = common.stored(own, f"{path}/rates{tier}")
        nodes = items.where(F.col("tier") == tier).join(own, F.col("sid") == F.col("i")).drop("i")
        sure = F.least(F.floor("rate"), F.lit(int(most))).cast("int")
        nodes = nodes.withColumn("base", sure).withColumn("mass", F.greatest(F.col("rate") - sure, F.lit(0.0)) * F.col("size"))
        nodes = nodes.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "copy"), F.col("blocks"))).drop("rate")
        drawn = []
        for level in range(1 + math.ceil(math.log(max(shape[tier], 1), FAN) - 1e-9)):
            dealt = nodes.repartition("sid", "block").sortWithinPartitions("sid", "block", F.desc("size"), "doc_id", "copy")
            out = common.stored(dealt.mapInArrow(_settle(seed, level), _OUT), f"{path}/tier{tier}-{level}")
            drawn.append(out.where("copies is not null"))
            nodes = out.where("copies is null").drop("copies", "carry")
        done += drawn
        carry = drawn[0]
        for d in drawn[1:]:
            carry = carry.union(d)
        carry = carry.where("carry is not null").select(F.col("sid").alias("j"), "carry")
        later = tiers.where(F.col("tier") > tier).groupBy(F.col("sid").alias("i")).agg(F.sum("words").alias("pool"))
        moved = now.join(later, F.col("sid") == F.col("i"), "left").join(carry, F.col("sid") == F.col("j"), "left")
        rate = F.col("rate") + F.when(F.col("pool") > 0, F.coalesce("carry", F.lit(0.0)) / F.col("pool")).otherwise(0.0)
        now = common.stored(moved.select("sid", F.greatest(F.least(rate, F.lit(most)), F.lit(0.0)).alias("rate")), f"{path}/now{tier}")
    if not done:
        return light.select("doc_id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("copies"), F.lit(0).cast("long").alias("taken"))
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    return every.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
