"""Frames to propositions: registries, first-kept repeats, coordination segments, probes of claimed regions.

Everything is joins, windows and built-in expressions, but for the cutting of texts.  Null texts give no rows; an empty table gives an empty result; rows
that repeat are dropped by compile_frames() and kept elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X

from .core import pick
from .entail import bounds, covers, holds

#: Where an independent statement begins.
SEPARATOR = r"\s*;\s*|,\s*(?:and|but|whereas|while|yet)\s+|\s+(?:but|whereas|while|yet)\s+"
OPERATORS = ["EQ", "LT", "LTE", "GT", "GTE", "RANGE"]
POLARITIES = ["POSITIVE", "NEGATIVE", "UNKNOWN"]


def segments(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number, segment, start, end) between separators of the text in lower case; spans without the blanks and marks at their ends."""
    low = texts.select(key, F.lower(F.col(text)).alias("t")).where("t is not null")
    # one pass over a text: built-in split and extraction read it twice, and cost most of the time
    each = low.select(key, F.posexplode_outer(X.pieces(F.col("t"), SEPARATOR)).alias("number", "x")).select(key, "number", F.col("x.part").alias("raw"), F.col("x.at").alias("at"))
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^[ ,;]+", ""))
    body = F.regexp_replace("raw", r"^[ ,;]+|[ ,;]+$", "")
    return each.select(key, "number", body.alias("segment"), (F.col("at") + lead).alias("start"), (F.col("at") + lead + F.length(body)).alias("end")).where("segment <> ''")


#: Characters of the blocks of places by which events meet segments; a segment lies in as many blocks as it touches.
BLOCK = 512


def bound_in_segment(events: DataFrame, conditions: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Events (key, kind, start, condition) with the nearest condition (key, start, condition) of their own segment.

    Without one in the segment, a condition inherited from elsewhere is dropped, unless the segment is the text's first.
    Work grows with a text's marks, not with their pairs: events meet segments by blocks of places, and one sweep over the places
    of a key names the conditions next to an event; the nearest of its segment is one of them, if the segment has any.
    """
    block = lambda c: F.floor(c / BLOCK)
    spans = parts.where("end > start").select(F.col(key).alias("__k"), F.col("start").alias("s"), F.col("end").alias("e"))
    spans = spans.select("*", F.explode(F.sequence(block(F.col("s")), block(F.col("e") - 1))).alias("__b"))
    said = events.select(F.col(key).alias("__k"), F.lit(1).alias("__event"), "kind", "start", F.col("condition").alias("inherited"), F.lit(None).alias("__c"))
    known = conditions.select(F.col(key).alias("__k"), F.lit(0).alias("__event"), F.lit(None).alias("kind"), "start", F.lit(None).alias("inherited"), F.struct(F.col("start").alias("c"), "condition").alias("__c"))
    side = lambda order: F.expr(f"last_value(__c) IGNORE NULLS OVER (PARTITION BY __k ORDER BY {order}, __c.condition DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    swept = said.union(known).where("__k is not null").withColumns({"__before": side("start, __event"), "__after": side("start DESC, __event DESC")}).where("__event = 1")
    j = swept.withColumn("__b", block(F.col("start"))).join(spans, ["__k", "__b"]).where("start >= s and start < e")
    inside = lambda c: F.when((F.col(f"{c}.c") >= F.col("s")) & (F.col(f"{c}.c") < F.col("e")), F.struct(F.abs(F.col(f"{c}.c") - F.col("start")).alias("d"), f"{c}.c", f"{c}.condition"))
    g = j.groupBy("__k", "__b", "kind", "start", "s", "inherited").agg(F.min(F.least(inside("__before"), inside("__after"))).alias("n")).withColumn("near", F.col("n.condition"))
    how = F.when(F.col("near").isNotNull(), "nearest").when(F.col("inherited").isNotNull() & (F.col("s") > 0), "dropped").otherwise("kept")
    return g.select(F.col("__k").alias(key), "kind", "start", F.when(how == "nearest", F.col("near")).when(how == "kept", F.col("inherited")).alias("condition"), how.alias("rebind"))


def compile_frames(frames: DataFrame, registry: DataFrame) -> DataFrame:
    """Frames (text_id, pos, event, subject, object, population, condition) as propositions by a registry (event, predicate, polarity).

    Of equal propositions of a text the first by pos stays; frames of unknown events are left out.
    """
    known = frames.join(F.broadcast(registry), "event")
    same = ["text_id", "subject", "predicate", "object", "polarity", "population", "condition"]
    return pick(known, same, [F.col("pos"), F.col("event")]).select(*same, "pos")


def registry_faults(propositions: DataFrame, predicates: DataFrame, variables: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted propositions, texts with abstain) by a registry of predicates (predicate, critical).

    propositions: text_id, subject, predicate, object, polarity, confidence, variable, operator, value, low, high (operator
    null: no condition).  A text abstains if a faulty proposition has a critical predicate; unknown predicates are critical.
    """
    p = propositions.withColumns({"subject": F.lower(F.trim("subject")), "predicate": F.upper(F.trim("predicate")), "polarity": F.upper(F.trim("polarity"))})
    j = p.join(F.broadcast(predicates.select("predicate", "critical").distinct()), "predicate", "left")
    op, asks = F.col("operator"), F.col("operator").isNotNull()
    rules = F.array_compact(F.array(
        F.when(F.coalesce("subject", F.lit("")) == "", "EMPTY_SUBJECT"), F.when(F.col("critical").isNull(), "UNKNOWN_PREDICATE"), F.when(~F.coalesce(F.col("polarity").isin(POLARITIES), F.lit(False)), "INVALID_POLARITY"),
        F.when(~F.coalesce(F.coalesce("confidence", F.lit(0.0)).between(0, 1), F.lit(False)), "CONFIDENCE_OUT_OF_RANGE"), F.when(asks & ~F.coalesce(F.col("variable").isin(variables), F.lit(False)), "UNKNOWN_VARIABLE"), F.when(asks & ~op.isin(OPERATORS), "UNKNOWN_OPERATOR"),
        F.when(op.isin("EQ", "LT") & F.col("value").isNull(), "MISSING_VALUE"), F.when((op == "RANGE") & (F.col("low").isNull() | F.col("high").isNull()), "MISSING_BOUNDS"),
    ))
    checked = j.withColumn("faults", rules)
    bad = (F.size("faults") > 0) & F.coalesce("critical", F.lit(True))
    texts = checked.groupBy("text_id").agg(F.count(F.lit(1)).alias("propositions"), F.count_if(F.size("faults") > 0).alias("unresolved"), F.bool_or(bad).alias("abstain"))
    return checked.where(F.size("faults") == 0).drop("faults", "critical"), texts


def probed(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, claim_id, probes, supported, conflicts, verdict): a claimed region, looked at in three points.

    claims: case_id, claim_id, predicate, population, operator (LT or RANGE), value, low, high; evidence: case_id, predicate,
    population, operator, value, low, high (positive actions).  Another action at any point contradicts; the claimed one at all
    points supports; else there is no support.  A point where both hold supports.
    """
    v, lo, hi = (F.col(c).cast("double") for c in ("value", "low", "high"))
    below = F.array(*[F.greatest(F.lit(0.0), v - d) for d in (1, 5, 14)])
    points = F.when(F.col("operator") == "LT", below).when(F.col("operator") == "RANGE", F.array(lo, (lo + hi) / 2, hi))
    p = claims.select("case_id", "claim_id", F.col("predicate").alias("said"), F.col("population").alias("of"), F.explode(F.array_distinct(points)).alias("at"))
    e = evidence.select("case_id", "predicate", "population", bounds(F.col("operator"), v, lo, hi).alias("b")).distinct()
    j = p.join(e, "case_id", "left").withColumn("here", F.coalesce(covers(F.col("population"), F.col("of")) & holds(F.col("b"), F.col("at")), F.lit(False)))
    at = j.groupBy("case_id", "claim_id", "at").agg(F.bool_or(F.col("here") & (F.col("predicate") == F.col("said"))).alias("same"), F.bool_or("here").alias("any"))
    g = at.groupBy("case_id", "claim_id").agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.coalesce("same", F.lit(False))).alias("supported"), F.count_if(F.col("any") & ~F.coalesce("same", F.lit(False))).alias("conflicts"))
    verdict = F.when(F.col("conflicts") > 0, "CONTRADICTED").when(F.col("supported") == F.col("probes"), "SUPPORTED").otherwise("UNSUPPORTED")
    return g.withColumn("verdict", verdict)
