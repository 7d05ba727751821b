"""Rule-table extraction: cues with offsets, ownership of events, carry-over, requested slots, routing by negation.

Rules are data: (name, pattern) pairs turned into one Arrow pass that returns spans; what follows is windows
and joins over the spans, so rule sets of any size share the same plan.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.core import rule_holds

SENTENCE = r"[^.!?。！？\n]+"


def sentences(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, number, sentence, start, end): spans in characters, end exclusive."""
    found = df.select(key, F.col(text).alias("__t"), F.posexplode(X.spans(F.col(text), {"s": SENTENCE})).alias("number", "s"))
    return found.select(key, "number", F.substring(F.col("__t"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("sentence"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def mentions(df: DataFrame, keys: list[str], text: str, rules: dict[str, str]) -> DataFrame:
    """(keys, kind, start, end, negated) of every cue of the lower-case text; negated as functions.text.negated_at() says."""
    found = df.select(*keys, F.lower(F.col(text)).alias("__t")).select(*keys, "__t", F.explode(X.spans(F.col("__t"), rules)).alias("m"))
    return found.select(*keys, F.col("m.kind").alias("kind"), F.col("m.start").alias("start"), F.col("m.end").alias("end"), X.negated_at(F.col("__t"), F.col("m.start"), F.col("m.end")).alias("negated"))


def phrase_mentions(df: DataFrame, keys: list[str], text: str, groups: dict[str, list[str]]) -> DataFrame:
    """mentions() of literal phrases by group, found without Python."""
    low = df.select(*keys, F.lower(F.trim(text)).alias("__t"))
    found = low.select(*keys, "__t", X.rows_of(X.phrase_hits(F.col("__t"), groups)).alias("m")).where("m is not null").select(*keys, "__t", "m.*")
    return found.withColumn("negated", X.negated_at(F.col("__t"), F.col("start"), F.col("end"))).drop("__t")


def longest_only(found: DataFrame, keys: list[str]) -> DataFrame:
    """Without spans that lie within a longer one of the same text; equal spans of different kinds are ambiguous."""
    w = Window.partitionBy(*keys)
    spans = F.collect_list(F.struct("start", "end")).over(w)  # the cues of one short text
    inside = F.exists("__all", lambda x: (x["start"] <= F.col("start")) & (x["end"] >= F.col("end")) & ((x["end"] - x["start"]) > (F.col("end") - F.col("start"))))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "start", "end"))
    return found.withColumn("__all", spans).where(~inside).drop("__all").withColumn("ambiguous", same > 1)


def owned_windows(found: DataFrame, keys: list[str]) -> DataFrame:
    """Each mention's window: from the middle between it and the mention before to the middle to the next."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    return found.withColumn("own_from", F.coalesce(F.floor((before + F.col("start")) / 2), F.lit(0)).cast("int")).withColumn("own_to", F.floor((F.col("end") + after) / 2).cast("int"))


def nearest(events: DataFrame, conditions: DataFrame, keys: list[str], most: int = 120) -> DataFrame:
    """Events with the nearest condition of their text within `most` characters (ties: the earlier)."""
    c = conditions.select(*keys, F.struct(F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("kind").alias("condition")).alias("c"))
    gap = F.greatest(F.col("start") - F.col("c.c_end"), F.col("c.c_start") - F.col("end"), F.lit(0))
    j = events.join(c, keys, "left").withColumn("gap", gap).withColumn("c", F.when(F.col("gap") <= most, F.col("c")))
    return j.groupBy(*keys, "kind", "start", "end", "negated").agg(F.min_by("c.condition", F.struct("gap", "c.c_start")).alias("condition"))


def carried(rows: DataFrame, key: str, number: str, value: str) -> DataFrame:
    """A sentence without the value takes that of the sentence just before it, one step only."""
    return rows.withColumn(value, F.coalesce(value, F.lag(value).over(Window.partitionBy(key).orderBy(number))))


def inherited_if_unique(clauses: DataFrame, sentence: list[str], value: str) -> DataFrame:
    """A clause without the value takes the sentence's, if that has exactly one."""
    w = Window.partitionBy(*sentence)
    one = F.size(F.collect_set(value).over(w)) == 1
    return clauses.withColumn(value, F.coalesce(value, F.when(one, F.max(value).over(w))))


def overriding(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New frames, and old ones whose keys no new frame has."""
    return new.unionByName(old.join(new.select(keys).distinct(), keys, "left_anti"))


def abstaining(frames: DataFrame, key: str, guard: Column) -> DataFrame:
    """Nothing of a text whose guard holds for any of its frames."""
    return frames.join(frames.where(F.coalesce(guard, F.lit(False))).select(key).distinct(), key, "left_anti")


def features(texts: DataFrame, key: str, text: str, groups: dict[str, list[str]]) -> DataFrame:
    """(key, group, positive): a group is positive if one of its phrases is found and none is negated."""
    found = phrase_mentions(texts, [key], text, groups)
    return found.groupBy(key, F.col("kind").alias("group")).agg((~F.bool_or("negated")).alias("positive"))


def routed(texts: DataFrame, key: str, positive: DataFrame, rules: list[tuple[str, float, list[str], list[str], list[str]]], fallback: str) -> DataFrame:
    """(key, intent, score): priority plus 0.01 for each matched group; the earlier rule wins a tie, the fallback scores 0."""
    have = positive.where("positive").groupBy(key).agg(F.collect_set("group").alias("f"))
    j = texts.select(key).join(have, key, "left").withColumn("f", F.coalesce("f", F.array().cast("array<string>")))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    scored = [F.when(rule_holds(F.col("f"), lit(a), lit(b), lit(c)), F.struct((F.lit(p) + 0.01 * F.size(F.array_intersect(lit([*a, *b]), F.col("f")))).alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("name"))) for k, (name, p, a, b, c) in enumerate(rules)]
    best = F.array_max(F.array_compact(F.array(*scored)))
    return j.select(key, F.coalesce(best["name"], F.lit(fallback)).alias("intent"), F.coalesce(best["score"], F.lit(0.0)).alias("score"))


#: Names under which a source may be excluded.
SOURCE_ALIASES = {
    "PUBMED": ["pubmed", "医学文献", "同行评议文献", "文献"],
    "CLINICALTRIALS_GOV": ["clinicaltrials.gov", "trial registry", "试验注册", "临床试验注册"],
    "DAILYMED_SPL": ["dailymed", "产品标签", "美国说明书", "当前说明书", "最新说明书", "处方信息"],
    "DRUGS_AT_FDA": ["drugs@fda", "drugs at fda"],
    "OPENFDA_FAERS": ["faers", "自发不良事件", "自发报告", "不良事件系统"],
    "RXNORM": ["rxnorm"],
    "LOINC": ["loinc"],
}


def excluded_sources(texts: DataFrame, key: str, text: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, source) of sources one of whose names is negated in the text."""
    found = phrase_mentions(texts, [key], text, SOURCE_ALIASES if aliases is None else aliases)
    return found.where("negated").select(key, F.col("kind").alias("source")).distinct()


def ranked_sources(intents: DataFrame, key: str, policy: DataFrame, excluded: DataFrame, most: int = 3) -> DataFrame:
    """(key, sources): the intent's policy (intent, ranked array) without excluded (key, source), cut to `most`, order kept."""
    out = excluded.groupBy(key).agg(F.collect_set("source").alias("x"))
    j = intents.join(policy, "intent", "left").join(out, key, "left")
    keep = F.filter(F.coalesce("ranked", F.array().cast("array<string>")), lambda s: ~F.coalesce(F.array_contains("x", s), F.lit(False)))
    return j.select(key, "intent", F.slice(keep, 1, most).alias("sources"))


#: Shares of the claim's words that support it, in full and in part.
SUPPORT, PARTIAL = 0.62, 0.38
#: Fixed values: (relation, cue, what the evidence says, what the claim says), tried in this order.
LEXICAL_RULES = [
    ("CONTRADICTS", "explicit_causality_limitation", ["cannot by themselves establish a causal", "cannot establish a causal", "causality requires other evidence"], ["proves that the drug caused", "proves causality", "caused the reported adverse"]),
    ("CONTRADICTS", "explicit_incidence_limitation", ["cannot be used to estimate", "cannot estimate", "report counts cannot"], ["true adverse-event incidence", "true incidence", "obtain the incidence"]),
    ("CONTRADICTS", "explicit_supersession", ["superseded", "supersedes"], ["version 1 remains the current", "old guideline remains current"]),
    ("CONTRADICTS", "explicit_temporal_limitation", ["has not yet been revised", "still recommends", "has not yet changed"], ["automatically means", "guideline now recommends"]),
    ("DOES_NOT_SUPPORT", "explicit_scope_limitation", ["does not specify", "does not state", "contains no", "management must be supported separately"], ["supports replacing", "clinically contraindicated", "dose must be changed", "must be changed"]),
    ("DOES_NOT_SUPPORT", "registry_to_efficacy_guard", ["registry", "registered", "clinicaltrials.gov"], ["proves that the treatment is clinically effective", "proves efficacy"]),
    ("DOES_NOT_SUPPORT", "risk_to_diagnosis_guard", ["possible serious adverse", "possible", "can precipitate"], ["confirmed serotonin syndrome", "has confirmed"]),
]
BELOW = r"(?:below|<)\s*(\d+)"


def lexical_verdict(claim: Column, evidence: Column) -> Column:
    """struct(relation, score, cue) of a claim by the words of its evidence: cue rules first, then the share of its words.

    A claim without words has score 0; null texts give null.
    """
    c, e = F.lower(claim), F.lower(evidence)
    score = X.containment(F.array_distinct(X.words_c(claim)), F.array_distinct(X.words_c(evidence)))
    out = lambda relation, cue: F.struct(F.lit(relation).alias("relation"), score.alias("score"), F.lit(cue).alias("cue"))
    found = F.when(score >= SUPPORT, out("DIRECT_SUPPORT", "high_lexical_overlap")).when(score >= PARTIAL, out("PARTIAL_SUPPORT", "medium_lexical_overlap")).otherwise(out("DOES_NOT_SUPPORT", "low_lexical_overlap"))
    low = lambda t: F.regexp_extract(t, BELOW, 1)
    other = F.contains(c, F.lit("contraindicat")) & F.contains(e, F.lit("contraindicat")) & (low(c) != "") & (low(e) != "") & (low(c) != low(e))
    found = F.when(other, out("CONTRADICTS", "threshold_mismatch")).otherwise(found)
    says = lambda t, phrases: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in phrases])
    for relation, cue, of_evidence, of_claim in reversed(LEXICAL_RULES):
        found = F.when(says(e, of_evidence) & says(c, of_claim), out(relation, cue)).otherwise(found)
    return F.when(claim.isNotNull() & evidence.isNotNull(), found)


#: Comparison words of conditions.
CONDITIONS = [
    ("RANGE", r"between\s+(\d+(?:\.\d+)?)\s+and\s+(\d+(?:\.\d+)?)"), ("LT", r"(?:below|under|less than|<)\s*(\d+(?:\.\d+)?)"), ("LTE", r"(?:at most|<=|≤)\s*(\d+(?:\.\d+)?)"),
    ("GT", r"(?:above|over|more than|>)\s*(\d+(?:\.\d+)?)"), ("GTE", r"(?:at least|>=|≥)\s*(\d+(?:\.\d+)?)"), ("EQ", r"(?:of|is|=)\s*(\d+(?:\.\d+)?)"),
]


def conditions(text: Column, variable: str, others: tuple[str, ...] = ()) -> Column:
    """array<struct<operator, value, low, high>> of what is said about a numeric variable, in reading order.

    A comparison is not the variable's where one of `others` (patterns of names) is said between them.
    """
    foreign = [re.compile(rf"\b(?:{o})\b", re.I) for o in others]
    compiled = [(op, re.compile(rf"\b{variable}\b[^.;\n]{{0,20}}?{p}", re.I)) for op, p in CONDITIONS]
    kind = "array<struct<operator: string, value: double, low: double, high: double>>"
    arrow = pa.list_(pa.struct([("operator", pa.string()), ("value", pa.float64()), ("low", pa.float64()), ("high", pa.float64())]))

    def of(s: str) -> list[dict]:
        found, taken = [], []
        for op, p in compiled:
            for m in p.finditer(s):
                if any(a < m.end() and m.start() < b for a, b in taken) or any(o.search(m[0], len(variable)) for o in foreign):
                    continue
                taken.append(m.span())
                low, high = (float(m[1]), float(m[2])) if op == "RANGE" else (None, None)
                found.append((m.start(), {"operator": op, "value": None if op == "RANGE" else float(m[1]), "low": low, "high": high}))
        return [x for _, x in sorted(found, key=lambda y: y[0])]

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else of(v) for v in values.to_pylist()], arrow)

    return run(text)
