"""Frames of texts: domain rules, typed management frames bound within sentences, and vetoes of inherited conditions.

detect(): rule tables of seven domains over clauses or whole texts, by a table function that is joined laterally.
management(): event and condition mentions of one pass with their places; spans nest (sentence, clause, coordination), and an
event takes the nearest condition of the narrowest span that holds both, never one of another sentence unless it says so.
vetoed(): conditions that a frame took over from beyond its own coordination are dropped where their shape doesn't fit, or where another variable is nearer.

Null texts have no frames, empty ones neither; texts with equal ids are kept apart by their rows in detect() and are one text
in management(); an empty table gives an empty result; extra columns are ignored unless said otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- domain rules


@dataclass(frozen=True)
class Rule:
    """A frame that is there if each of `needs` has a pattern that is found, and none of `unless`.

    Subject and object may name groups of the first pattern found of the last needs, as $1 and so on.  Of the rules of a
    group only the first that holds counts.  per: clause or text; bears: whether it takes the clause's condition.
    words: every text that meets the rule holds one of them, so patterns are tried on those texts only (none: on all).
    """

    domain: str
    event: str
    subject: str
    object: str
    polarity: str
    needs: tuple[tuple[str, ...], ...]
    unless: tuple[str, ...] = ()
    per: str = "text"
    group: str = ""
    bears: bool = False
    words: tuple[str, ...] = ()


_NAME = r"[a-z0-9._-]+"
#: Which cues a domain reads is configuration; these are the defaults.  Fixed values: events, subjects and objects.
DOMAIN_RULES = [
    Rule("management", "INITIATION_RESTRICTION", "drug_initiation", "initiation", "POSITIVE", ((r"(?:initiation|starting|beginning)[^.;]{0,90}(?:not recommended|advised against)", r"not[- ]recommended initiation"),), per="clause", bears=True),
    Rule("management", "CONTRAINDICATION", "drug_use", "use", "NEGATIVE", ((r"contraindicat",), (r"\bnot\b[^.;]{0,50}contraindicat", r"\bno\b[^.;]{0,50}contraindicat")), per="clause", group="contraindication", bears=True),
    Rule("management", "CONTRAINDICATION", "drug_use", "use", "POSITIVE", ((r"contraindicat",),), per="clause", group="contraindication", bears=True),
    Rule("management", "BENEFIT_RISK_REASSESSMENT", "drug_use", "benefit_risk", "POSITIVE", ((r"\b(?:reassess|review|reconsider)\w*[^.;]{0,70}(?:benefit|risk)",),), per="clause", bears=True),
    Rule("management", "DISCONTINUATION", "drug_use", "drug", "NEGATIVE", ((r"discontinu|withdraw|\bstop",), (r"\b(?:not|never|without|rather than)\b[^.;]{0,35}(?:discontinu|stop|withdraw)",)), per="clause", group="stop", bears=True),
    Rule("management", "DISCONTINUATION", "drug_use", "drug", "POSITIVE", ((r"discontinu|withdraw|\bstop",),), per="clause", group="stop", bears=True),
    Rule("pharmacovigilance", "SIGNAL_DETECTION", "spontaneous_report_system", "safety_signal", "POSITIVE", ((r"spontaneous|reporting system|faers",), (r"signal",), (r"detect|identif|generat|screen",))),
    Rule("pharmacovigilance", "CAUSALITY_ESTABLISHMENT", "evidence", "causal_relation", "NEGATIVE", ((r"caus",), (r"(?:cannot|not|never)\b[^.;]{0,40}(?:establish|prove|demonstrate)",)), group="causality"),
    Rule("pharmacovigilance", "CAUSALITY_ESTABLISHMENT", "evidence", "causal_relation", "POSITIVE", ((r"caus",), (r"establish|prove|demonstrate",)), group="causality"),
    Rule("pharmacovigilance", "INCIDENCE_ESTIMATION", "report_count", "event_incidence", "NEGATIVE", ((r"report counts?|number of reports",), (r"incidence",), (r"cannot|\bnot\b",)), group="incidence"),
    Rule("pharmacovigilance", "INCIDENCE_ESTIMATION", "report_count", "event_incidence", "POSITIVE", ((r"report counts?|number of reports",), (r"incidence",), (r"estimat|give|calculat",)), group="incidence"),
    Rule("trial", "STUDY_STATUS", "study", "recruiting", "POSITIVE", ((r"study|trial|registry",), (r"recruiting|open to enrol",)), group="status"),
    Rule("trial", "STUDY_STATUS", "study", "completed", "POSITIVE", ((r"study|trial|registry",), (r"completed|has ended",)), group="status"),
    Rule("trial", "PRIMARY_ENDPOINT_DECLARATION", "study", "primary_endpoint", "POSITIVE", ((r"primary (?:endpoint|outcome)",), (r"declar|list|specif|regist",))),
    Rule("trial", "ENDPOINT_ACHIEVEMENT_EVIDENCE", "evidence", "primary_endpoint", "NEGATIVE", ((r"primary (?:endpoint|outcome)",), (r"(?:no|not|without)\b[^.;]{0,40}(?:result|met|achiev)",)), group="endpoint"),
    Rule("trial", "ENDPOINT_ACHIEVEMENT", "study", "primary_endpoint", "POSITIVE", ((r"primary (?:endpoint|outcome)",), (r"\bmet\b|achiev",)), group="endpoint"),
    Rule("guideline", "SUPERSESSION", "$1", "$2", "POSITIVE", ((rf"(guideline\s+{_NAME})\s+(?:explicitly\s+)?(?:replaces|supersedes|displaces)\s+(guideline\s+{_NAME})",),)),
    Rule("guideline", "CURRENTNESS", "$1", "recommendation_source", "POSITIVE", ((r"current|in force",), (rf"(guideline\s+{_NAME})\s+(?:explicitly\s+)?(?:replaces|supersedes|displaces)\s+(guideline\s+{_NAME})",))),
    Rule("guideline", "CURRENTNESS", "$2", "recommendation_source", "NEGATIVE", ((r"current|in force",), (rf"(guideline\s+{_NAME})\s+(?:explicitly\s+)?(?:replaces|supersedes|displaces)\s+(guideline\s+{_NAME})",))),
    Rule("guideline", "TRIAL_OPTION_SUPPORT", "trial", "$1", "POSITIVE", ((rf"(?:trial|study|experiment)[^.;]{{0,80}}?(?:favors|supports)\s+(?:option\s+|strategy\s+|treatment\s+)?({_NAME})",),)),
    Rule("guideline", "CURRENTNESS", "current_guideline", "$1", "POSITIVE", ((rf"current\s+guideline[^.;]{{0,80}}?(?:still\s+|continues?\s+to\s+)?recommends?\s+(?:option\s+|strategy\s+|treatment\s+)?({_NAME})",),)),
    Rule("pgx", "ASSOCIATION", "genotype", "drug_exposure", "POSITIVE", ((r"genotype",), (r"exposure",), (r"associat|relationship|higher|greater",))),
    Rule("pgx", "MANAGEMENT_RULE_AVAILABILITY", "mechanism_or_pk_evidence", "drug_pair_or_patient", "NEGATIVE", ((r"genotype",), (r"(?:no|not|without)\b[^.;]{0,40}(?:dose|management|rule)",))),
    *(Rule("diagnostic", "DIAGNOSTIC_CLASSIFICATION", "lesion", c, "POSITIVE", ((rf"\b{c}\b",), (r"finding|lesion",), (r"classif|categor|report",)), group="class") for c in ("indeterminate", "malignant", "benign")),
    Rule("biomarker", "ASSOCIATION", "$1", "$2", "NEGATIVE", ((rf"(biomarker\s+{_NAME})\s+(?:is|was)?\s*(?:explicitly\s+)?not\s+associated\s+with\s+(outcome\s+{_NAME})",),), group="biomarker"),
    Rule("biomarker", "ASSOCIATION", "$1", "$2", "POSITIVE", ((rf"(biomarker\s+{_NAME})\s+(?:is|was)?\s*(?:explicitly\s+)?associated\s+with\s+(outcome\s+{_NAME})",),), group="biomarker"),
    Rule("biomarker", "ASSOCIATION", "$1", "$2", "NEGATIVE", ((rf"(biomarker\s+{_NAME})\s+(?:shows?|showed)\s+no\s+association\s+with\s+(outcome\s+{_NAME})",),), group="biomarker"),
    Rule("biomarker", "ASSOCIATION", "$1", "$2", "NEGATIVE", ((rf"(biomarker\s+{_NAME})\s+(?:is|was)\s+unrelated\s+to\s+(outcome\s+{_NAME})",),), group="biomarker"),
    Rule("biomarker", "ASSOCIATION", "$1", "$2", "POSITIVE", ((rf"relationship\s+between\s+(biomarker\s+{_NAME})\s+and\s+(outcome\s+{_NAME})",),), group="biomarker"),
]
#: Words of the default rules, by event: each of an event's rules needs one of them, literally.
_WORDS = {
    "INITIATION_RESTRICTION": ("recommended", "advised against"), "CONTRAINDICATION": ("contraindicat",), "BENEFIT_RISK_REASSESSMENT": ("benefit", "risk"), "DISCONTINUATION": ("discontinu", "withdraw", "stop"),
    "SIGNAL_DETECTION": ("signal",), "CAUSALITY_ESTABLISHMENT": ("caus",), "INCIDENCE_ESTIMATION": ("incidence",), "STUDY_STATUS": ("recruiting", "open to enrol", "completed", "has ended"), "PRIMARY_ENDPOINT_DECLARATION": ("primary ",), "ENDPOINT_ACHIEVEMENT_EVIDENCE": ("primary ",), "ENDPOINT_ACHIEVEMENT": ("primary ",),
    "SUPERSESSION": ("replaces", "supersedes", "displaces"), "CURRENTNESS": ("current", "in force"), "TRIAL_OPTION_SUPPORT": ("favors", "supports"), "MANAGEMENT_RULE_AVAILABILITY": ("genotype",), "DIAGNOSTIC_CLASSIFICATION": ("finding", "lesion"), "ASSOCIATION": ("genotype", "biomarker"),
}
DOMAIN_RULES = [replace(r, words=_WORDS[r.event]) for r in DOMAIN_RULES]
#: Where clauses part.
CLAUSE_END = [r"\s*;\s*", r"([.!?])\s+", r"\s+\b(?:but|whereas|while|yet)\b\s+"]
#: A clause's condition, as (operator, pattern); the first that is found.
CLAUSE_CONDITIONS = [
    ("RANGE", r"egfr[^.;]{0,20}?(\d+(?:\.\d+)?)\s*(?:through|to|-)\s*(\d+(?:\.\d+)?)"), ("RANGE", r"between\s+(?:egfr\s*)?(\d+(?:\.\d+)?)\s+and\s+(\d+(?:\.\d+)?)"),
    ("LT", r"egfr(?:\s+is|\s+falls|\s+drops)?\s*(?:below|under|less\s+than|lower\s+than|<)\s*(\d+(?:\.\d+)?)"), ("LT", r"(?:below|under|less\s+than|lower\s+than|<)\s*egfr\s*(\d+(?:\.\d+)?)"),
    ("EQ", r"egfr\s*(?:of|=|is|at)?\s*(\d+(?:\.\d+)?)"),
]
_FRAME = "domain string, event string, subject string, object string, polarity string, operator string, value double, low double, high double, clause int, source_span string"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "–—", "--"), r"\s+", " "))


def _slot(template: str, m: re.Match | None) -> str:
    if not template.startswith("$"):
        return template
    name = m[int(template[1:])].strip(".,;:()[]{}") if m else ""
    return re.sub(r"[^a-z0-9]+", "_", name).strip("_")


def detector(rules: list[Rule] = DOMAIN_RULES):
    """A table function of a text in normal form: its frames by the rules."""
    table = {kind: [(r, [[re.compile(p) for p in n] for n in r.needs], [re.compile(p) for p in r.unless]) for r in rules if r.per == kind] for kind in ("clause", "text")}
    ends, conditions = [re.compile(p) for p in CLAUSE_END], [(op, re.compile(p)) for op, p in CLAUSE_CONDITIONS]

    def condition(scope: str) -> tuple:
        found = next(((op, [float(x) for x in m.groups()]) for op, p in conditions if (m := p.search(scope))), (None, []))
        numbers = (None, min(found[1]), max(found[1])) if found[0] == "RANGE" else (*found[1], None, None) if found[1] else (None, None, None)
        return (found[0], *numbers)

    class Frames:
        def eval(self, text: str) -> Iterator[tuple]:
            if not text:
                return
            cut = text
            for end in ends:
                cut = end.sub(lambda m: (m[1] if m.re.groups else "") + "\x1f", cut)
            scopes = [(k, c.strip(" ,"), "clause") for k, c in enumerate(cut.split("\x1f"))] + [(-1, text, "text")]
            for k, scope, kind in scopes:
                done = set()
                for r, needs, unless in table[kind]:
                    if (r.group and r.group in done) or (r.words and not any(w in scope for w in r.words)):
                        continue
                    hits = [next((m for p in n if (m := p.search(scope))), None) for n in needs]
                    if all(hits) and not any(p.search(scope) for p in unless):
                        done.add(r.group)
                        about = condition(scope) if r.bears else (None,) * 4
                        yield (r.domain, r.event, _slot(r.subject, hits[-1]), _slot(r.object, hits[-1]), r.polarity, *about, k, scope)

    return F.udtf(Frames, returnType=_FRAME)


def detect(texts: DataFrame, key: str, text: str = "text", rules: list[Rule] = DOMAIN_RULES) -> DataFrame:
    """(key, the frame's fields): frames of each row's text; clause is -1 for frames of the whole text."""
    rows = texts.select(key, normal(F.col(text)).alias("__t")).where("__t <> ''")
    return rows.lateralJoin(detector(rules)(F.col("__t").outer())).drop("__t")


# ---- typed management frames

#: Events of management.
EVENTS = {
    "INITIATION_RESTRICTION": r"\b(?:initiation|starting|beginning|commencing)[^.;]{0,90}(?:not recommended|advised against|discourag\w*|rule against)|\bnot[- ]recommended\s+initiation\b",
    "BENEFIT_RISK_REASSESSMENT": r"\b(?:reassess\w*|reassessment|review\w*|reconsider\w*)\b[^.;]{0,70}(?:benefit|risk)|(?:benefit[- ]?risk|benefit and risk)[^.;]{0,70}\b(?:reassess\w*|review\w*|reconsider\w*)\b",
    "DISCONTINUATION": r"\b(?:discontinu(?:e|ed|ation|ing)|withdraw(?:n|al)?|stop(?:ping|ped)?)\b",
    "CONTRAINDICATION": r"\bcontraindicat\w*\b",
}
#: Conditions by operator.
CONDITIONS = [
    ("RANGE", r"(?:egfr(?: values?)?\s*)?(?:from\s+)?(\d+(?:\.\d+)?)\s*(?:through|to|-)\s*(\d+(?:\.\d+)?)"), ("RANGE", r"between\s+(?:egfr\s*)?(\d+(?:\.\d+)?)\s+and\s+(\d+(?:\.\d+)?)"),
    ("LT", r"egfr(?:\s+(?:is|falls|drops|slips))?\s*(?:below|under|less\s+than|lower\s+than|<)\s*(\d+(?:\.\d+)?)"), ("LT", r"(?:below|under|less\s+than|lower\s+than|<)\s*egfr\s*(\d+(?:\.\d+)?)"),
    ("LT", r"kidney\s+function[^.;]{0,20}(?:falls|drops|is)?\s*(?:below|under|<)\s*(\d+(?:\.\d+)?)"), ("EQ", r"(?:at|with)\s+(?:an?\s+)?egfr\s*(?:of\s*)?(\d+(?:\.\d+)?)"), ("EQ", r"egfr\s*(?:of|=|is|at)\s*(\d+(?:\.\d+)?)"),
]
#: Variables of the two kinds, references back, and shapes that references ask for.
RENAL = r"\begfr\b|\bkidney\s+function\b|\brenal\s+(?:value|threshold|function)\b"
OTHER = r"\b(?:age|platelets?(?:\s+count)?|ha?emoglobin|potassium|creatinine|blood\s+pressure|oxygen\s+saturation|bilirubin|alanine\s+aminotransferase|alt|qtc|torsades|dialysis|urine\s+output|fever|toxicity)\b"
BACK = r"\b(?:same|that|this)\s+(?:egfr|renal\s+threshold)|\bat\s+the\s+same\s+egfr\b"
SAME_VALUE = r"\bsame\s+(?:renal\s+)?(?:value|measurement|reading)\b"
REACH = 120
#: Words around an event that deny it, as (event, pattern), within 80 characters before and 90 after its start.
DENIED = [
    ("CONTRAINDICATION", r"\b(?:not|no)\b[^.;]{0,50}contraindicat|does\s+not[^.;]{0,80}contraindicat"),
    ("DISCONTINUATION", r"\b(?:not|never)\b[^.;]{0,35}(?:discontinu|stop|withdraw)|rather\s+than[^.;]{0,35}(?:automatically\s+)?(?:discontinu|stop|withdraw)|without[^.;]{0,35}(?:discontinu|stop|withdraw)"),
]
#: What ends the nested spans.
SPAN_ENDS = [("sentence", r"[.!?]\s+"), ("clause", r";\s*"), ("coordination", r",?\s+(?:and|but|whereas|while|yet|or)\s+")]
_MARKS = "array<struct<kind: string, name: string, start: int, end: int, value: double, low: double, high: double, around: string>>"
_MARKS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.float64()), ("low", pa.float64()), ("high", pa.float64()), ("around", pa.string())]))


def marks(text: Column) -> Column:
    """Every event (with the text around it), condition, variable, reference and end of a span in a text in normal form, in one pass, by place."""
    table = [("event", n, re.compile(p)) for n, p in EVENTS.items()] + [("condition", op, re.compile(p)) for op, p in CONDITIONS]
    table += [("variable", "renal", re.compile(RENAL)), ("variable", "other", re.compile(OTHER)), ("back", "back", re.compile(BACK))] + [("end", n, re.compile(p)) for n, p in SPAN_ENDS]

    def of(t: str) -> list[dict]:
        out, seen = [], set()
        for kind, name, p in table:
            for m in p.finditer(t):
                if kind == "condition" and (m.start(), m.end()) in seen:
                    continue
                seen.add((m.start(), m.end())) if kind == "condition" else None
                n = [float(x) for x in m.groups()] if kind == "condition" else []
                two = name == "RANGE" and len(n) == 2
                out.append({"kind": kind, "name": name, "start": m.start(), "end": m.end(), "value": n[0] if n and not two else None, "low": min(n) if two else None, "high": max(n) if two else None, "around": t[max(0, m.start() - 80) : m.start() + 90] if kind == "event" else None})
        return sorted(out, key=lambda x: (x["start"], x["end"], x["kind"], x["name"]))

    @F.arrow_udf(_MARKS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else of(t) for t in texts.to_pylist()], _MARKS_ARROW)

    return run(text)


def nested(spots: DataFrame, key: str) -> DataFrame:
    """spots (key, kind, name, start, ...) with `sentence`, `clause` and `coordination`: how many spans of each level ended before.

    Levels nest: a sentence's end also ends its clauses.  One sweep by place over a text's marks.
    """
    before = Window.partitionBy(key).orderBy("start", "end", "kind", "name").rowsBetween(Window.unboundedPreceding, -1)
    level = lambda *names: F.coalesce(F.sum(F.when((F.col("kind") == "end") & F.col("name").isin(*names), 1).otherwise(0)).over(before), F.lit(0)).cast("int")
    return spots.withColumns({"sentence": level("sentence"), "clause": level("sentence", "clause"), "coordination": level("sentence", "clause", "coordination")})


LEVELS = ("sentence", "clause", "coordination")


def _swept(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Events with their level's counts and, of the nearest rows before (b) and after (a), the condition, the reference and the variable.

    Texts stay where they are read: only marks are shuffled, once, and all sweeps go by one order.  As spans are runs of marks,
    the nearest condition of a span is the nearest of all if that is in the span.
    """
    rows = texts.select(key, normal(F.col(text)).alias("__t")).withColumn("single", F.col("__t").rlike(SAME_VALUE))
    spots = rows.select(key, "single", F.explode(marks(F.col("__t"))).alias("m")).select(key, "single", "m.*")
    denied = F.coalesce(*[F.when((F.col("name") == n) & F.col("around").rlike(p), "NEGATIVE") for n, p in DENIED], F.lit("POSITIVE"))
    placed = nested(spots.withColumn("polarity", F.when(F.col("kind") == "event", denied)).drop("around"), key)
    what = F.struct(F.col("start").alias("at"), *LEVELS, "name", "value", "low", "high")
    placed = placed.withColumns({k: F.when(F.col("kind") == k, what) for k in ("condition", "back", "variable")})
    quoted = f"`{key.replace('`', '``')}`"
    near = lambda f, c: F.expr(f"{f}({c}) IGNORE NULLS OVER (PARTITION BY {quoted} ORDER BY start, end, kind, name)")
    sides = {f"{s}_{c}": near(f, c) for s, f in (("b", "lag"), ("a", "lead")) for c in ("condition", "back")} | {"b_variable": near("lag", "variable")}
    return placed.withColumns(sides).where("kind = 'event'")


def _bound(events: DataFrame) -> Column:
    """struct<how, what>: the condition that a swept event is bound to."""

    def within(n: str) -> Column:
        b, a = (F.when(F.col(f"{s}_condition.{n}") == F.col(n), F.col(f"{s}_condition")) for s in ("b", "a"))
        return F.when(a.isNotNull() & (b.isNull() | (a["at"] - F.col("start") < F.col("start") - b["at"])), a).otherwise(b)

    refers = F.coalesce(F.col("b_back.sentence") == F.col("sentence"), F.lit(False)) | F.coalesce(F.col("a_back.sentence") == F.col("sentence"), F.lit(False))
    back = F.when(refers & F.col("b_condition").isNotNull(), F.struct(F.lit("reference").alias("how"), F.col("b_condition").alias("what")))
    return F.coalesce(*[F.when(within(n).isNotNull(), F.struct(F.lit(n).alias("how"), within(n).alias("what"))) for n in reversed(LEVELS)], back)


def _named(events: DataFrame, key: str, *more: str) -> DataFrame:
    b = events.withColumn("b", _bound(events)).withColumn("bound", F.coalesce("b.how", F.lit("none")))
    return b.select(key, F.col("name").alias("event"), "start", "polarity", F.col("b.what.name").alias("operator"), F.col("b.what.value").alias("value"), F.col("b.what.low").alias("low"), F.col("b.what.high").alias("high"), "bound", *more)


def management(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, event, start, polarity, operator, value, low, high, bound): events with the conditions they are bound to.

    bound: the narrowest span that event and condition share (coordination, clause, sentence), `reference` for a condition of an
    earlier sentence that the sentence refers to, or none.  Of a span's conditions the nearest counts, the earlier on a tie.
    """
    return _named(_swept(texts, key, text), key)


def vetoed(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """management() with `veto`: a taken-over condition (bound beyond the own coordination) that must not hold is dropped.

    reference_shape: the text speaks of the same single value, but the condition is a range.  local_variable: the last variable
    named before the event, within REACH characters, is another one.
    """
    j = _named(_swept(texts, key, text), key, "single", "b_variable")
    taken = F.col("bound").isin("clause", "sentence", "reference")
    veto = F.when(taken & F.col("single") & (F.col("operator") == "RANGE"), "reference_shape").when(taken & (F.col("b_variable.name") == "other") & (F.col("start") - F.col("b_variable.at") <= REACH), "local_variable")
    kept = lambda c: F.when(F.col("veto").isNull(), F.col(c)).alias(c)
    return j.withColumn("veto", veto).select(key, "event", "start", "polarity", kept("operator"), kept("value"), kept("low"), kept("high"), "bound", "veto")
