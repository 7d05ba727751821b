"""Two verifiers of a claim by its evidence, as ordered ladders over what cues say of both texts.

semantic(): labels of both texts; conflicts, then escalations, then numbers, then labels in common, then shared words.
framed(): a frame of each text (modalities, limitations, relations, numeric conditions with the action around them, causal
and temporal status); the ladder compares the frames, and last the words that the frames are made of.

Ladders are lists of rules: the first rule that holds decides.  Null texts count as empty, empty ones say nothing; rows
that repeat are decided alike; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.automaton import Cues

from .propositions import entity, normal

#: Labels of a text by its cues.
LABELS = {
    "CONTRAINDICATED": ["contraindicated", "absolute contraindication"],
    "INITIATION_NOT_RECOMMENDED": ["initiation", "starting", "start"],
    "DISCONTINUE": ["discontinue", "stop the drug", "must stop", "must discontinue"],
    "REASSESS": ["reassess benefit", "assess benefit and risk", "reassessing benefit"],
    "INCREASE_RISK": ["increase bleeding risk", "increased bleeding risk", "increase risk", "higher risk", "risk is increased"],
    "REPLACEMENT_REGIMEN": ["replacing", "replace ", "replacement analgesic", "every 6 hours", "every six hours"],
    "POSSIBLE_SERIOUS_EVENT": ["possible serious adverse", "can precipitate", "may precipitate", "possible adverse"],
    "CONFIRMED_DIAGNOSIS": ["confirmed serotonin syndrome", "confirmed diagnosis", "has serotonin syndrome", "definitely has"],
    "SIGNAL_DETECTION": ["safety signal", "signal detection"],
    "CAUSALITY_PROVEN": ["proves that the drug caused", "proves causality", "establishes causality", "caused the reported adverse"],
    "CAUSALITY_LIMITED": ["cannot by themselves establish a causal", "cannot establish a causal", "causality requires other evidence", "not proven causality"],
    "INCIDENCE_ESTIMABLE": ["true adverse-event incidence", "true incidence", "obtain the incidence", "estimate incidence from report counts"],
    "INCIDENCE_LIMITED": ["cannot be used to estimate", "cannot estimate incidence", "report counts cannot"],
    "REGISTRY_ONLY": ["registry", "registered", "clinicaltrials.gov"],
    "STATUS_COMPLETED": ["status completed", "as completed"],
    "PRIMARY_ENDPOINT": ["prespecified primary endpoint", "registered primary endpoint"],
    "EFFICACY_PROVEN": ["proves that the treatment is clinically effective", "proves efficacy", "endpoint was successfully met"],
    "SUPERSEDES": ["supersedes", "superseded"],
    "OLD_REMAINS_CURRENT": ["version 1 remains the current", "old guideline remains current"],
    "GUIDELINE_NOT_CHANGED": ["guideline has not yet", "still recommends", "recommendation has not yet changed"],
    "GUIDELINE_CHANGED": ["guideline now recommends", "automatically means that the current guideline", "current guideline now"],
    "TRIAL_SUPPORTS_NEW_EVIDENCE": ["new randomized trial supports", "evidence landscape has changed"],
    "CYP_SUBSTRATE": ["cyp3a substrate", "cyp substrate"],
    "CYP_INHIBITOR": ["cyp3a inhibitor", "cyp inhibitor"],
    "PK_INTERACTION": ["pharmacokinetic interaction", "pk interaction", "interaction mechanism involving cyp"],
    "CLINICAL_CONTRAINDICATION": ["clinically contraindicated together", "are contraindicated together"],
    "PK_ASSOCIATION": ["changes drug exposure", "pharmacokinetic association", "changes exposure"],
    "DOSE_CHANGE_REQUIRED": ["dose must be changed", "must change the dose", "dose change is required"],
    "MANAGEMENT_UNRESOLVED": ["management must be supported separately", "leaving clinical management unresolved", "no therapeutic-management recommendation"],
    "EXPLICIT_NO_REPLACEMENT": ["does not specify a replacement", "does not specify replacement", "no replacement analgesic regimen"],
}
#: Fixed values: (relation, cue, labels the evidence has, labels one of which the claim has), in this order; the threshold rule is between.
CONFLICTS = [
    ("causality_level_conflict", ["CAUSALITY_LIMITED"], ["CAUSALITY_PROVEN"]),
    ("incidence_level_conflict", ["INCIDENCE_LIMITED"], ["INCIDENCE_ESTIMABLE"]),
    ("temporal_supersession_conflict", ["SUPERSEDES"], ["OLD_REMAINS_CURRENT"]),
    ("guideline_temporal_conflict", ["GUIDELINE_NOT_CHANGED"], ["GUIDELINE_CHANGED"]),
]
ESCALATIONS = [
    ("risk_to_contraindication_escalation", ["INCREASE_RISK"], ["CONTRAINDICATED", "CLINICAL_CONTRAINDICATION"]),
    ("unsupported_replacement_regimen", ["EXPLICIT_NO_REPLACEMENT"], ["REPLACEMENT_REGIMEN"]),
    ("risk_to_diagnosis_escalation", ["POSSIBLE_SERIOUS_EVENT"], ["CONFIRMED_DIAGNOSIS"]),
    ("registration_to_efficacy_escalation", ["REGISTRY_ONLY"], ["EFFICACY_PROVEN"]),
    ("mechanism_to_management_escalation", ["CYP_SUBSTRATE", "CYP_INHIBITOR"], ["CLINICAL_CONTRAINDICATION"]),
    ("pk_to_management_escalation", ["PK_ASSOCIATION", "MANAGEMENT_UNRESOLVED"], ["DOSE_CHANGE_REQUIRED"]),
]
#: Fixed values: (cue, labels the evidence has, labels the claim has, labels the claim lacks); all that hold support directly.
SUPPORTS = [
    ("same_management_modality", ["CONTRAINDICATED"], ["CONTRAINDICATED"], []),
    ("same_management_modality", ["INITIATION_NOT_RECOMMENDED"], ["INITIATION_NOT_RECOMMENDED"], []),
    ("same_management_modality", ["DISCONTINUE"], ["DISCONTINUE"], []),
    ("same_risk_relation", ["INCREASE_RISK"], ["INCREASE_RISK"], []),
    ("same_signal_scope", ["SIGNAL_DETECTION"], ["SIGNAL_DETECTION"], []),
    ("same_registry_status", ["STATUS_COMPLETED"], ["STATUS_COMPLETED"], []),
    ("same_registry_endpoint", ["PRIMARY_ENDPOINT"], ["PRIMARY_ENDPOINT"], []),
    ("same_temporal_relation", ["SUPERSEDES"], ["SUPERSEDES"], []),
    ("same_temporal_state", ["GUIDELINE_NOT_CHANGED"], ["GUIDELINE_NOT_CHANGED"], []),
    ("same_pk_relation", ["PK_ASSOCIATION"], ["PK_ASSOCIATION"], []),
    ("same_management_uncertainty", ["MANAGEMENT_UNRESOLVED"], ["MANAGEMENT_UNRESOLVED"], []),
    ("bounded_pk_interaction_inference", ["CYP_SUBSTRATE", "CYP_INHIBITOR"], ["PK_INTERACTION"], []),
    ("evidence_changed_guideline_unchanged", ["TRIAL_SUPPORTS_NEW_EVIDENCE", "GUIDELINE_NOT_CHANGED"], ["TRIAL_SUPPORTS_NEW_EVIDENCE", "GUIDELINE_NOT_CHANGED"], []),
    ("signal_without_causality_escalation", ["CAUSALITY_LIMITED"], ["SIGNAL_DETECTION"], ["CAUSALITY_PROVEN"]),
    ("registry_endpoint_bounded_support", ["REGISTRY_ONLY"], ["PRIMARY_ENDPOINT"], ["EFFICACY_PROVEN"]),
]
#: Shares of the claim's words that the evidence has, for direct and for partial support.
LITERAL, PARTLY = 0.78, 0.48
#: Numbers about the variable.
RANGES = r"egfr[^.;,]{0,30}?(\d+)\s*(?:to|[-–])\s*(\d+)"
BELOW = r"(?:egfr[^.;,]{0,30}?(?:below|under|<)|(?:below|under|<)\s*)(\d+)"
EXACT = r"egfr\s*(?:of|=|is)?\s*(\d+)"


def _out(relation: str, cue: str | Column) -> Column:
    return F.struct(F.lit(relation).alias("relation"), (F.lit(cue) if isinstance(cue, str) else cue).alias("cue"))


#: Numbers from here on, such as a telephone number after "under", count as this one.
VAST = 10**18


def _ints(t: Column, pattern: str, group: int = 1) -> Column:
    plain = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda x: F.ltrim(x, F.lit("0")))
    return F.transform(plain, lambda x: F.when(F.length(x) <= 18, F.concat(F.lit("0"), x).cast("long")).otherwise(VAST))


def _words(t: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.length(x) > 2))


def _share(of: Column, among: Column) -> Column:
    return F.size(F.array_intersect(of, among)) / F.greatest(F.size(of), F.lit(1))


def _all(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, xs, F.lit(True))


def _any(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, xs, F.lit(False))


def _both(cases: DataFrame, evidence: str, claim: str, found: Callable[[Column], Column]) -> DataFrame:
    t = lambda c: normal(F.coalesce(F.col(c), F.lit("")))
    return cases.withColumns({"__e": t(evidence), "__c": t(claim)}).withColumns({"__ef": found(F.col("__e")), "__cf": found(F.col("__c"))})


SEMANTIC = Cues([p for ps in LABELS.values() for p in ps])


def semantic(cases: DataFrame, evidence: str = "evidence", claim: str = "claim") -> DataFrame:
    """cases with relation and cue (of several supporting cues all, in order, joined by +)."""
    e, c = F.col("__e"), F.col("__c")
    ea = lambda *names: _all([SEMANTIC.has(F.col("__ef"), *LABELS[n]) for n in names])
    ca = lambda *names: _all([SEMANTIC.has(F.col("__cf"), *LABELS[n]) for n in names])
    # columns of their own, so that each pattern is looked for once and not by every rule that asks for it
    numbers = {"__be": _ints(e, BELOW), "__bc": _ints(c, BELOW), "__re": F.zip_with(_ints(e, RANGES), _ints(e, RANGES, 2), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), "__rc": F.concat(_ints(c, RANGES), _ints(c, RANGES, 2)), "__xc": _ints(c, EXACT), "__share": _share(_words(c), _words(e))}
    below_e, below_c, ranges, value, share = (F.col(x) for x in ("__be", "__bc", "__re", "__value", "__share"))
    bounds_c = F.concat("__bc", "__rc")
    stated = {"__value": F.get(F.filter("__xc", lambda v: ~F.array_contains(bounds_c, v)), F.lit(0)), "__cues": F.array_compact(F.array(*[F.when(ea(*a) & ca(*b) & ~_any([ca(x) for x in no]), cue) for cue, a, b, no in SUPPORTS]))}
    named = (F.size(below_e) > 0) & (F.size(below_c) > 0)
    top = F.array_max(below_c)
    mismatch = named & ((ca("DISCONTINUE") & ea("REASSESS") & F.array_contains(below_e, top) & F.contains(e, F.lit("below 45")) & (top == 45)) | (ca("CONTRAINDICATED") & ea("CONTRAINDICATED") & (F.array_min(below_c) != F.array_min(below_e))))
    in_range = F.exists(ranges, lambda r: (value >= r["a"]) & (value <= r["b"])) & ea("INITIATION_NOT_RECOMMENDED")
    under = lambda stem: F.exists(below_e, lambda t: value < t) & F.contains(e, F.lit(stem))
    rules = [(ea(*a) & _any([ca(x) for x in b]), _out("CONTRADICTS", cue)) for cue, a, b in CONFLICTS]
    rules += [(mismatch, _out("CONTRADICTS", "threshold_action_mismatch"))]
    rules += [(ea(*a) & _any([ca(x) for x in b]), _out("DOES_NOT_SUPPORT", cue)) for cue, a, b in ESCALATIONS]
    rules += [(ca("INITIATION_NOT_RECOMMENDED") & in_range, _out("DIRECT_SUPPORT", "range_rule_application"))]
    rules += [(ca(name) & under(stem), _out("DIRECT_SUPPORT", "threshold_rule_application")) for name, stem in (("DISCONTINUE", "discontinu"), ("CONTRAINDICATED", "contraindicat"))]
    rules += [(F.size("__cues") > 0, _out("DIRECT_SUPPORT", F.array_join("__cues", "+")))]
    rules += [(share >= LITERAL, _out("DIRECT_SUPPORT", "very_high_literal_entailment")), (share >= PARTLY, _out("PARTIAL_SUPPORT", "partial_literal_overlap"))]
    decided = F.coalesce(*[F.when(holds, out) for holds, out in rules], _out("DOES_NOT_SUPPORT", "insufficient_semantic_match"))
    return _both(cases, evidence, claim, SEMANTIC.found).withColumns(numbers).withColumns(stated).withColumn("__v", decided).select(*[F.col(x) for x in cases.columns], "__v.*")


# ---- frames

#: Cues of modalities and of limitations.
MODALITIES = {
    "CONTRAINDICATED": ["contraindicat"],
    "DISCONTINUE": ["discontinu", "must stop", "must discontinue", "stop immediately"],
    "REASSESS": ["reassess", "benefit and risk", "benefit/risk"],
    "NOT_RECOMMENDED": ["not recommended"],
    "RISK_INCREASE": ["increase bleeding risk", "increased bleeding risk", "increase risk", "higher risk", "risk is increased"],
    "POSSIBLE": ["possible adverse", "possible serious", "may precipitate", "can precipitate", "may cause", "can cause"],
    "DIAGNOSIS_CONFIRMED": ["confirms that", "confirmed", "definitely has"],
    "EFFICACY_PROVEN": ["proves efficacy", "proves that the treatment", "achieved clinical efficacy", "endpoint was successfully met"],
    "MANAGEMENT_REQUIRED": ["must receive a lower dose", "dose must be changed", "must change the dose", "clinically contraindicated together", "absolutely contraindicated"],
    "MANAGEMENT_UNRESOLVED": ["management unresolved", "management must be supported separately", "no therapeutic-management recommendation", "no product-specific management rule", "does not provide a clinical contraindication", "does not state an absolute contraindication"],
    "SIGNAL_ONLY": ["signal detection", "safety signal", "spontaneous report", "spontaneous adverse-event"],
    "ASSOCIATED": ["association", "associated with"],
}
LIMITATIONS = {
    "NO_ABSOLUTE_CONTRAINDICATION": ["does not state an absolute contraindication", "no clinical contraindication", "does not provide a clinical contraindication"],
    "NO_REPLACEMENT_REGIMEN": ["does not specify a replacement", "no replacement analgesic regimen"],
    "NO_EFFICACY_RESULT": ["no efficacy result", "no trial result", "does not contain peer-reviewed trial results"],
    "NO_MANAGEMENT_RULE": ["no therapeutic-management recommendation", "no product-specific management rule", "management must be supported separately"],
    "NOT_DIAGNOSIS": ["does not by itself diagnose", "does not classify", "indeterminate", "further characterization"],
    "NO_HEAD_TO_HEAD": ["without a randomized head-to-head", "no randomized head-to-head", "different populations"],
    "GUIDELINE_NOT_UPDATED": ["has not yet been revised", "has not been revised", "has not yet been updated", "not yet changed", "continues to recommend", "still recommends"],
}
#: Causal status by its cues, the first that holds.
CAUSAL = [
    ("NOT_ESTABLISHED", ["does not establish that", "does not establish causality", "cannot establish causality", "cannot by themselves establish", "not establish that", "causality requires other evidence", "does not prove causality", "not proven causality", "do not by themselves establish"]),
    ("ASSOCIATION", ["association", "associated with", "observational analysis", "observational study"]),
    ("SIGNAL_ONLY", ["safety signal", "signal detection", "spontaneous adverse-event", "spontaneous report"]),
    ("CAUSAL", ["proves that", "caused by", "caused the", "establishes that"]),
]
#: Relations as (subject, predicate, object, cue lists each of which needs one).
RELATIONS = [
    ("later_version", "CURRENT_STATUS", "current", [["later guideline version", "newer guideline version"], ["current recommendation source"]]),
    ("older_version", "CURRENT_STATUS", "current", [["older version", "old version"], ["current recommendation"]]),
    ("trial_registry", "EVIDENCE_TYPE", "registry", [["registry", "clinicaltrials.gov"]]),
    ("study", "STATUS", "completed", [["status completed", "as completed"]]),
    ("study", "STATUS", "recruiting", [["recruiting"]]),
    ("study", "HAS_REGISTERED_PRIMARY_ENDPOINT", "primary_endpoint", [["primary endpoint"]]),
    ("drug_m", "INHIBITS", "cyp3a", [["cyp3a inhibitor", "inhibits cyp3a"]]),
    ("drug_n", "SUBSTRATE_OF", "cyp3a", [["cyp3a substrate"]]),
    ("drug_pair", "POTENTIAL_PK_INTERACTION", "cyp3a", [["pharmacokinetic interaction", "interaction mechanism"]]),
    ("genotype", "ASSOCIATED_WITH", "drug_exposure", [["higher drug exposure", "changes drug exposure", "pharmacokinetic association", "changes exposure"]]),
    ("lesion", "CLASSIFICATION", "indeterminate", [["indeterminate"]]),
    ("lesion", "CLASSIFICATION", "malignant", [["malignant"]]),
    ("report", "RECOMMENDS", "mri_characterization", [["mri"], ["recommend"]]),
    ("cross_trial", "HAS_SEPARATE_RESPONSE_RATES", "different_populations", [["response rate"], ["62%", "48%"]]),
    ("treatment_a", "SUPERIOR_TO", "treatment_b", [["superior"]]),
]
#: The action that a window of text is about, the first that holds; each cue list needs one.
ACTIONS = [
    ("CONTRAINDICATED", [["contraindicat"]]), ("DISCONTINUE", [["discontinu", "must stop", "must discontinue", "stop the drug"]]), ("REASSESS", [["reassess", "benefit and risk", "benefit/risk"]]),
    ("INITIATION_NOT_RECOMMENDED", [["not recommended"], ["initiat", "starting", "start"]]), ("NOT_RECOMMENDED", [["not recommended"]]),
]
#: Numeric mentions as (operator, pattern, characters of the window before and after).
MENTIONS = [
    ("RANGE", r"egfr[^.;,]{0,24}?(\d+)\s*(?:to|[-–])\s*(\d+)", 65, 75),
    ("LT", r"egfr[^.;,]{0,24}?(?:below|under|<)\s*(\d+)", 70, 80),
    ("LT", r"(?:below|under|<)\s*(\d+)[^.;,]{0,16}?egfr", 70, 80),
    ("EQ", r"egfr\s*(?:of|=|is|at)?\s*(\d+)", 60, 70),
]
#: Shares of the claim's frame words that the evidence's frame has; modalities that support if shared.
FRAME_LITERAL, FRAME_PARTLY = 0.88, 0.45
STRONG = ["CONTRAINDICATED", "DISCONTINUE", "INITIATION_NOT_RECOMMENDED", "POSSIBLE", "REASSESS", "RISK_INCREASE", "SIGNAL_ONLY"]
CLAIMED = ["CONTRAINDICATED", "DISCONTINUE", "REASSESS", "INITIATION_NOT_RECOMMENDED", "NOT_RECOMMENDED"]

#: Cues of a claim that a guideline has changed, and that it hasn't yet.
CHANGED = ["guideline now recommends", "automatically changes the current guideline", "automatically means that the current guideline"]
STILL = ["current guideline still", "current guideline recommendation has not yet changed", "guideline has not yet changed"]

_OTHERS = ["initiat", "starting", "start", "supersedes", "superseded", "later", "newer", "older", "old", "version 2", "version 1", "current guideline", "current label", "current recommendation",
           *CHANGED, *STILL]
FRAMES = Cues([*(p for ps in [*MODALITIES.values(), *LIMITATIONS.values(), *(ps for _, ps in CAUSAL), *(n for *_, needs in RELATIONS for n in needs), *(n for _, needs in ACTIONS for n in needs)] for p in ps), *_OTHERS])
#: The lists of cues that frames and their ladder ask for, by their bit in what FRAMES.bits() finds.
_ASKED = [tuple(ps) for ps in [*MODALITIES.values(), *LIMITATIONS.values(), *(ps for _, ps in CAUSAL), *(n for *_, needs in RELATIONS for n in needs), CHANGED, STILL, *(_OTHERS[a:b] for a, b in ((0, 3), (3, 5), (5, 7), (7, 9), (9, 10), (10, 11), (11, 14)))]]
_BIT = {ps: k for k, ps in enumerate(dict.fromkeys(_ASKED))}
_COMPILED = [(op, re.compile(p), a, b) for op, p, a, b in MENTIONS]
_NUMERIC = "array<struct<operator: string, value: int, low: int, high: int, window: string>>"
_NUMERIC_ARROW = pa.list_(pa.struct([("operator", pa.string()), ("value", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("window", pa.string())]))


def _mentions(t: str) -> list[dict]:
    """Numeric mentions with the text around them; a single value that is named as a bound isn't one."""
    out: list[dict] = []
    for op, pattern, before, after in _COMPILED:
        for m in pattern.finditer(t):
            n = [int(x) for x in m.groups()]
            if op == "EQ" and any(n[0] in (x["value"], x["low"], x["high"]) for x in out):
                continue
            value, low, high = (None, min(n), max(n)) if op == "RANGE" else (n[0], None, None)
            out.append({"operator": op, "value": value, "low": low, "high": high, "window": t[max(0, m.start() - before) : m.end() + after]})
    return out


def _numeric(text: Column) -> Column:
    @F.arrow_udf(_NUMERIC)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_mentions(t) if t and "egfr" in t else [] for t in texts.to_pylist()], _NUMERIC_ARROW)

    return run(text)


def _action(window: Column) -> Column:
    says = lambda ps: _any([F.contains(window, F.lit(p)) for p in ps])
    return F.coalesce(*[F.when(_all([says(n) for n in needs]), F.lit(name)) for name, needs in ACTIONS])


def _has(found: Column, *phrases: str) -> Column:
    return found.bitwiseAND(F.lit(1 << _BIT[phrases])) != 0


def frame(text: Column, found: Column) -> Column:
    """struct of a text in normal form: modalities, limitations, relations, conditions (with the action meant), causal, temporal.

    found: FRAMES.bits() of the text.  Patterns are looked for only in texts that hold their fixed words.
    """
    has = lambda *ps: _has(found, *ps)
    holds = lambda word: F.contains(text, F.lit(word))
    relation = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    initiating = has(*MODALITIES["NOT_RECOMMENDED"]) & has("initiat", "starting", "start")
    modalities = F.array_compact(F.array(*[F.when(has(*ps), n) for n, ps in MODALITIES.items()], F.when(initiating, "INITIATION_NOT_RECOMMENDED")))
    causal = F.coalesce(*[F.when(has(*ps), F.lit(n)) for n, ps in CAUSAL], F.lit("NOT_APPLICABLE"))
    limits = F.array_compact(F.array(*[F.when(has(*ps), n) for n, ps in LIMITATIONS.items()], F.when(causal == "NOT_ESTABLISHED", "CAUSALITY_NOT_ESTABLISHED")))

    def pairs(pattern: str, predicate: str) -> Column:
        return F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda a, b: relation(entity(a), predicate, entity(b)))

    none = F.array().cast("array<struct<subject: string, predicate: string, object: string>>")
    named = F.when(holds("supersedes"), F.concat(*[pairs(rf"({k}\s+[a-z0-9._-]+)\s+(?:explicitly\s+)?supersedes\s+({k}\s+[a-z0-9._-]+)", "SUPERSEDES") for k in ("guideline", "version")])).otherwise(none)
    general = F.when(has("supersedes", "superseded"), F.when(has("later", "newer") & has("older", "old"), relation(F.lit("later_version"), "SUPERSEDES", F.lit("older_version"))).when(has("version 2") & has("version 1"), relation(F.lit("version 2"), "SUPERSEDES", F.lit("version 1"))))
    newer = F.when(F.size(named) > 0, named).otherwise(F.array_compact(F.array(general)))
    current = F.when(holds("current"), F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(rf"({k}\s+[a-z0-9._-]+)[^.;]{{0,40}}?(?:is|remains|treated as|be treated as)\s+(?:the\s+)?current"), F.lit(1)), lambda s: relation(entity(s), "CURRENT_STATUS", F.lit("current"))) for k in ("guideline", "version")])).otherwise(none)
    apart = [F.when(holds(word) & text.rlike(p), relation(F.regexp_extract(text, p, 1), n, F.regexp_extract(text, p, 2))) for n, word, p in (("ASSOCIATED_WITH", "association between", r"association between\s+([a-z0-9]+)\s+and\s+([a-z0-9]+)"), ("CAUSES", "caused", r"([a-z0-9]+)\s+caused\s+([a-z0-9]+)"))]
    stated = F.array_compact(F.array(*apart, *[F.when(_all([has(*n) for n in needs]), relation(F.lit(s), p, F.lit(o))) for s, p, o, needs in RELATIONS]))
    conditions = F.transform(_numeric(text), lambda c: F.struct(c["operator"].alias("operator"), c["value"].alias("value"), c["low"].alias("low"), c["high"].alias("high"), _action(c["window"]).alias("applies_to")))
    temporal = F.when(F.size(newer) > 0, "CURRENT").when(has(*LIMITATIONS["GUIDELINE_NOT_UPDATED"]), "PENDING_UPDATE").when(has("current guideline", "current label", "current recommendation"), "CURRENT").otherwise("NOT_APPLICABLE")
    return F.struct(modalities.alias("modalities"), limits.alias("limitations"), F.concat(newer, current, stated).alias("relations"), conditions.alias("conditions"), causal.alias("causal"), temporal.alias("temporal"), (F.size(newer) > 0).alias("directional"))


def _frame_words(f: Column) -> Column:
    """The words of a frame written out with its field names."""
    static = "entities relations conditions modalities causal status temporal limitations raw cues"
    relations = F.transform(f["relations"], lambda r: F.concat_ws(" ", r["subject"], r["predicate"], r["object"], F.lit("subject predicate object polarity positive confidence")))
    conditions = F.transform(f["conditions"], lambda c: F.concat_ws(" ", F.lit("variable egfr operator value low high applies null"), c["operator"], c["value"].cast("string"), c["low"].cast("string"), c["high"].cast("string"), c["applies_to"]))
    flat = F.concat_ws(" ", F.lit(static), f["causal"], f["temporal"], F.when(f["directional"], "directional_supersession"), F.array_join(f["modalities"], " "), F.array_join(f["limitations"], " "), F.array_join(relations, " "), F.array_join(conditions, " "))
    return _words(F.lower(flat))


def framed(cases: DataFrame, evidence: str = "evidence", claim: str = "claim") -> DataFrame:
    """cases with relation and cue."""
    own = _both(cases, evidence, claim, lambda t: FRAMES.bits(t, list(_BIT))).withColumns({"__ev": frame(F.col("__e"), F.col("__ef")), "__cl": frame(F.col("__c"), F.col("__cf"))})
    ev, cl, cf = F.col("__ev"), F.col("__cl"), F.col("__cf")
    limited = lambda n: F.array_contains(ev["limitations"], n)
    claims = lambda *ns: _any([F.array_contains(cl["modalities"], n) for n in ns])
    shows = lambda *ns: _any([F.array_contains(ev["modalities"], n) for n in ns])

    def rel(f: Column, predicate: str, obj: str | None = None, subject: str | None = None) -> Column:
        fits = lambda r: (r["predicate"] == predicate) & (F.lit(True) if obj is None else r["object"] == obj) & (F.lit(True) if subject is None else r["subject"] == subject)
        return F.exists(f["relations"], fits)

    # the first supersession and current claim that meet, in their order
    olds = F.filter(ev["relations"], lambda r: r["predicate"] == "SUPERSEDES")
    news = F.filter(cl["relations"], lambda r: (r["predicate"] == "CURRENT_STATUS") & (r["object"] == "current"))
    meets = lambda s, c: F.when(c["subject"] == s["object"], _out("CONTRADICTS", "superseded_document_asserted_current")).when(c["subject"] == s["subject"], _out("DIRECT_SUPPORT", "newer_document_asserted_current"))
    direction = F.get(F.array_compact(F.flatten(F.transform(olds, lambda s: F.transform(news, lambda c: meets(s, c))))), F.lit(0))

    def acting(v: Column) -> Column:
        holds = lambda c: F.coalesce(F.when(c["operator"] == "LT", v < c["value"]).when(c["operator"] == "RANGE", (v >= c["low"]) & (v <= c["high"])).otherwise(v == c["value"]), F.lit(False))
        return F.array_distinct(F.transform(F.filter(ev["conditions"], lambda c: c["applies_to"].isNotNull() & holds(c)), lambda c: c["applies_to"]))

    value = F.get(F.transform(F.filter(cl["conditions"], lambda c: c["operator"] == "EQ"), lambda c: c["value"]), F.lit(0))
    asked, here = F.array_intersect(cl["modalities"], F.array(*[F.lit(x) for x in CLAIMED])), acting(value)
    at_value = F.when(value.isNotNull() & (F.size(asked) > 0), F.when(F.arrays_overlap(asked, here), _out("DIRECT_SUPPORT", "numeric_rule_applies")).when(F.size(here) > 0, _out("CONTRADICTS", "action_conflict_at_value")))

    def broad(c: Column) -> Column:
        v = c["value"]
        acts = F.transform(F.array(v - 1, v - 5, F.greatest(F.lit(0), v - 14)), acting)
        bad = F.exists(acts, lambda a: (F.size(a) > 0) & ~F.array_contains(a, c["applies_to"]))
        good = F.exists(acts, lambda a: F.array_contains(a, c["applies_to"]))
        return F.when((c["operator"] == "LT") & c["applies_to"].isNotNull(), F.when(bad, _out("CONTRADICTS", "overbroad_threshold_action")).when(good, _out("DIRECT_SUPPORT", "threshold_action_supported")))

    over = F.get(F.array_compact(F.transform(cl["conditions"], broad)), F.lit(0))
    facts = [("STATUS", "completed"), ("STATUS", "recruiting"), ("HAS_REGISTERED_PRIMARY_ENDPOINT", "primary_endpoint")]
    any_fact = _any([rel(cl, p, o) for p, o in facts])
    all_facts = _all([~rel(cl, p, o) | rel(ev, p, o) for p, o in facts])
    registry = rel(ev, "EVIDENCE_TYPE", "registry")
    mechanism = rel(ev, "INHIBITS", "cyp3a") & rel(ev, "SUBSTRATE_OF", "cyp3a")
    genotype = rel(ev, "ASSOCIATED_WITH", "drug_exposure", "genotype")
    vague = rel(ev, "CLASSIFICATION", "indeterminate", "lesion")
    changes = _has(cf, *CHANGED)
    temporal = F.when(_has(cf, *STILL), "PENDING_UPDATE").otherwise(cl["temporal"])
    shared = F.array_intersect(F.array(*[F.lit(x) for x in STRONG]), F.array_intersect(ev["modalities"], cl["modalities"]))
    # what a claim says of a guideline counts among its words
    claim_words = F.when(changes, F.array_union(_frame_words(cl.withField("temporal", temporal)), _words(F.lit("guideline changed assertion")))).otherwise(_frame_words(cl.withField("temporal", temporal)))
    share = _share(claim_words, _frame_words(ev))
    escalates = (ev["causal"].isin("NOT_ESTABLISHED", "ASSOCIATION", "SIGNAL_ONLY")) & (cl["causal"] == "CAUSAL")
    no = lambda cue: _out("DOES_NOT_SUPPORT", cue)
    yes = lambda cue: _out("DIRECT_SUPPORT", cue)
    # a function of the share, so that it is taken once, and only where no other rung holds
    by_share = lambda x: F.when((x >= FRAME_LITERAL) & (F.size(ev["limitations"]) == 0), yes("very_high_frame_overlap")).when(x >= FRAME_PARTLY, _out("PARTIAL_SUPPORT", "partial_frame_overlap"))
    rungs = [
        direction,
        F.when(escalates & (ev["causal"] == "NOT_ESTABLISHED"), _out("CONTRADICTS", "causal_polarity_conflict")), F.when(escalates, no("causal_escalation_without_support")),
        at_value, over,
        F.when(limited("NO_ABSOLUTE_CONTRAINDICATION") & claims("CONTRAINDICATED", "MANAGEMENT_REQUIRED"), no("risk_not_absolute_contraindication")),
        F.when(limited("NO_REPLACEMENT_REGIMEN") & claims("MANAGEMENT_REQUIRED"), no("replacement_regimen_not_in_evidence")),
        F.when(limited("NO_EFFICACY_RESULT") & claims("EFFICACY_PROVEN"), no("registry_without_efficacy_result")),
        F.when(limited("NO_MANAGEMENT_RULE") & claims("MANAGEMENT_REQUIRED"), no("mechanism_or_pk_without_management_rule")),
        F.when(limited("NOT_DIAGNOSIS") & claims("DIAGNOSIS_CONFIRMED"), no("observation_not_confirmed_diagnosis")),
        F.when(limited("NO_HEAD_TO_HEAD") & rel(cl, "SUPERIOR_TO"), no("cross_trial_percentage_not_superiority")),
        F.when(limited("GUIDELINE_NOT_UPDATED") & changes, _out("CONTRADICTS", "new_evidence_does_not_auto_update_guideline")),
        F.when(shows("POSSIBLE") & claims("DIAGNOSIS_CONFIRMED"), no("possible_risk_not_patient_diagnosis")),
        F.when(shows("RISK_INCREASE") & claims("RISK_INCREASE"), yes("risk_relation_preserved")),
        F.when(registry & claims("EFFICACY_PROVEN"), no("registry_not_efficacy_proof")), F.when(registry & any_fact & all_facts, yes("registry_fact_preserved")),
        F.when(mechanism & rel(cl, "POTENTIAL_PK_INTERACTION", "cyp3a"), yes("bounded_cyp3a_pk_inference")), F.when(mechanism & claims("MANAGEMENT_REQUIRED"), no("mechanism_not_management")),
        F.when(genotype & rel(cl, "ASSOCIATED_WITH", "drug_exposure", "genotype") & ~claims("MANAGEMENT_REQUIRED"), yes("pgx_pk_association_preserved")), F.when(genotype & claims("MANAGEMENT_REQUIRED"), no("pgx_exposure_not_dose_rule")),
        F.when(vague & rel(cl, "CLASSIFICATION", "malignant", "lesion"), no("indeterminate_not_malignant")),
        F.when(vague & rel(cl, "CLASSIFICATION", "indeterminate", "lesion"), F.when(rel(cl, "RECOMMENDS", "mri_characterization"), yes("report_uncertainty_and_followup_preserved")).otherwise(yes("report_uncertainty_preserved"))),
        F.when((ev["temporal"] == "PENDING_UPDATE") & (temporal == "PENDING_UPDATE"), yes("pending_update_state_preserved")),
        F.when(F.size(shared) > 0, _out("DIRECT_SUPPORT", F.concat(F.lit("shared_bounded_modality:"), F.array_join(shared, ",")))),
        F.get(F.transform(F.array(share), by_share), F.lit(0)),
    ]
    return own.withColumn("__v", F.coalesce(*rungs, no("insufficient_frame_support"))).select(*[F.col(x) for x in cases.columns], "__v.*")
