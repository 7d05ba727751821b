"""Atomic propositions of texts by cue rules, and their comparison by an ordered ladder.

A text is cut into clauses where a new statement begins.  One automaton finds all cues of a clause; rules over the cues,
and a few patterns for names and numbers, give its propositions.  Rules of one group exclude each other, the first that
holds counts.  A population that a clause does not name is the text's.  Of propositions that are equal but for their
clause the first stays.

A null or empty text has no propositions; texts with equal ids are one text, clause by clause; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.automaton import Cues

#: Where clauses part, in this order; what is kept of the match is its last group.
CLAUSE_MARKS = [
    (r"\s*;\s*", ""),
    (r"\.(\s|$)", "$1"),
    (r",\s*(?:whereas|while|but)\s+", ""),
    (r"\s+(?:whereas|while|but)\s+", ""),
    (r",?\s+and\s+(the|this|that|no|causal|discontinuation|initiation|use|guideline|drug|a spontaneous|an observational|the authors|the passage|the source|the registry)", "$1"),
]
#: Cues of populations.
POPULATIONS = {
    "existing_user": ["already receiving", "already taking", "already on therapy", "existing user", "existing therapy", "patients already on", "person is already"],
    "new_or_initiating_user": ["new patient", "new treatment", "initiation", "starting", "start the drug", "starting the drug"],
}
#: Rules as (group, cue lists of which each needs one, cues none of which may be there, subject, predicate, object,
#: polarity, confidence).  Groups of actions carry the clause's conditions.
ACTIONS = ["CONTRAINDICATED", "INITIATION_NOT_RECOMMENDED", "REASSESS_BENEFIT_RISK", "DISCONTINUE"]
RULES = [
    ("prohibition_rule", [["contraindicat"], ["does not provide", "does not state", "no contraindication", "no clinical contraindication", "contains no", "not an absolute contraindication"]], [], "evidence", "PROVIDES_ABSOLUTE_PROHIBITION", "drug_or_combination", "NEGATIVE", 1.0),
    ("prohibition_rule", [["contraindicat"]], [], "drug_use", "CONTRAINDICATED", "use", "POSITIVE", 1.0),
    ("initiation", [["not recommended"], ["initiat", "starting", "new treatment", "new patient", "start"]], [], "drug_initiation", "INITIATION_NOT_RECOMMENDED", "initiation", "POSITIVE", 1.0),
    ("reassessment", [["reassess", "benefit-risk reassessment", "benefit versus risk", "benefit and risk should be reassessed", "benefit/risk"]], [], "drug_use", "REASSESS_BENEFIT_RISK", "benefit_risk", "POSITIVE", 1.0),
    ("stop", [["discontinu", "must stop", "must discontinue", "stop the medicine", "stop the drug"]], [], "drug_use", "DISCONTINUE", "drug", "POSITIVE", 1.0),
    ("risk", [["increase bleeding risk", "increased bleeding risk", "raise bleeding risk", "higher bleeding risk", "increase that risk", "increases risk"]], [], "drug_exposure", "INCREASES_RISK", "adverse_event", "POSITIVE", 1.0),
    ("prohibition", [["does not provide an absolute", "does not state an absolute", "no absolute prohibition", "not an absolute prohibition", "no absolute contraindication"]], [], "evidence", "PROVIDES_ABSOLUTE_PROHIBITION", "drug_or_combination", "NEGATIVE", 1.0),
    ("prohibition", [["absolutely forbidden", "absolute prohibition", "absolutely contraindicated", "forbidden in all", "in all circumstances"]], [], "evidence", "PROVIDES_ABSOLUTE_PROHIBITION", "drug_or_combination", "POSITIVE", 1.0),
    ("diagnosis", [["does not confirm", "does not state that a single symptom confirms", "does not by itself diagnose", "no malignant diagnosis", "does not classify the lesion as malignant"]], [], "evidence", "CONFIRMS_DIAGNOSIS", "diagnosis", "NEGATIVE", 1.0),
    ("diagnosis", [["confirms the diagnosis", "confirms that", "proves that the treated patient has", "proves that the patient has", "confirmed diagnosis", "proves that the lesion is malignant"]], [], "evidence", "CONFIRMS_DIAGNOSIS", "diagnosis", "POSITIVE", 1.0),
    ("causality", [["does not establish that", "does not establish causality", "do not on their own demonstrate", "causal attribution is not established", "causality is not established", "does not prove that", "cannot establish", "not establish that"]], [], "evidence", "ESTABLISHES_CAUSALITY", "causal_relation", "NEGATIVE", 1.0),
    ("causality", [["proves that", "establishes that", "establishes a causal", "caused the event", "causal effect"]], ["does not", "not established", "cannot"], "evidence", "ESTABLISHES_CAUSALITY", "causal_relation", "POSITIVE", 1.0),
    ("association", [["association between", "associated with", "found an association", "reports an association"]], [], "factor_a", "ASSOCIATED_WITH", "outcome_b", "POSITIVE", 0.9),
    ("incidence", [["not a valid estimate of", "cannot be used to estimate", "cannot establish the true incidence", "cannot estimate", "not a valid estimate", "report counts cannot"]], [], "report_count", "ESTIMATES_TRUE_INCIDENCE", "event_incidence", "NEGATIVE", 1.0),
    ("incidence", [["true incidence", "calculate the true incidence", "obtain the true incidence"]], [], "report_count", "ESTIMATES_TRUE_INCIDENCE", "event_incidence", "POSITIVE", 1.0),
    ("recruiting", [["recruiting"]], [], "study", "HAS_STATUS", "recruiting", "POSITIVE", 1.0),
    ("completed", [["completed"]], [], "study", "HAS_STATUS", "completed", "POSITIVE", 1.0),
    ("endpoint", [["primary endpoint"]], [], "study", "HAS_PRIMARY_ENDPOINT", "primary_endpoint", "POSITIVE", 1.0),
    ("efficacy", [["no efficacy outcome", "no efficacy result", "no result demonstrating clinical benefit", "contains no result demonstrating clinical benefit", "no clinical benefit result"]], [], "registry_evidence", "DEMONSTRATES_EFFICACY", "clinical_benefit", "NEGATIVE", 1.0),
    ("efficacy", [["proves that the investigational treatment works", "proves that the treatment works", "achieved clinical efficacy", "proves efficacy", "demonstrates clinical benefit"]], ["no result", "contains no"], "registry_evidence", "DEMONSTRATES_EFFICACY", "clinical_benefit", "POSITIVE", 1.0),
    ("pending", [["has not been updated", "has not yet been updated", "has not been revised", "has not yet been revised"]], [], "current_guideline", "IS_CURRENT", "existing_recommendation", "POSITIVE", 1.0),
    ("changed", [["automatically changes the current guideline", "automatically changes the guideline", "guideline recommendation to"]], [], "current_guideline", "IS_CURRENT", "new_option", "POSITIVE", 1.0),
    ("inhibitor", [["inhibits cyp3a", "cyp3a inhibitor"]], [], "drug_p", "POTENTIAL_PK_INTERACTION", "cyp3a_pathway", "POSITIVE", 0.8),
    ("substrate", [["cyp3a substrate"]], [], "drug_q", "POTENTIAL_PK_INTERACTION", "cyp3a_pathway", "POSITIVE", 0.8),
    ("interaction", [["pharmacokinetic interaction"]], [], "drug_pair", "POTENTIAL_PK_INTERACTION", "cyp3a_pathway", "POSITIVE", 1.0),
    ("management", [["no management instruction", "no dose adjustment", "no therapeutic dose recommendation", "no therapeutic-management recommendation", "contains no dose adjustment", "no product-specific management rule"]], [], "mechanism_or_pk_evidence", "PROVIDES_MANAGEMENT_RULE", "drug_pair_or_patient", "NEGATIVE", 1.0),
    ("management", [["requires a dose reduction", "must receive a lower dose", "clinically contraindicated", "dose reduction is required", "requires dose adjustment"]], [], "mechanism_or_pk_evidence", "PROVIDES_MANAGEMENT_RULE", "drug_pair_or_patient", "POSITIVE", 1.0),
    ("genotype", [["genotype is associated with", "genotype changes", "greater drug exposure", "higher drug exposure", "pharmacokinetic association"]], [], "genotype", "ASSOCIATED_WITH", "drug_exposure", "POSITIVE", 1.0),
    ("indeterminate", [["indeterminate"]], [], "lesion", "CLASSIFIED_AS", "indeterminate", "POSITIVE", 1.0),
    ("malignant", [["malignant"]], ["no malignant", "does not classify"], "lesion", "CLASSIFIED_AS", "malignant", "POSITIVE", 1.0),
    ("follow_up", [["recommend"], ["mri"]], [], "report", "RECOMMENDS_FOLLOWUP", "mri_characterization", "POSITIVE", 1.0),
    ("superiority", [["not a randomized direct comparison", "non-head-to-head", "without a randomized head-to-head", "different populations"]], [], "cross_trial_percentages", "PROVES_SUPERIORITY", "treatment_a_over_b", "NEGATIVE", 1.0),
    ("superiority", [["proves treatment a is superior", "proves that treatment a is superior", "proves superiority"]], [], "cross_trial_percentages", "PROVES_SUPERIORITY", "treatment_a_over_b", "POSITIVE", 1.0),
]
#: Patterns of names and numbers in a clause.
NAMED = r"guideline\s+[a-z0-9._-]+|version\s+[a-z0-9._-]+"
SUPERSEDES = [rf"({kind}\s+[a-z0-9._-]+)\s+(?:explicitly\s+)?supersedes\s+({kind}\s+[a-z0-9._-]+)" for kind in ("guideline", "version")]
REMAINS = rf"({NAMED})[^.;]{{0,45}}?(?:remains|is|be treated as)\s+(?:the\s+)?current"
CONTINUES = r"(?:continues to recommend|still recommends)\s+(?:option|treatment|standard)?\s*([a-z0-9._-]+)"
RANGE = r"egfr[^.;,]{0,22}?(\d+)\s*(?:to|through|[-–])\s*(\d+)"
BELOW = [r"egfr[^.;,]{0,20}?(?:below|under|<)\s*(\d+)", r"(?:below|under|<)\s*egfr\s*(\d+)"]
EXACT = r"egfr\s*(?:of|=|is|at)?\s*(\d+)"

#: Rules with a pattern: what is told by numbers of rules, which cues the pattern can't do without.
_PATTERNED = [
    *((f"supersedes {kind} {part}", [["supersedes"], [kind]]) for kind in ("guideline", "version") for part in ("newer", "newer is current", "older isn't")),
    ("remains", [["current"], ["guideline", "version"]]), ("continues", [["continues to recommend", "still recommends"]]),
]
#: Rules in the order of their propositions, those with a pattern after the plain ones; then the populations, in one group.
_ALL = [*((group, needs, unless) for group, needs, unless, *_ in RULES), *((name, needs, []) for name, needs in _PATTERNED), *(("population", [ps], []) for ps in POPULATIONS.values())]
_REMAINS, _CONTINUES, _PEOPLE = len(RULES) + 6, len(RULES) + 7, len(RULES) + len(_PATTERNED)
CUES = Cues([p for _, needs, unless in _ALL for p in [*(c for n in needs for c in n), *unless]])
CONDITION = "struct<operator: string, value: int, low: int, high: int>"
PROPOSITION = f"struct<subject: string, predicate: string, object: string, polarity: string, conditions: array<{CONDITION}>, population: string, confidence: double>"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def clauses(text: Column) -> Column:
    """array<string>: the clauses of a text that is in normal form."""
    t, mark = text, "\u001f"
    for pattern, kept in CLAUSE_MARKS:
        t = F.regexp_replace(t, pattern, f" {mark} {kept}")
    return F.filter(F.transform(F.split(t, mark), lambda c: F.btrim(c, F.lit(" ,"))), lambda c: c != "")


def entity(name: Column) -> Column:
    """A named source without articles and words of age."""
    bare = F.regexp_replace(name, r"\b(the|a|an|current|later|older|newer|old|new)\b", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9_. -]+", " "), r"\s+", " ")
    return F.btrim(bare, F.lit(" .-"))


def _condition(operator: str, value: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(F.lit(operator).alias("operator"), *[(none if v is None else v).alias(n) for n, v in (("value", value), ("low", low), ("high", high))])


def _numbers(t: Column, pattern: str, group: int = 1) -> Column:
    return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda x: x.cast("int"))


def conditions(t: Column) -> Column:
    """array<condition> of a clause: ranges, bounds from above, and single values that neither of these names."""
    ranges = F.zip_with(_numbers(t, RANGE), _numbers(t, RANGE, 2), lambda a, b: _condition("RANGE", low=F.least(a, b), high=F.greatest(a, b)))
    below = F.array_distinct(F.concat(*[_numbers(t, p) for p in BELOW]))
    named = F.concat(below, F.flatten(F.transform(ranges, lambda r: F.array(r["low"], r["high"]))))
    exact = F.filter(F.array_distinct(_numbers(t, EXACT)), lambda v: ~F.array_contains(named, v))
    return F.concat(ranges, F.transform(below, lambda v: _condition("LT", v)), F.transform(exact, lambda v: _condition("EQ", v)))


def population(met: Column) -> Column:
    """The population that a text names, by the rules that it meets."""
    return reduce(lambda w, kn: w.when(F.array_contains(met, _PEOPLE + kn[0]), F.lit(kn[1])), enumerate(POPULATIONS), F.when(F.lit(False), F.lit(None).cast("string")))


def _order() -> Column:
    """For each rule its place: groups in the order of their first rule, then the rules with a pattern."""
    groups = list(dict.fromkeys(group for group, *_ in RULES))
    return F.array(*[F.lit(groups.index(group)) for group, *_ in RULES], *[F.lit(len(groups) + k) for k in range(len(_PATTERNED))])


def _said(clause: Column, rule: Column, who: Column) -> dict[str, Column]:
    """The fields of the proposition that a clause makes by the rule of a number; no subject where the rule's pattern isn't there."""
    fixed = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("subject", "predicate", "object", "polarity", "confidence"), r[3:])]) for r in RULES])
    plain = F.get(fixed, rule)
    subject, predicate, obj, polarity = (F.when(rule < len(RULES), plain[n]) for n in ("subject", "predicate", "object", "polarity"))
    current = F.lit("recommendation_source")
    for k, pattern in enumerate(SUPERSEDES):
        at = len(RULES) + 3 * k
        newer, older = (F.when(clause.rlike(pattern), entity(F.regexp_extract(clause, pattern, n))) for n in (1, 2))
        subject = subject.when(rule.between(at, at + 1), newer).when(rule == at + 2, older)
        predicate = predicate.when(rule == at, "SUPERSEDES").when(rule.between(at + 1, at + 2), "IS_CURRENT")
        obj = obj.when(rule == at, older).when(rule.between(at + 1, at + 2), current)
        polarity = polarity.when(rule.between(at, at + 1), "POSITIVE").when(rule == at + 2, "NEGATIVE")
    subject = subject.when(rule == _REMAINS, F.when(clause.rlike(REMAINS), entity(F.regexp_extract(clause, REMAINS, 1)))).when(rule == _CONTINUES, "current_guideline")
    option = F.when(clause.rlike(CONTINUES), F.regexp_extract(clause, CONTINUES, 1)).otherwise("existing_option")
    acts = [k for k, r in enumerate(RULES) if r[4] in ACTIONS]
    starts = [k for k, r in enumerate(RULES) if r[4] == "INITIATION_NOT_RECOMMENDED"]
    return {
        "subject": subject, "predicate": predicate.when(rule >= _REMAINS, "IS_CURRENT"), "object": obj.when(rule == _REMAINS, current).when(rule == _CONTINUES, option), "polarity": polarity.when(rule >= _REMAINS, "POSITIVE"),
        "conditions": F.when(rule.isin(acts), conditions(clause)).otherwise(F.array().cast(f"array<{CONDITION}>")),
        "population": F.when(rule.isin(starts), F.coalesce(who, F.lit("new_or_initiating_user"))).otherwise(who), "confidence": F.when(rule < len(RULES), plain["confidence"]).otherwise(1.0),
    }


def parsed(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, clause, source_clause, the proposition's fields): a row for each different proposition of a text."""
    whole = texts.select(key, normal(F.col(text)).alias("__t")).withColumn("__all", CUES.holding(F.col("__t"), _ALL))
    each = whole.select(key, population(F.col("__all")).alias("__who"), F.posexplode(clauses(F.col("__t"))).alias("clause", "source_clause"))
    # rows are spread before the cues are looked up, so a long text is no task's alone; only clauses that meet a rule go on
    each = each.withColumn("__met", CUES.holding(F.col("source_clause"), _ALL))
    each = each.select(key, "clause", "source_clause", F.coalesce(population(F.col("__met")), F.col("__who")).alias("__who"), F.explode("__met").alias("__rule")).where(F.col("__rule") < _PEOPLE)
    said = _said(F.col("source_clause"), F.col("__rule"), F.col("__who"))
    rows = each.select(key, "clause", F.get(_order(), F.col("__rule")).alias("rule"), "source_clause", *[c.alias(n) for n, c in said.items()]).where("subject is not null")
    same = ["subject", "predicate", "object", "polarity", "conditions", "population"]
    first = F.min(F.struct("clause", "rule", "confidence", "source_clause")).alias("f")
    return rows.groupBy(key, *same).agg(first).select(key, *same, "f.*")


def gathered(propositions: DataFrame, key: str) -> DataFrame:
    """(key, props): a text's propositions in the order of its clauses and rules."""
    fields = ["subject", "predicate", "object", "polarity", "conditions", "population"]
    return propositions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("clause", "rule", *fields))).alias("props"))


#: What the ladder asks of predicates.
DIRECTED = ["SUPERSEDES", "IS_CURRENT", "CLASSIFIED_AS", "HAS_STATUS", "HAS_PRIMARY_ENDPOINT", "RECOMMENDS_FOLLOWUP", "PROVES_SUPERIORITY"]
DENIED_CONTRADICTS = ["ESTABLISHES_CAUSALITY", "ESTIMATES_TRUE_INCIDENCE", "IS_CURRENT"]
DENIED_UNSUPPORTED = ["PROVIDES_ABSOLUTE_PROHIBITION", "CONFIRMS_DIAGNOSIS", "DEMONSTRATES_EFFICACY", "PROVIDES_MANAGEMENT_RULE", "PROVES_SUPERIORITY"]
#: How far below a bound it is looked at.
PROBES = [1, 5, 14]


def _positive(p: Column) -> Column:
    return p["polarity"] == "POSITIVE"


def _in(c: Column, names: list[str]) -> Column:
    return c.isin(names)


def _holds(c: Column, v: Column) -> Column:
    held = F.when(c["operator"] == "LT", v < c["value"]).when(c["operator"] == "EQ", v == c["value"]).when(c["operator"] == "RANGE", (v >= c["low"]) & (v <= c["high"]))
    return F.coalesce(held, F.lit(False))


def _acting(evidence: Column, v: Column, who: Column) -> Column:
    """The actions that the evidence asks for at a value, for a population (null: any)."""
    fits = who.isNull()
    own = F.filter(evidence, lambda e: _in(e["predicate"], ACTIONS) & _positive(e) & F.coalesce(fits | e["population"].isNull() | (e["population"] == who), F.lit(False)) & F.exists(e["conditions"], lambda c: _holds(c, v)))
    return F.array_distinct(F.transform(own, lambda e: e["predicate"]))


def _same(e: Column, c: Column) -> Column:
    return (e["predicate"] == c["predicate"]) & (~_in(c["predicate"], DIRECTED) | (e["subject"].eqNullSafe(c["subject"]) & e["object"].eqNullSafe(c["object"])))


def ladder(evidence: Column, claim: Column) -> Column:
    """struct<relation, cue> of a claim's propositions by those of its evidence: the first rung that decides.

    Actions at a stated value, actions over a stated region (looked at in three points), explicit denials, currency, registry
    facts, mechanisms, associations, risks, classes, then how many of the claim's statements the evidence makes.
    """
    out = lambda relation, cue: F.struct(F.lit(relation).alias("relation"), F.lit(cue).alias("cue"))
    said = F.filter(claim, _positive)
    backed = lambda c: F.exists(evidence, lambda e: _same(e, c) & _positive(e))
    denied = lambda c: F.exists(evidence, lambda e: _same(e, c) & (e["polarity"] == "NEGATIVE"))
    having = lambda props, *names: F.exists(props, lambda p: _in(p["predicate"], list(names)) & _positive(p))

    value = F.get(F.transform(F.filter(F.flatten(F.transform(claim, lambda p: p["conditions"])), lambda c: c["operator"] == "EQ"), lambda c: c["value"]), F.lit(0))
    asked = F.array_distinct(F.transform(F.filter(said, lambda p: _in(p["predicate"], ACTIONS)), lambda p: p["predicate"]))
    people = F.array_compact(F.array_distinct(F.transform(claim, lambda p: p["population"])))
    who = F.when(F.size(people) == 1, F.get(people, F.lit(0))).when(F.array_contains(people, "existing_user"), "existing_user").when(F.array_contains(people, "new_or_initiating_user"), "new_or_initiating_user")
    at_value = _acting(evidence, value, who)
    numeric = F.when(F.arrays_overlap(asked, at_value), out("DIRECT_SUPPORT", "atomic_numeric_support")).when(F.size(at_value) > 0, out("CONTRADICTS", "atomic_numeric_action_conflict")).otherwise(out("DOES_NOT_SUPPORT", "no_evidence_rule_for_claimed_action"))

    def region(p: Column, c: Column) -> Column:
        v, low, high = (c[n].cast("double") for n in ("value", "low", "high"))
        points = F.when(c["operator"] == "LT", F.array(*[F.greatest(F.lit(0.0), v - d) for d in PROBES])).when(c["operator"] == "RANGE", F.array(low, (low + high) / 2, high))
        acts = F.transform(points, lambda x: _acting(evidence, x, p["population"]))
        good = F.size(F.filter(acts, lambda a: F.array_contains(a, p["predicate"])))
        bad = F.exists(acts, lambda a: (F.size(a) > 0) & ~F.array_contains(a, p["predicate"]))
        return F.when(points.isNotNull() & bad, out("CONTRADICTS", "claimed_region_contains_action_conflict")).when(good == F.size(points), out("DIRECT_SUPPORT", "claimed_region_fully_supported")).when(good > 0, out("PARTIAL_SUPPORT", "claimed_region_partially_supported"))

    regions = F.flatten(F.transform(F.filter(said, lambda p: _in(p["predicate"], ACTIONS)), lambda p: F.transform(p["conditions"], lambda c: region(p, c))))
    first = lambda xs: F.get(F.array_compact(xs), F.lit(0))
    denials = F.transform(said, lambda c: F.when(denied(c) & _in(c["predicate"], DENIED_CONTRADICTS), out("CONTRADICTS", "explicit_negative_polarity")).when(denied(c) & _in(c["predicate"], DENIED_UNSUPPORTED), out("DOES_NOT_SUPPORT", "explicit_absence_or_limitation")))
    facts = F.filter(said, lambda c: _in(c["predicate"], ["HAS_STATUS", "HAS_PRIMARY_ENDPOINT"]))
    genotype = lambda props: F.exists(props, lambda p: (p["predicate"] == "ASSOCIATED_WITH") & (p["subject"] == "genotype") & _positive(p))
    classes = F.filter(said, lambda c: c["predicate"] == "CLASSIFIED_AS")
    follows = F.filter(said, lambda c: c["predicate"] == "RECOMMENDS_FOLLOWUP")
    vague = F.exists(evidence, lambda e: (e["predicate"] == "CLASSIFIED_AS") & (e["object"] == "indeterminate") & _positive(e))
    classed = F.transform(classes, lambda c: F.when(backed(c) & F.forall(follows, backed), out("DIRECT_SUPPORT", "report_classification_scope_preserved")).when((c["object"] == "malignant") & vague, out("DOES_NOT_SUPPORT", "indeterminate_not_malignant")))
    matched = F.size(F.filter(said, backed))
    rungs = [
        F.when(value.isNotNull() & (F.size(asked) > 0), numeric),
        first(regions),
        first(denials),
        F.when(F.exists(said, lambda c: (c["predicate"] == "IS_CURRENT") & backed(c)), out("DIRECT_SUPPORT", "current_entity_supported")),
        F.when((F.size(facts) > 0) & F.forall(facts, backed), out("DIRECT_SUPPORT", "registry_atomic_facts_supported")),
        F.when(having(claim, "POTENTIAL_PK_INTERACTION") & having(evidence, "POTENTIAL_PK_INTERACTION"), out("DIRECT_SUPPORT", "bounded_pk_mechanism_supported")),
        F.when(genotype(claim) & genotype(evidence), out("DIRECT_SUPPORT", "pgx_association_preserved")),
        F.when(having(claim, "INCREASES_RISK") & having(evidence, "INCREASES_RISK"), out("DIRECT_SUPPORT", "risk_relation_preserved")),
        first(classed),
        F.when((F.size(said) > 0) & (matched == F.size(said)), out("DIRECT_SUPPORT", "all_atomic_claims_supported")),
        F.when(matched > 0, out("PARTIAL_SUPPORT", "some_atomic_claims_supported")),
    ]
    return F.coalesce(*rungs, out("DOES_NOT_SUPPORT", "conservative_atomic_default"))


def verdicts(cases: DataFrame, key: str, evidence: str = "evidence", claim: str = "claim", guard: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(key, relation, cue) of cases (key, evidence and claim texts) with different keys; a text without propositions has none.

    Where guard(evidence text, its propositions) holds, the relation is ABSTAIN.
    """
    both = cases.select(key, F.explode(F.array(F.struct(F.lit("e").alias("side"), F.col(evidence).alias("text")), F.struct(F.lit("c").alias("side"), F.col(claim).alias("text")))).alias("x"))
    named = both.select(F.struct(F.col(key), F.col("x.side").alias("side")).alias("k"), F.col("x.text").alias("text"))
    own = gathered(parsed(named, "k"), "k").select(F.col(f"k.{key}").alias(key), F.col("k.side").alias("side"), "props")
    sides = own.groupBy(key).agg(F.max(F.when(F.col("side") == "e", F.col("props"))).alias("e"), F.max(F.when(F.col("side") == "c", F.col("props"))).alias("c"))
    return decided(cases.select(key, F.col(evidence).alias("__t")).join(sides, key, "left"), key, F.col("__t"), guard)


def decided(cases: DataFrame, key: str, evidence: Column, guard: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(key, relation, cue) of cases with the gathered propositions of their evidence (e) and claim (c), null: none."""
    none = F.array().cast(f"array<struct<clause: int, rule: int, {PROPOSITION[7:-1].replace(', confidence: double', '')}>>")
    j = cases.withColumns({"e": F.coalesce("e", none), "c": F.coalesce("c", none)})
    v = ladder(F.col("e"), F.col("c"))
    if guard is not None:
        v = F.when(guard(evidence, F.col("e")), F.struct(F.lit("ABSTAIN").alias("relation"), F.lit("guard").alias("cue"))).otherwise(v)
    return j.select(key, v.alias("v")).select(key, "v.*")
