"""Claims against evidence over the driver's tables: scoped actions, directed and categorical statements, lexical cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import core, entail, evaluation, extract

from .registry import Derived, query

# ---- scoped actions: a part's type is the case, its brand the object, its size the measured value

_ACTION = "CASE CAST(substr(p_brand, 7) AS INT) % 4 WHEN 0 THEN 'CONTRAINDICATED' WHEN 1 THEN 'DISCONTINUE' WHEN 2 THEN 'REASSESS_BENEFIT_RISK' ELSE 'INITIATION_NOT_RECOMMENDED' END"
_POPULATION = "CASE p_partkey % 7 WHEN 0 THEN 'adult' WHEN 1 THEN 'child' END"
_IDENTITY = {"case_id": "p_type", "subject": "'drug'", "predicate": _ACTION, "object": "p_brand", "polarity": "CASE WHEN p_partkey % 5 = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END", "population": _POPULATION}
_EVIDENCE = Derived("part", {
    **_IDENTITY, "operator": "CASE p_partkey % 6 WHEN 0 THEN 'RANGE' WHEN 2 THEN 'LT' WHEN 4 THEN CASE WHEN p_size > 40 THEN NULL ELSE 'GTE' END END",
    "value": "CASE WHEN p_partkey % 6 IN (2, 4) THEN CAST(p_size AS DOUBLE) END", "low": "CASE WHEN p_partkey % 6 = 0 THEN p_size - 4.0 END", "high": "CASE WHEN p_partkey % 6 = 0 THEN p_size + 4.0 END",
    "semantics": "CASE WHEN p_partkey % 4 = 0 THEN 'EXACT_DOMAIN' ELSE 'SUFFICIENT_ONLY' END",
}, "p_partkey % 12 IN (0, 2, 4)")
_POINTS = Derived("part", {**_IDENTITY, "claim_id": "p_partkey", "operator": "'EQ'", "value": "CAST(p_size AS DOUBLE)", "low": "CAST(NULL AS DOUBLE)", "high": "CAST(NULL AS DOUBLE)"}, "p_partkey % 2 = 1")
_RULES = Derived("part", {
    **_IDENTITY, "claim_id": "p_partkey", "operator": "CASE p_partkey % 5 WHEN 0 THEN 'RANGE' WHEN 1 THEN 'LT' WHEN 2 THEN 'GTE' WHEN 3 THEN 'RANGE' END",
    "value": "CAST(p_size AS DOUBLE)", "low": "p_size - 1.0", "high": "p_size + 1.0",
}, "p_partkey % 2 = 1")


def _action_sql(claims: Derived) -> str:
    bound = lambda t: (
        f"CASE {t}.operator WHEN 'RANGE' THEN {t}.low WHEN 'EQ' THEN {t}.value WHEN 'GTE' THEN {t}.value ELSE CAST('-inf' AS DOUBLE) END AS lo, coalesce({t}.operator IN ('RANGE', 'EQ', 'GTE'), false) AS lc, "
        f"CASE {t}.operator WHEN 'RANGE' THEN {t}.high WHEN 'EQ' THEN {t}.value WHEN 'LT' THEN {t}.value ELSE CAST('inf' AS DOUBLE) END AS hi, coalesce({t}.operator IN ('RANGE', 'EQ'), false) AS hc"
    )
    fits = "(e.population IS NULL OR coalesce(e.population = c.population, false))"
    ident = "e.case_id = c.case_id AND e.subject = c.subject AND e.predicate = c.predicate AND e.object = c.object"
    holds = "((c.lo > e.lo OR (c.lo = e.lo AND e.lc)) AND (c.lo < e.hi OR (c.lo = e.hi AND e.hc)))"
    sub = lambda a, b: f"(({a}.lo > {b}.lo OR ({a}.lo = {b}.lo AND (NOT {a}.lc OR {b}.lc))) AND ({a}.hi < {b}.hi OR ({a}.hi = {b}.hi AND (NOT {a}.hc OR {b}.hc))))"
    some = lambda cond: f"EXISTS (SELECT 1 FROM e WHERE {cond})"
    same, other = f"{ident} AND {fits} AND e.polarity = c.polarity", f"{ident} AND {fits} AND e.polarity <> c.polarity"
    return f"""
WITH c0 AS ({claims.sql()}), e0 AS ({_EVIDENCE.sql()}),
c AS (SELECT *, {bound("c0")}, coalesce(operator = 'EQ', false) AS point FROM c0), e AS (SELECT *, {bound("e0")} FROM e0),
v AS (SELECT case_id, claim_id, CASE WHEN point THEN
  CASE WHEN {some(f"{same} AND {holds}")} THEN 'SUPPORTED' WHEN {some(f"{other} AND {holds}")} THEN 'CONTRADICTED'
    WHEN {some(f"{same} AND e.operator IS NOT NULL AND e.semantics = 'EXACT_DOMAIN'")} THEN 'CONTRADICTED'
    WHEN c.polarity = 'NEGATIVE' AND {some(f"{ident} AND {fits} AND e.polarity = 'POSITIVE' AND e.operator IS NOT NULL AND e.semantics = 'EXACT_DOMAIN'")} THEN 'SUPPORTED'
    WHEN c.polarity = 'POSITIVE' AND {some(f"e.case_id = c.case_id AND e.polarity = 'POSITIVE' AND {fits} AND {holds}")} THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END
  ELSE CASE WHEN {some(f"{same} AND {sub('c', 'e')}")} THEN 'SUPPORTED' WHEN {some(f"{same} AND e.semantics = 'EXACT_DOMAIN'")} THEN 'CONTRADICTED'
    WHEN {some(f"{other} AND ({sub('c', 'e')} OR {sub('e', 'c')})")} THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END END AS verdict FROM c)
"""


@query(_action_sql(_POINTS) + "SELECT claim_id AS p_partkey, verdict FROM v")
def point_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims at one value: both polarities, populations, open and exact domains, competing actions."""
    found = entail.verdicts(_POINTS.rows(spark, sf_dir), _EVIDENCE.rows(spark, sf_dir))
    return found.select(F.col("claim_id").alias("p_partkey"), "verdict")


@query(
    _action_sql(_RULES)
    + """, g AS (SELECT case_id, count(*) FILTER (WHERE verdict = 'SUPPORTED') AS supported, count(*) FILTER (WHERE verdict = 'CONTRADICTED') AS contradicted, count(*) AS claims FROM v GROUP BY 1)
SELECT v.case_id, v.claim_id, v.verdict, CASE WHEN supported = claims THEN 'DIRECT_SUPPORT' WHEN supported > 0 THEN 'PARTIAL_SUPPORT' WHEN contradicted > 0 THEN 'CONTRADICTS' ELSE 'DOES_NOT_SUPPORT' END AS relation FROM v JOIN g USING (case_id)
"""
)
def rule_subset_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims over intervals against evidence over intervals, and what they make of their case."""
    claims = _RULES.rows(spark, sf_dir)
    found = entail.verdicts(claims, _EVIDENCE.rows(spark, sf_dir))
    return found.join(entail.relations(claims, found).select("case_id", "relation"), "case_id").select("case_id", "claim_id", "verdict", "relation")


# ---- directed and categorical statements: a nation is the case

_KINDS = "CASE {0} % 9 WHEN 0 THEN 'SUPERSEDES' WHEN 1 THEN 'CLASSIFIED_AS' WHEN 2 THEN 'RISK_RANKING' WHEN 3 THEN 'ASSOCIATION_RANKING' WHEN 4 THEN 'ACHIEVES_ENDPOINT' WHEN 5 THEN 'GUIDELINE_RECOMMENDS' WHEN 6 THEN 'CONFIRMS_DIAGNOSIS' WHEN 7 THEN 'ESTABLISHES_ENDPOINT_ACHIEVEMENT' ELSE 'REPORTS' END"


def _statements(name: str, key: str, nation: str, more: dict[str, str]) -> Derived:
    nothing = {c: "CAST(NULL AS DOUBLE)" for c in ("value", "low", "high")}
    return Derived(name, {
        "case_id": nation, "subject": f"concat('v', CAST({key} % 2 AS STRING))", "predicate": _KINDS.format(f"({key})"),
        "object": f"CASE WHEN {key} % 9 = 1 THEN CASE {key} % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'malignant' WHEN 2 THEN 'unclear' ELSE 'benign' END ELSE concat('v', CAST(({key} + 1) % 2 + CASE WHEN {key} % 11 = 0 THEN 2 ELSE 0 END AS STRING)) END",
        "polarity": f"CASE WHEN {key} % 3 = 2 OR {key} % 9 = 7 THEN 'NEGATIVE' ELSE 'POSITIVE' END", "population": "CAST(NULL AS STRING)", "operator": "CAST(NULL AS STRING)", **nothing, **more,
    })


_SAID = _statements("customer", "c_custkey", "c_nationkey", {"claim_id": "c_custkey"})
_KNOWN = _statements("supplier", "(s_suppkey * 5 + 1)", "s_nationkey", {"semantics": "CAST(NULL AS STRING)"})


def _statement_sql() -> str:
    some = lambda cond: f"EXISTS (SELECT 1 FROM e WHERE e.case_id = c.case_id AND {cond})"
    pred, s, o, pol = "e.predicate = c.predicate", "e.subject = c.subject", "e.object = c.object", "e.polarity = c.polarity"
    pos = "e.polarity = 'POSITIVE'"
    match = f"CASE WHEN {some(f'{pred} AND {s} AND {o} AND {pol}')} THEN 'SUPPORTED' WHEN {some(f'{pred} AND {s} AND {o} AND NOT {pol}')} THEN CASE WHEN c.polarity = 'POSITIVE' AND c.predicate IN ('CONFIRMS_DIAGNOSIS', 'ACHIEVES_ENDPOINT', 'RISK_RANKING') THEN 'UNSUPPORTED' ELSE 'CONTRADICTED' END ELSE 'UNSUPPORTED' END"
    classes = "('benign', 'malignant')"
    return f"""
WITH c AS ({_SAID.sql()}), e AS ({_KNOWN.sql()})
SELECT claim_id, c.predicate, CASE
  WHEN c.predicate = 'SUPERSEDES' THEN CASE WHEN {some(f"{pred} AND {s} AND {o} AND {pol}")} THEN 'SUPPORTED'
    WHEN c.polarity = 'POSITIVE' AND {some(f"{pred} AND {pos} AND e.subject = c.object AND e.object = c.subject")} THEN 'CONTRADICTED' ELSE 'UNSUPPORTED' END
  WHEN c.predicate = 'CLASSIFIED_AS' AND c.polarity = 'POSITIVE' AND {some(f"{pred} AND {pos} AND {s} AND {o}")} THEN 'SUPPORTED'
  WHEN c.predicate = 'CLASSIFIED_AS' AND c.polarity = 'POSITIVE' AND c.object IN {classes} AND {some(f"{pred} AND {pos} AND {s} AND e.object IN {classes}")} THEN 'CONTRADICTED'
  WHEN c.predicate = 'RISK_RANKING' THEN CASE WHEN {some(f"{pred} AND {s} AND {o} AND {pol}")} THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END
  WHEN c.predicate = 'ASSOCIATION_RANKING' THEN CASE WHEN {some(f"{pred} AND {o} AND {pol}")} THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END
  WHEN c.predicate = 'ACHIEVES_ENDPOINT' AND c.polarity = 'POSITIVE' AND {some(f"{pred} AND {o} AND {pos}")} THEN 'SUPPORTED'
  WHEN c.predicate = 'ACHIEVES_ENDPOINT' AND c.polarity = 'POSITIVE' AND {some("e.predicate = 'ESTABLISHES_ENDPOINT_ACHIEVEMENT' AND e.polarity = 'NEGATIVE'")} THEN 'UNSUPPORTED'
  WHEN c.predicate = 'GUIDELINE_RECOMMENDS' AND c.polarity = 'POSITIVE' AND {some(f"{pred} AND {pos} AND {s} AND {o}")} THEN 'SUPPORTED'
  WHEN c.predicate = 'GUIDELINE_RECOMMENDS' AND c.polarity = 'POSITIVE' AND {some(f"{pred} AND {pos} AND {s}")} THEN 'CONTRADICTED'
  ELSE {match} END AS verdict FROM c
"""


@query(_statement_sql())
def statement_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supersession with its direction, exclusive classes, rankings, endpoints, recommendations and plain matches."""
    claims = _SAID.rows(spark, sf_dir)
    return entail.verdicts(claims, _KNOWN.rows(spark, sf_dir)).join(claims.select("case_id", "claim_id", "predicate"), ["case_id", "claim_id"]).select("claim_id", "predicate", "verdict")


# ---- lexical claims

_LEXICAL = Derived("orders", {
    "item": "o_orderkey",
    "evidence": "CASE o_orderkey % 11 WHEN 0 THEN 'Reports cannot establish a causal link to the drug' WHEN 1 THEN 'Report counts cannot be used to estimate rates' WHEN 2 THEN 'Version 2 supersedes version 1' WHEN 3 THEN 'The guideline has not yet been revised' WHEN 4 THEN 'The label does not specify a dose' WHEN 5 THEN 'Trial registered at ClinicalTrials.gov' WHEN 6 THEN 'A possible serious adverse reaction' WHEN 7 THEN concat('Contraindicated below ', CAST(o_custkey % 3 AS STRING), ' of renal function') ELSE concat('renal dose of drug', CAST(o_custkey % 5 AS STRING), ' is lower for adult patients with disease') END",
    "claim": "CASE o_orderkey % 11 WHEN 0 THEN 'This proves causality' WHEN 1 THEN 'They obtain the incidence' WHEN 2 THEN 'Version 1 remains the current' WHEN 3 THEN 'It automatically means a change' WHEN 4 THEN 'So the dose must be changed' WHEN 5 THEN 'The registry proves efficacy' WHEN 6 THEN 'The patient has confirmed disease' WHEN 7 THEN concat('contraindicated if function is below ', CAST(o_orderkey % 3 AS STRING)) WHEN 8 THEN concat('the renal dose of drug', CAST(o_orderkey % 5 AS STRING), ' is lower') WHEN 9 THEN concat('drug', CAST(o_orderkey % 5 AS STRING), ' patients need no other treatment at all') ELSE 'of the and' END",
})


def _lexical_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in ["the", "a", "an", "of", "to", "and", "or", "for", "in", "on", "with", "is", "are", "be", "by", "that", "this", "as", "it", "from", "at", "when", "if", "but", "has", "have", "had", "can", "all"])
    bag = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN (" + stop + ")))"
    says = lambda t, phrases: "(" + " OR ".join(f"contains({t}, '{p}')" for p in phrases) + ")"
    rules = [
        ("CONTRADICTS", ["cannot by themselves establish a causal", "cannot establish a causal", "causality requires other evidence"], ["proves that the drug caused", "proves causality", "caused the reported adverse"]),
        ("CONTRADICTS", ["cannot be used to estimate", "cannot estimate", "report counts cannot"], ["true adverse-event incidence", "true incidence", "obtain the incidence"]),
        ("CONTRADICTS", ["superseded", "supersedes"], ["version 1 remains the current", "old guideline remains current"]),
        ("CONTRADICTS", ["has not yet been revised", "still recommends", "has not yet changed"], ["automatically means", "guideline now recommends"]),
        ("DOES_NOT_SUPPORT", ["does not specify", "does not state", "contains no", "management must be supported separately"], ["supports replacing", "clinically contraindicated", "dose must be changed", "must be changed"]),
        ("DOES_NOT_SUPPORT", ["registry", "registered", "clinicaltrials.gov"], ["proves that the treatment is clinically effective", "proves efficacy"]),
        ("DOES_NOT_SUPPORT", ["possible serious adverse", "possible", "can precipitate"], ["confirmed serotonin syndrome", "has confirmed"]),
    ]
    ladder = " ".join(f"WHEN {says('e', ev)} AND {says('c', cl)} THEN '{r}'" for r, ev, cl in rules)
    below = "regexp_extract({0}, '(?:below|<)\\s*(\\d+)', 1)"
    return f"""
WITH t AS ({_LEXICAL.sql()}), w AS (SELECT item, lower(evidence) AS e, lower(claim) AS c, {bag.format("evidence")} AS we, {bag.format("claim")} AS wc FROM t),
s AS (SELECT *, CASE WHEN len(wc) = 0 THEN 0.0 ELSE len(list_intersect(wc, we)) / len(wc) END AS score, {below.format("e")} AS be, {below.format("c")} AS bc FROM w)
SELECT item, round(score, 6) AS score, CASE {ladder} WHEN contains(c, 'contraindicat') AND contains(e, 'contraindicat') AND be <> '' AND bc <> '' AND be <> bc THEN 'CONTRADICTS'
  WHEN score >= 0.62 THEN 'DIRECT_SUPPORT' WHEN score >= 0.38 THEN 'PARTIAL_SUPPORT' ELSE 'DOES_NOT_SUPPORT' END AS relation FROM s
"""


@query(_lexical_sql())
def lexical_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical verifier over sentences made from orders: every cue rule, the threshold check, and the shares of words."""
    v = extract.lexical_verdict(F.col("claim"), F.col("evidence"))
    return _LEXICAL.rows(spark, sf_dir).withColumn("v", v).select("item", F.round("v.score", 6).alias("score"), F.col("v.relation").alias("relation"))


# ---- routing by negation, and the joint pipeline

_ASKED = Derived("events", {
    "query_id": "event_id",
    "question": "concat('What is known about ', CASE user_id % 5 WHEN 0 THEN 'renal dosing' WHEN 1 THEN 'a trial registry status' WHEN 2 THEN 'interactions' WHEN 3 THEN 'renal interactions' ELSE 'storage' END, CASE event_type WHEN 'click' THEN ', not dosing. Use DailyMed' WHEN 'view' THEN '? Without PubMed please' WHEN 'purchase' THEN '; instead of FAERS' WHEN 'error' THEN ', dosing is not needed, 不要PubMed' ELSE ' for dosing, PubMed除外' END)",
})
#: Phrases of each feature, intents by priority, and their ranked sources.
FEATURES = {"renal": ["renal"], "dose": ["dosing", "dose"], "trial": ["trial registry", "trial"], "interaction": ["interactions"]}
INTENTS = [("renal_dose", 3.0, ["renal", "dose"], [], []), ("interaction", 2.0, ["interaction"], ["renal"], ["dose"]), ("trial_status", 2.0, ["trial"], [], []), ("dosing", 1.0, [], ["dose", "renal"], ["trial"])]
POLICY = [("renal_dose", ["DAILYMED_SPL", "PUBMED", "OPENFDA_FAERS", "RXNORM"]), ("interaction", ["PUBMED", "OPENFDA_FAERS", "DAILYMED_SPL", "LOINC"]), ("trial_status", ["CLINICALTRIALS_GOV", "PUBMED"]), ("dosing", ["DAILYMED_SPL", "RXNORM"]), ("other", ["PUBMED", "DAILYMED_SPL"])]


def _negated(phrase: str) -> str:
    """Whether any occurrence is negated; the questions hold each phrase with the cues that the rule reads."""
    cues = r"(\bnot|\bno|\bwithout|\bexclude(d|s|ing)?|\bexcluding|\bdo\s+not\s+(want|need|use|check|search|look\s+for)|\bdon''t\s+(want|need|use|check|search)|\bnot\s+looking\s+for|\brather\s+than|\binstead\s+of|不要|不用|排除)\s*"
    after = r"\s*(不需要|不用|不要|除外|排除|is\s+not\s+needed|not\s+needed|is\s+excluded)"
    p = phrase.replace(".", r"\.").replace("(", r"\(")
    return f"regexp_matches(q, '{cues}{p}') OR regexp_matches(q, '{p}{after}')"


def _routing_sql() -> str:
    group = lambda phrases: "(" + " OR ".join(f"contains(q, '{p}')" for p in phrases) + ") AND NOT (" + " OR ".join(_negated(p) for p in phrases) + ")"
    feats = ", ".join(f"({group(ps)}) AS f_{n}" for n, ps in FEATURES.items())
    aliases = {"PUBMED": ["pubmed"], "CLINICALTRIALS_GOV": ["clinicaltrials.gov", "trial registry"], "DAILYMED_SPL": ["dailymed"], "OPENFDA_FAERS": ["faers"]}
    out = ", ".join(f"CASE WHEN {' OR '.join(_negated(a) for a in names)} THEN '{s}' END" for s, names in aliases.items())
    scored = []
    for k, (name, prio, need, some, none) in enumerate(INTENTS):
        cond = [f"f_{x}" for x in need] + ([f"({' OR '.join(f'f_{x}' for x in some)})"] if some else []) + [f"NOT f_{x}" for x in none]
        hits = " + ".join(f"CAST(f_{x} AS INT)" for x in [*need, *some])
        scored.append(f"CASE WHEN {' AND '.join(cond)} THEN {prio} + 0.01 * ({hits}) END AS s{k}")
    best = "greatest(" + ", ".join(f"coalesce(s{k}, 0)" for k in range(len(INTENTS))) + ")"
    pick = " ".join(f"WHEN s{k} = {best} THEN '{name}'" for k, (name, *_) in enumerate(INTENTS))
    policy = ", ".join(f"('{i}', {r!r})" for i, r in POLICY)
    return f"""
WITH t AS ({_ASKED.sql()}), q AS (SELECT query_id, lower(trim(question)) AS q FROM t), f AS (SELECT *, {feats}, list_filter([{out}], lambda x: x IS NOT NULL) AS excluded FROM q),
s AS (SELECT *, {", ".join(scored)} FROM f), i AS (SELECT query_id, excluded, CASE {pick} ELSE 'other' END AS intent, CAST(round({best}, 6) AS DOUBLE) AS score FROM s), p(intent, ranked) AS (VALUES {policy}),
r AS (SELECT query_id, intent, score, list_filter(ranked, lambda x: NOT list_contains(excluded, x))[1:3] AS sources FROM i JOIN p USING (intent))
"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, intent, score, sources)"""
    asked = _ASKED.rows(spark, sf_dir)
    positive = extract.features(asked, "query_id", "question", FEATURES)
    intents = extract.routed(asked, "query_id", positive, INTENTS, "other")
    policy = F.broadcast(spark.createDataFrame(POLICY, "intent string, ranked array<string>"))
    ranked = extract.ranked_sources(intents, "query_id", policy, extract.excluded_sources(asked, "query_id", "question"))
    return ranked.join(intents.select("query_id", F.round("score", 6).alias("score")), "query_id")


@query(_routing_sql() + "SELECT query_id, intent, score, array_to_string(sources, ',') AS sources FROM r")
def negation_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents and ranked sources of questions, with features and sources that the question excludes."""
    return _routed(spark, sf_dir).select("query_id", "intent", "score", F.array_join("sources", ",").alias("sources"))
