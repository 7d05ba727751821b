"""Scores, metrics and comparisons through the evaluation operators, over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import evaluation as ev
from quern.operators import governance as gov
from quern.operators import review

from .registry import Derived, query, table

# ---- sessions: orders; criteria: four a suite; observations: line items

_SESSIONS = Derived("orders", {"session_id": "o_orderkey", "suite": "concat('suite', CAST(o_orderkey % 2 AS STRING))", "status": "CASE WHEN o_orderkey % 7 = 0 THEN 'target_error' WHEN o_orderkey % 11 = 0 THEN 'measurement_invalid' ELSE 'completed' END"})
_CRITERIA = [("suite0", "c1", "clinical", True, True), ("suite0", "c2", "mechanical", True, False), ("suite0", "c3", "mechanical", False, True), ("suite1", "c1", "mechanical", False, True), ("suite1", "c2", "clinical", True, True), ("suite1", "c4", "clinical", False, False)]
_SEEN = Derived("lineitem", {
    "session_id": "l_orderkey", "criterion_id": "concat('c', CAST(l_linenumber AS STRING))", "outcome": "CASE l_partkey % 6 WHEN 0 THEN 'fail' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'unassessed' ELSE 'pass' END",
    "source": "CASE WHEN l_suppkey % 4 = 0 THEN 'deterministic' ELSE 'human' END", "reason": "CASE WHEN l_partkey % 12 = 1 THEN '' ELSE 'seen' END", "applicability": "CASE WHEN l_suppkey % 3 = 0 THEN 'legitimate_stop' END", "turns": "CAST(l_partkey % 3 AS INT)",
}, "l_linenumber <= 4")
_CRITERIA_SQL = "criteria(suite, criterion_id, kind, critical, required) AS (VALUES " + ", ".join(f"('{s}', '{c}', '{k}', {str(a).lower()}, {str(b).lower()})" for s, c, k, a, b in _CRITERIA) + ")"


def _criteria(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(_CRITERIA, "suite string, criterion_id string, kind string, critical boolean, required boolean"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a criterion's kind is that of its suite, so observations meet the suite's criteria only
    seen = _SEEN.rows(spark, sf_dir).where("criterion_id in ('c1', 'c2', 'c3', 'c4')")
    criteria, sessions = _criteria(spark), _SESSIONS.rows(spark, sf_dir)
    out = None
    for suite in ("suite0", "suite1"):
        own = criteria.where(F.col("suite") == suite)
        one = ev.criterion_results(seen, own, sessions.where(F.col("suite") == suite))
        out = one if out is None else out.unionByName(one)
    return out


_RESULTS = f"""
WITH s AS ({_SESSIONS.sql()}), o AS ({_SEEN.sql()}), {_CRITERIA_SQL},
g AS (SELECT s.session_id, s.status, c.*, CASE WHEN s.status = 'measurement_invalid' OR o.outcome IS NULL THEN 'unassessed' WHEN c.kind = 'clinical' AND o.source <> 'human' THEN 'unassessed' ELSE o.outcome END AS first, o.applicability
  FROM s JOIN criteria c USING (suite) LEFT JOIN o ON o.session_id = s.session_id AND o.criterion_id = c.criterion_id),
u AS (SELECT *, status = 'target_error' AND required AND (first = 'unassessed' OR (first = 'not_applicable' AND applicability IS DISTINCT FROM 'legitimate_stop')) AS unmet FROM g),
r AS (SELECT *, CASE WHEN unmet THEN 'fail' ELSE first END AS outcome FROM u),
sc AS (SELECT session_id, status, count(*) AS criteria, count(*) FILTER (WHERE outcome = 'pass') AS pass, count(*) FILTER (WHERE outcome = 'fail') AS fail, count(*) FILTER (WHERE outcome = 'unassessed') AS unassessed, count(*) FILTER (WHERE outcome = 'not_applicable') AS not_applicable,
  count(*) FILTER (WHERE outcome IN ('pass', 'fail') AND NOT unmet) AS evidence_assessed, count(*) FILTER (WHERE unmet) AS operational_unmet, bool_or(critical AND outcome = 'fail' AND NOT (kind = 'clinical' AND unmet)) AS failed,
  bool_or(critical AND (outcome = 'unassessed' OR (kind = 'clinical' AND unmet))) AS unknown, bool_or(critical AND outcome <> 'not_applicable') AS applies FROM r GROUP BY 1, 2),
sx AS (SELECT *, CASE WHEN failed THEN true WHEN status = 'measurement_invalid' OR unknown OR NOT applies THEN NULL ELSE false END AS critical_failure, status <> 'measurement_invalid' AND unassessed = 0 AND operational_unmet = 0 AS complete FROM sc),
sy AS (SELECT *, complete AND pass + fail > 0 AND fail = 0 AND status = 'completed' AS fully_passed FROM sx)
"""


@query(_RESULTS + "SELECT session_id, status, pass, fail, unassessed, not_applicable, evidence_assessed, operational_unmet, round(evidence_assessed / nullif(criteria - not_applicable, 0), 6) AS coverage, critical_failure, complete, fully_passed FROM sy")
def session_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions scored with unknowns kept: unmet probes of broken targets, automated clinical judgements, tri-state safety."""
    return ev.session_scores(_results(spark, sf_dir)).select("session_id", "status", "pass", "fail", "unassessed", "not_applicable", "evidence_assessed", "operational_unmet", "coverage", "critical_failure", "complete", "fully_passed")


@query(
    _RESULTS
    + """, t AS (SELECT count(*) AS sessions, count(*) FILTER (WHERE v) AS valid, count(*) FILTER (WHERE status = 'target_error') AS target_errors, count(*) FILTER (WHERE v AND complete) AS complete, count(*) FILTER (WHERE v AND fully_passed) AS fully_passed,
  count(*) FILTER (WHERE v AND critical_failure) AS critical_failures, count(*) FILTER (WHERE v AND critical_failure IS NOT NULL) AS critical_assessed, sum(evidence_assessed) FILTER (WHERE v) AS ea, sum(pass + fail + unassessed) FILTER (WHERE v) AS ju FROM (SELECT *, status <> 'measurement_invalid' AS v FROM sy))
SELECT sessions, valid, sessions - valid AS invalid, target_errors, complete, fully_passed, critical_failures, critical_assessed, round((valid - target_errors) / nullif(valid, 0), 6) AS service_completion, round(critical_failures / nullif(critical_assessed, 0), 6) AS critical_failure_rate, round(ea / nullif(ju, 0), 6) AS coverage FROM t
"""
)
def suite_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ev.suite_summary(ev.session_scores(_results(spark, sf_dir)))
    return s.select("sessions", "valid", "invalid", "target_errors", "complete", "fully_passed", "critical_failures", "critical_assessed", "service_completion", "critical_failure_rate", "coverage")


@query(
    f"""
WITH o AS ({_SEEN.sql()}), {_CRITERIA_SQL}
SELECT session_id, criterion_id, 'UNKNOWN_CRITERION' AS rule FROM o WHERE criterion_id NOT IN (SELECT criterion_id FROM criteria WHERE criterion_id <> 'c4')
UNION ALL SELECT session_id, criterion_id, 'NO_EVIDENCE' FROM o WHERE outcome IN ('pass', 'fail') AND turns = 0
UNION ALL SELECT session_id, criterion_id, 'NO_REASON' FROM o WHERE outcome = 'not_applicable' AND reason = ''
UNION ALL SELECT session_id, criterion_id, 'REPEATED' FROM o GROUP BY 1, 2 HAVING count(*) > 1
"""
)
def observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _SEEN.rows(spark, sf_dir).withColumn("evidence", F.when(F.col("turns") > 0, F.array_repeat(F.lit("t"), F.col("turns"))).otherwise(F.array().cast("array<string>")))
    return ev.observation_violations(seen, _criteria(spark).where("criterion_id <> 'c4'"))


_REVIEWS = Derived("lineitem", {
    "criterion_id": "concat('c', CAST(l_linenumber AS STRING))", "required": "l_suppkey % 3 = 0", "opportunity": "CASE l_partkey % 5 WHEN 0 THEN 'not_reached' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'unassessed' ELSE 'occurred' END",
    "quality_status": "CASE WHEN l_partkey % 4 = 0 THEN 'unassessed' ELSE 'assessed' END", "rating": "CAST(l_suppkey % 3 AS INT)", "serious_error": "CASE l_partkey % 9 WHEN 0 THEN true WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE false END",
    "task": "CASE l_orderkey % 5 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'not_applicable' WHEN 2 THEN 'unassessed' ELSE 'completed' END",
})


@query(
    f"""
WITH r AS ({_REVIEWS.sql()}), g AS (
  SELECT criterion_id, count(*) FILTER (WHERE e) AS quality_eligible, count(*) FILTER (WHERE e AND a) AS quality_assessed, round(sum(rating) FILTER (WHERE e AND a) / nullif(count(*) FILTER (WHERE e AND a), 0), 6) AS mean_rating,
    count(*) FILTER (WHERE sf) AS safety_eligible, count(*) FILTER (WHERE sf AND serious_error IS NOT NULL) AS safety_assessed, count(*) FILTER (WHERE serious_error) AS serious_errors, count(*) FILTER (WHERE opportunity = 'occurred') AS opportunity_occurred,
    count(*) FILTER (WHERE required) AS task_required, count(*) FILTER (WHERE required AND task = 'completed') AS task_completed, count(*) FILTER (WHERE required AND task = 'incomplete') AS task_incomplete, count(*) FILTER (WHERE required AND task = 'not_applicable') AS na
  FROM (SELECT *, opportunity NOT IN ('not_reached', 'not_applicable') AS e, quality_status = 'assessed' AS a, opportunity <> 'not_applicable' OR serious_error IS NOT NULL AS sf FROM r) GROUP BY GROUPING SETS ((criterion_id), ())
) SELECT coalesce(criterion_id, 'ALL') AS criterion_id, quality_eligible, quality_assessed, mean_rating, safety_eligible, safety_assessed, serious_errors, opportunity_occurred, task_required, task_completed, task_incomplete,
  round(task_completed / nullif(task_required - na, 0), 6) AS completion_lower_bound FROM g
"""
)
def review_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four dimensions with a denominator each, per criterion and overall."""
    d = ev.review_dimensions(_REVIEWS.rows(spark, sf_dir)).withColumn("criterion_id", F.coalesce("criterion_id", F.lit("ALL")))
    return d.select("criterion_id", "quality_eligible", "quality_assessed", "mean_rating", "safety_eligible", "safety_assessed", "serious_errors", "opportunity_occurred", "task_required", "task_completed", "task_incomplete", "completion_lower_bound")


_RUNS = Derived("customer", {"config": "'c1'", "policy": "CASE WHEN c_custkey = 3 THEN NULL ELSE 'p' END", "model": "c_mktsegment", "classifier": "CAST(c_nationkey % 1 AS STRING)"})


@query(
    f"""
WITH r AS ({_RUNS.sql()}), v AS (SELECT count(DISTINCT coalesce(config, '(none)')) AS a, count(DISTINCT coalesce(policy, '(none)')) AS b, count(DISTINCT model) AS c, count(DISTINCT classifier) AS d FROM r)
SELECT * FROM (SELECT 'UNLIKE_CONFIG' AS rule, a AS "values" FROM v UNION ALL SELECT 'UNLIKE_POLICY', b FROM v UNION ALL SELECT 'UNLIKE_MODEL', c FROM v UNION ALL SELECT 'UNLIKE_CLASSIFIER', d FROM v) WHERE "values" > 1
"""
)
def comparison_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.comparison_violations(_RUNS.rows(spark, sf_dir), ["config", "policy", "model", "classifier"])


# ---- metrics of predictions

_GOLD = Derived("customer", {"query_id": "c_custkey", "primary": "concat('s', CAST(c_custkey % 6 AS STRING))", "second": "concat('s', CAST((c_custkey + 2) % 6 AS STRING))", "high_risk": "c_nationkey % 3 = 0", "fresh": "c_nationkey % 4 = 0"})
_RANKED = Derived("customer", {"query_id": "c_custkey", "a": "concat('s', CAST((c_custkey + c_nationkey) % 6 AS STRING))", "b": "concat('s', CAST((c_custkey + c_nationkey + 3) % 7 AS STRING))"}, "c_custkey % 13 <> 0")


@query(
    f"""
WITH g AS ({_GOLD.sql()}), p AS ({_RANKED.sql()}), j AS (SELECT g.*, p.a, p.b, p.a IS NULL AS gone FROM g LEFT JOIN p USING (query_id)),
k AS (SELECT *, coalesce(a = "primary", false) AS p1, coalesce(a IN ("primary", second) OR b IN ("primary", second), false) AS a3, coalesce(CAST(substr(a, 2) AS INT) % 3 IN (CAST(substr("primary", 2) AS INT) % 3, CAST(substr(second, 2) AS INT) % 3), false) AS t, coalesce(a NOT IN ("primary", second), true) AS w, coalesce(a = 's5', false) AS sec FROM j)
SELECT count(*) AS queries, round(avg(CAST(p1 AS INT)), 6) AS primary_at_1, round(avg(CAST(a3 AS INT)), 6) AS acceptable_at_3, round(avg(CAST(t AS INT)), 6) AS type_accuracy, round(count(*) FILTER (WHERE fresh AND a3) / nullif(count(*) FILTER (WHERE fresh), 0), 6) AS freshness_accuracy,
  round(avg(CAST(w AS INT)), 6) AS wrong_authority_rate, round(avg(CAST(sec AS INT)), 6) AS secondary_as_gold_rate, round(count(*) FILTER (WHERE high_risk AND NOT a3) / nullif(count(*) FILTER (WHERE high_risk), 0), 6) AS critical_miss_rate FROM k
"""
)
def routing_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked sources against gold: first place, first three, source type, freshness, authority, secondary sources, critical misses."""
    g = _GOLD.rows(spark, sf_dir).withColumns({"acceptable": F.array("primary", "second"), "forbidden": F.array(F.lit("s5")), "intent": F.lit("x")})
    p = _RANKED.rows(spark, sf_dir).select("query_id", F.lit("x").alias("intent"), F.array("a", "b").alias("ranked"))
    kinds = spark.createDataFrame([(f"s{k}", f"t{k % 3}") for k in range(7)], "source string, kind string")
    return ev.routing_metrics(g, p, kinds).select("queries", "primary_at_1", "acceptable_at_3", "type_accuracy", "freshness_accuracy", "wrong_authority_rate", "secondary_as_gold_rate", "critical_miss_rate")


_PROP = {"item": "o_custkey", "subject": "concat('s', CAST(o_orderkey % 2 AS STRING))", "predicate": "o_orderstatus", "object": "o_orderpriority"}
_TRUE = Derived("orders", {**_PROP, "polarity": "CASE WHEN o_orderkey % 5 = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END", "population": "CASE o_orderkey % 7 WHEN 0 THEN 'adult' END", "condition": "CASE o_orderkey % 4 WHEN 0 THEN 'egfr<30' ELSE '' END", "critical": "o_orderkey % 6 = 0"}, "o_orderkey % 3 <> 0")
_SAID = Derived("orders", {**_PROP, "polarity": "CASE WHEN o_orderkey % 9 = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END", "population": "CASE o_orderkey % 14 WHEN 0 THEN 'adult' END", "condition": "CASE o_orderkey % 8 WHEN 0 THEN 'egfr<30' ELSE '' END"}, "o_orderkey % 4 <> 1")
_SIGN = ["subject", "predicate", "object", "polarity", "population", "condition"]
_eq = lambda names: " AND ".join(f"g.{n} IS NOT DISTINCT FROM p.{n}" for n in ["item", *names])


@query(
    f"""
WITH g0 AS ({_TRUE.sql()}), p0 AS ({_SAID.sql()}), g AS (SELECT item, {", ".join(_SIGN)}, count(*) AS g FROM g0 GROUP BY ALL), p AS (SELECT item, {", ".join(_SIGN)}, count(*) AS p FROM p0 GROUP BY ALL),
j AS (SELECT coalesce(g.g, 0) AS g, coalesce(p.p, 0) AS p FROM g FULL JOIN p ON {_eq(_SIGN)}), s AS (SELECT CAST(sum(least(g, p)) AS BIGINT) AS tp, CAST(sum(p - least(g, p)) AS BIGINT) AS fp, CAST(sum(g - least(g, p)) AS BIGINT) AS fn FROM j)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s
"""
)
def proposition_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multisets of propositions per customer, gold against predicted."""
    return ev.bag_counts(_TRUE.rows(spark, sf_dir), _SAID.rows(spark, sf_dir), "item", _SIGN)


def _part_sql(part: str) -> str:
    rest = [n for n in _SIGN if n != part]
    return f"SELECT '{part}' AS part, count(*) FILTER (WHERE m) AS matched, count(*) FILTER (WHERE m AND r) AS correct FROM (SELECT EXISTS (SELECT 1 FROM p WHERE {_eq(rest)}) AS m, EXISTS (SELECT 1 FROM p WHERE {_eq(_SIGN)}) AS r FROM g)"


@query(f"WITH g AS ({_TRUE.sql()}), p AS ({_SAID.sql()}), x AS ({' UNION ALL '.join(_part_sql(c) for c in ('polarity', 'population', 'condition'))}) SELECT part, matched, correct, round(correct / nullif(matched, 0), 6) AS accuracy FROM x")
def binding_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarity, population and condition, each judged where everything else matches."""
    return ev.binding_accuracies(_TRUE.rows(spark, sf_dir), _SAID.rows(spark, sf_dir), "item", _SIGN, ["polarity", "population", "condition"])


@query(
    f"""
WITH g AS (SELECT *, item % 10 = 0 AS should_abstain FROM ({_TRUE.sql()})), p AS ({_SAID.sql()}), i AS (SELECT DISTINCT item, item % 10 = 0 AS should, item % 20 = 0 AS abstained FROM g),
e AS (SELECT item, 'SILENT' AS error FROM i WHERE should AND NOT abstained AND item NOT IN (SELECT item FROM p) UNION SELECT item, 'PARTIAL_TRUTH' FROM i WHERE should AND item IN (SELECT item FROM p)
  UNION SELECT g.item, 'POLARITY_INVERSION' FROM g JOIN p ON {_eq(["subject", "predicate", "object", "population", "condition"])} WHERE g.critical AND g.polarity = 'NEGATIVE' AND p.polarity = 'POSITIVE'
  UNION SELECT g.item, 'CONDITION_STRIPPED' FROM g JOIN p ON {_eq(["subject", "predicate", "object", "population"])} WHERE g.critical AND g.polarity = 'POSITIVE' AND g.condition <> '' AND p.polarity = 'POSITIVE' AND p.condition = ''
  UNION SELECT g.item, 'ENDPOINT_ESCALATION' FROM g JOIN p ON g.item = p.item WHERE g.critical AND g.polarity = 'NEGATIVE' AND g.predicate = 'F' AND p.polarity = 'POSITIVE' AND p.predicate = 'O')
SELECT item, error FROM e
"""
)
def safety_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence, partial truth, escalated endpoints, inverted polarity and stripped conditions of predicted propositions."""
    gold = _TRUE.rows(spark, sf_dir)
    items = gold.select("item").distinct().select("item", (F.col("item") % 10 == 0).alias("should_abstain"), (F.col("item") % 20 == 0).alias("abstained"))
    return ev.safety_errors(items, gold, _SAID.rows(spark, sf_dir), endpoint=("F", "O"))


@query("SELECT tag, count(*) AS n, count(*) FILTER (WHERE good) AS \"right\", round(count(*) FILTER (WHERE good) / count(*), 6) AS accuracy FROM (SELECT unnest([o_orderpriority, o_orderstatus]) AS tag, o_totalprice > 200000 AS good FROM orders) GROUP BY 1")
def accuracy_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.by_tag(table(spark, sf_dir, "orders").withColumn("tags", F.array("o_orderpriority", "o_orderstatus")), "tags", F.col("o_totalprice") > 200000)


@query(
    """
WITH t AS (SELECT l_shipdate IS NOT NULL AND l_quantity % 5 <> 0 AS ok, l_discount < 0.05 AS r, l_linenumber = 1 AS risky FROM lineitem)
SELECT count(*) AS n, round(count(*) FILTER (WHERE ok) / nullif(count(*), 0), 6) AS availability, round(count(*) FILTER (WHERE ok AND r) / nullif(count(*) FILTER (WHERE ok), 0), 6) AS right_if_available, round(count(*) FILTER (WHERE ok AND r) / nullif(count(*), 0), 6) AS right_overall,
  count(*) FILTER (WHERE ok AND risky) AS high_risk_available, round(count(*) FILTER (WHERE ok AND risky AND NOT r) / nullif(count(*) FILTER (WHERE ok AND risky), 0), 6) AS critical_miss_rate FROM t
"""
)
def live_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability apart from success, and critical misses among what was available."""
    l = table(spark, sf_dir, "lineitem")
    return ev.availability(l, F.col("l_shipdate").isNotNull() & (F.col("l_quantity") % 5 != 0), F.col("l_discount") < 0.05, F.col("l_linenumber") == 1)


@query("SELECT CAST(k AS BIGINT) AS k, side FROM (SELECT DISTINCT c_custkey AS k, 'missing' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 <> 0) AND o_custkey % 50 = 0)")
def case_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders, and orders' customers that the set leaves out."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    missing = ev.set_differences(a, b, "k").where("side = 'missing'")
    extra = ev.set_differences(a.where("k % 50 <> 0"), b, "k").where("side = 'extra'")
    return missing.union(extra)


@query(
    """
WITH e AS (SELECT CASE WHEN event_type = 'view' THEN 'event' ELSE 'transition' END AS kind, value > 10 AS matched, value > 2 AS reached FROM events)
SELECT count(*) FILTER (WHERE kind = 'transition') AS transitions, count(*) FILTER (WHERE kind = 'transition' AND NOT matched) AS unmatched, round(count(*) FILTER (WHERE kind = 'transition' AND NOT matched) / nullif(count(*) FILTER (WHERE kind = 'transition'), 0), 6) AS unmatched_rate,
  count(*) FILTER (WHERE kind = 'event') AS events, count(*) FILTER (WHERE kind = 'event' AND NOT reached) AS unreached FROM e
"""
)
def harness_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "event").otherwise("transition").alias("kind"), (F.col("value") > 10).alias("matched"), (F.col("value") > 2).alias("reached"))
    return ev.harness_quality(e)


@query(
    """
WITH a AS (SELECT conv_id + 1 AS pair_id, turn, role, text AS content FROM conversations), b AS (SELECT conv_id AS pair_id, turn, role, CASE WHEN turn % 2 = 0 THEN text ELSE 'other' END AS content FROM conversations)
SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.turn, b.turn)) FILTER (WHERE a.role IS DISTINCT FROM b.role OR a.content IS DISTINCT FROM b.content) AS first_difference FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.turn = b.turn GROUP BY 1
"""
)
def prefix_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn at which a conversation and the one before it differ."""
    c = table(spark, sf_dir, "conversations").withColumn("content", F.col("text"))
    b = c.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when(F.col("turn") % 2 == 0, F.col("content")).otherwise("other").alias("content"))
    return ev.prefix_divergence(c.withColumn("pair_id", F.col("conv_id") + 1), b)


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS user_turn FROM conversations")
def user_turn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.turn_groups(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", F.col("user_turn").cast("long").alias("user_turn"))


# ---- reviewers

_SIDES = {"left": ("s_suppkey % 7 = 0", "s_nationkey % 3"), "right": ("s_suppkey % 5 = 0", "s_nationkey % 4")}
_side = lambda s: Derived("supplier", {"item": "s_suppkey", "dose": f"CASE WHEN {_SIDES[s][0]} THEN NULL ELSE CAST({_SIDES[s][1]} AS STRING) END", "route": f"CAST({_SIDES[s][1]} AS STRING)"}, "s_suppkey % 11 <> 3" if s == "left" else "s_suppkey % 11 <> 4")
_L, _R = _side("left"), _side("right")


@query(
    f"""
WITH a AS ({_L.sql()}), b AS ({_R.sql()}), l AS (SELECT item, unnest([{{'f': 'dose', 'v': dose}}, {{'f': 'route', 'v': route}}]) AS x FROM a), r AS (SELECT item, unnest([{{'f': 'dose', 'v': dose}}, {{'f': 'route', 'v': route}}]) AS x FROM b),
j AS (SELECT coalesce(l.x.f, r.x.f) AS field, l.x.v AS a, r.x.v AS b FROM l FULL JOIN r ON l.item = r.item AND l.x.f = r.x.f)
SELECT field, count(*) AS items, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS decided, count(*) FILTER (WHERE a = b) AS equal, round(count(*) FILTER (WHERE a = b) / nullif(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), 0), 6) AS agreement FROM j GROUP BY 1
"""
)
def reviewer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reviewer_fields(_L.rows(spark, sf_dir), _R.rows(spark, sf_dir), "item", ["dose", "route"])


_QUESTIONS = Derived("part", {"case_id": "p_partkey", "category": "p_type", "a": "concat('s', CAST(p_partkey % 3 AS STRING))", "b": "concat('s', CAST(p_size % 4 AS STRING))", "c": "concat('s', CAST(p_size % 3 AS STRING))"})


@query(
    f"""
WITH q AS ({_QUESTIONS.sql()}), s AS (SELECT category, list_distinct([a, b]) AS e, list_distinct([c, b]) AS f FROM q), d AS (SELECT category, len(list_filter(e, lambda x: NOT list_contains(f, x))) AS m, len(list_filter(f, lambda x: NOT list_contains(e, x))) AS w FROM s)
SELECT category, count(*) AS cases, count(*) FILTER (WHERE m = 0 AND w = 0) AS exact, CAST(sum(m) AS BIGINT) AS missed, CAST(sum(w) AS BIGINT) AS wrong, round(count(*) FILTER (WHERE m = 0 AND w = 0) / count(*), 6) AS rate FROM d GROUP BY 1
"""
)
def slot_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _QUESTIONS.rows(spark, sf_dir).select("case_id", "category", F.array_distinct(F.array("a", "b")).alias("expected"), F.array_distinct(F.array("c", "b")).alias("found"))
    return review.slot_scores(q)


@query("SELECT p_partkey, CAST(0 AS INTEGER) AS start, substr(p_name, 1, 3) AS value FROM part WHERE p_partkey % 3 = 1 AND substr(p_name, 1, 4) <> substr(p_name, 1, 3)")
def span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with inclusive ends that don't say what the text holds there."""
    p = table(spark, sf_dir, "part")
    end = F.when(F.col("p_partkey") % 3 == 1, 3).otherwise(2)
    spans = p.select("p_partkey", F.lit(0).alias("start"), end.alias("end"), F.substring("p_name", 1, 3).alias("value"))
    return review.span_alignment(spans, p.select("p_partkey", F.col("p_name").alias("text")), "p_partkey").select("p_partkey", "start", "value")


_CHANGES = Derived("nation", {
    "relation_id": "n_nationkey", "relation": "CASE n_nationkey % 2 WHEN 0 THEN 'invariant' ELSE 'directional' END", "before": "'{\"dose\": 1, \"note\": [1, 2], \"who\": {\"age\": 5}}'",
    "after": "CASE n_nationkey % 5 WHEN 0 THEN '{\"dose\": 1, \"note\": [1, 2], \"who\": {\"age\": 5}}' WHEN 1 THEN '{\"dose\": 2, \"note\": [1, 2], \"who\": {\"age\": 5}}' WHEN 2 THEN '{\"dose\": 1, \"note\": [1], \"who\": {\"age\": 5}}' WHEN 3 THEN '{\"dose\": 1, \"note\": [1, 3], \"who\": {\"age\": 6}}' END",
})


@query(
    """
SELECT n_nationkey AS relation_id, CASE n_nationkey % 5 WHEN 0 THEN 'DECLARED_BUT_UNCHANGED' WHEN 1 THEN 'HOLDS' WHEN 2 THEN 'UNDECLARED_CHANGE' WHEN 3 THEN 'FACT_CHANGED' ELSE 'INSUFFICIENT' END AS status,
  CASE n_nationkey % 5 WHEN 2 THEN '/note' WHEN 3 THEN '/note/1,/who/age' ELSE '' END AS undeclared FROM nation
"""
)
def declared_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a record against those declared, with protected facts."""
    r = _CHANGES.rows(spark, sf_dir).withColumns({"changed_fields": F.array(F.lit("/dose")), "protected_facts": F.array(F.lit("/who"))})
    return review.relation_audit(r).select("relation_id", "status", F.coalesce(F.array_join("undeclared", ","), F.lit("")).alias("undeclared"))


@query(
    """
WITH t(name, least, required) AS (VALUES ('orders', 10.0, true), ('customers', 1e9, true), ('nothing', 1.0, true), ('optional', 1.0, false)), m AS (SELECT 'orders' AS name, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'customers', count(*) FROM customer)
SELECT name, value, CAST(least AS DOUBLE) AS least, CASE WHEN value IS NULL THEN CASE WHEN required THEN 'FAIL' ELSE 'SKIP' END WHEN value >= least THEN 'PASS' ELSE 'FAIL' END AS status FROM t LEFT JOIN m USING (name)
"""
)
def metric_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda n, t: table(spark, sf_dir, t).agg(F.lit(n).alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    t = spark.createDataFrame([("orders", 10.0, True), ("customers", 1e9, True), ("nothing", 1.0, True), ("optional", 1.0, False)], "name string, least double, required boolean")
    return gov.gates(count("orders", "orders").union(count("customers", "customer")), t)
