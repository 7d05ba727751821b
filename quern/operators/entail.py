"""Verdicts of structured propositions: points in intervals, interval subsets, closed and open domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(operator: Column, value: Column, low: Column, high: Column) -> Column:
    """struct(lo, lo_closed, hi, hi_closed) of EQ, LT, LTE, GT, GTE and RANGE conditions; without one, everything."""
    inf = F.lit(float("inf"))
    lo = F.when(operator.isin("EQ", "GT", "GTE"), value).when(operator == "RANGE", low).otherwise(-inf)
    hi = F.when(operator.isin("EQ", "LT", "LTE"), value).when(operator == "RANGE", high).otherwise(inf)
    return F.struct(lo.alias("lo"), F.coalesce(operator.isin("EQ", "GTE", "RANGE"), F.lit(False)).alias("lo_closed"), hi.alias("hi"), F.coalesce(operator.isin("EQ", "LTE", "RANGE"), F.lit(False)).alias("hi_closed"))


def holds(b: Column, value: Column) -> Column:
    return ((value > b["lo"]) | ((value == b["lo"]) & b["lo_closed"])) & ((value < b["hi"]) | ((value == b["hi"]) & b["hi_closed"]))


def subset(inner: Column, outer: Column) -> Column:
    low = (inner["lo"] > outer["lo"]) | ((inner["lo"] == outer["lo"]) & (~inner["lo_closed"] | outer["lo_closed"]))
    high = (inner["hi"] < outer["hi"]) | ((inner["hi"] == outer["hi"]) & (~inner["hi_closed"] | outer["hi_closed"]))
    return low & high


def covers(evidence_population: Column, candidate_population: Column) -> Column:
    """Unrestricted evidence covers all; a universal claim needs unrestricted evidence."""
    return evidence_population.isNull() | F.coalesce(evidence_population == candidate_population, F.lit(False))


def point_verdict(applies_same: Column, applies_opposite: Column, outside_exact: Column, denied: Column, competing: Column) -> Column:
    """Of a claim at one value, by what any evidence does: all five are aggregated booleans."""
    return F.when(applies_same, "SUPPORTED").when(applies_opposite, "CONTRADICTED").when(outside_exact, "CONTRADICTED").when(denied, "SUPPORTED").when(competing, "CONTRADICTED").otherwise("UNSUPPORTED")


def rule_verdict(within: Column, exceeds_exact: Column, opposite_overlaps: Column) -> Column:
    return F.when(within, "SUPPORTED").when(exceeds_exact, "CONTRADICTED").when(opposite_overlaps, "CONTRADICTED").otherwise("UNSUPPORTED")


def relation(supported: Column, contradicted: Column, total: Column) -> Column:
    """Of a text by its propositions' verdicts: all supported, some, none but contradicted ones, or none at all."""
    direct = F.when(total == 0, "DOES_NOT_SUPPORT").when(supported == total, "DIRECT_SUPPORT").when(supported > 0, "PARTIAL_SUPPORT")
    return direct.when(contradicted > 0, "CONTRADICTS").otherwise("DOES_NOT_SUPPORT")


#: Predicates of scoped actions, and those whose absence says nothing.
ACTIONS = ["INITIATION_NOT_RECOMMENDED", "CONTRAINDICATED", "REASSESS_BENEFIT_RISK", "DISCONTINUE"]
ABSENCES = ["PROVIDES_ABSOLUTE_PROHIBITION", "CONFIRMS_DIAGNOSIS", "DIAGNOSTIC_INFERENCE", "DEMONSTRATES_EFFICACY", "ACHIEVES_ENDPOINT", "PROVIDES_MANAGEMENT_RULE", "PROVES_SUPERIORITY", "RISK_RANKING"]
EXCLUSIVE_CLASSES = ["benign", "malignant"]
_CONDITION = ["operator", "value", "low", "high"]


def _propositions(df: DataFrame, name: str, extra: list[str]) -> DataFrame:
    b = bounds(F.upper("operator"), F.col("value").cast("double"), F.col("low").cast("double"), F.col("high").cast("double"))
    cols = ["subject", "predicate", "object", "polarity", "population"]
    return df.select("case_id", *extra, F.struct(*cols, b.alias("b"), F.col("operator").isNotNull().alias("conditioned"), *(["semantics"] if name == "e" else [])).alias(name))


def verdicts(claims: DataFrame, evidence: DataFrame, actions: list[str] | None = None) -> DataFrame:
    """(case_id, claim_id, verdict) of every claim by the evidence of its case.

    claims: case_id, claim_id, subject, predicate, object, polarity, population, operator, value, low, high; evidence the
    same without claim_id, and semantics (EXACT_DOMAIN, or anything else for an open domain).  A null operator is no
    condition, a null population no restriction.  Claims meet evidence by case and identity (three equi-joins: subject,
    predicate and object; subject or object alone; reversed ends); claims at a point also meet actions of the case that
    hold there.  What the evidence says is aggregated to flags before the ladder.  Claims without evidence are
    unsupported; a null case is one case; rows that repeat count once; an empty table gives an empty result.
    """
    acts = ACTIONS if actions is None else actions
    c = _propositions(claims, "c", ["claim_id"]).distinct()
    e = _propositions(evidence, "e", []).distinct()
    key, P, N = ["case_id", "claim_id"], "POSITIVE", "NEGATIVE"
    same = lambda *names: [F.col(f"c.{n}").eqNullSafe(F.col(f"e.{n}")) for n in names]
    is_action = lambda p: F.coalesce(F.col(f"{p}.predicate").isin(acts), F.lit(False))
    any_of = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    point = F.col("c.conditioned") & (F.col("c.b.lo") == F.col("c.b.hi"))
    at = F.col("c.b.lo")

    ident = c.join(e.withColumnRenamed("case_id", "__case"), [F.col("case_id").eqNullSafe(F.col("__case")), *same("subject", "predicate", "object")], "inner")
    fits = covers(F.col("e.population"), F.col("c.population"))
    alike = F.col("c.polarity").eqNullSafe(F.col("e.polarity"))
    exact = F.col("e.semantics").eqNullSafe("EXACT_DOMAIN")
    holds_at = point & F.coalesce(holds(F.col("e.b"), at), F.lit(False))
    inner, outer = subset(F.col("c.b"), F.col("e.b")), subset(F.col("e.b"), F.col("c.b"))
    flags = ident.groupBy(key).agg(
        any_of(alike).alias("same_any"), any_of(~alike & (F.col("e.polarity") != "UNKNOWN")).alias("other_any"),
        any_of(fits & alike & holds_at).alias("same_at"), any_of(fits & ~alike & holds_at).alias("other_at"),
        any_of(fits & alike & exact & F.col("e.conditioned")).alias("same_exact"), any_of(fits & (F.col("e.polarity") == P) & exact & F.col("e.conditioned")).alias("positive_exact"),
        any_of(fits & alike & inner).alias("within"), any_of(fits & alike & exact).alias("same_closed"), any_of(fits & ~alike & (inner | outer)).alias("other_overlaps"),
    )
    # any action that holds at a positive claim's point: bounds of a case's actions are few and distinct
    asked = c.where(is_action("c") & (F.col("c.polarity") == P) & point)
    rivals = e.where(is_action("e") & (F.col("e.polarity") == P)).select(F.col("case_id").alias("__case"), F.col("e.population").alias("pop"), F.col("e.b").alias("eb")).distinct()
    rival = asked.join(rivals, F.col("case_id").eqNullSafe(F.col("__case"))).where(covers(F.col("pop"), F.col("c.population")) & holds(F.col("eb"), at)).select(*key, F.lit(True).alias("rival")).distinct()
    # the same kind of statement on one end: classes, recommendations, rankings, endpoints
    loose = c.where(F.col("c.predicate").isin("CLASSIFIED_AS", "GUIDELINE_RECOMMENDS", "ASSOCIATION_RANKING", "ACHIEVES_ENDPOINT")).join(e.withColumnRenamed("case_id", "__case"), [F.col("case_id").eqNullSafe(F.col("__case")), *same("predicate")], "inner")
    both_positive = (F.col("c.polarity") == P) & (F.col("e.polarity") == P)
    same_subject, same_object = same("subject")[0], same("object")[0]
    clash = F.col("c.object").isin(EXCLUSIVE_CLASSES) & F.col("e.object").isin(EXCLUSIVE_CLASSES)
    by_end = loose.groupBy(key).agg(
        any_of(both_positive & same_subject & same_object).alias("end_same"), any_of(both_positive & same_subject & clash).alias("class_clash"), any_of(both_positive & same_subject).alias("other_option"),
        any_of(alike & same_object).alias("object_same"), any_of(both_positive & same_object).alias("endpoint_met"),
    )
    limits = e.where((F.col("e.polarity") == N) & (F.col("e.predicate") == "ESTABLISHES_ENDPOINT_ACHIEVEMENT")).select(F.col("case_id").alias("__case")).distinct()
    back = c.where((F.col("c.predicate") == "SUPERSEDES") & (F.col("c.polarity") == P)).join(e.where((F.col("e.predicate") == "SUPERSEDES") & (F.col("e.polarity") == P)).withColumnRenamed("case_id", "__case"), [F.col("case_id").eqNullSafe(F.col("__case")), F.col("c.subject").eqNullSafe(F.col("e.object")), F.col("c.object").eqNullSafe(F.col("e.subject"))])
    back = back.select(*key, F.lit(True).alias("reversed")).distinct()

    j = c
    for part in (flags, rival, by_end, back):
        own = part.withColumnsRenamed({"case_id": "__c", "claim_id": "__i"})
        j = j.join(own, F.col("case_id").eqNullSafe(F.col("__c")) & F.col("claim_id").eqNullSafe(F.col("__i")), "left").drop("__c", "__i")
    j = j.join(limits, F.col("case_id").eqNullSafe(F.col("__case")), "left")
    f = lambda name: F.coalesce(F.col(name), F.lit(False))
    positive, negative = F.col("c.polarity") == P, F.col("c.polarity") == N
    at_point = point_verdict(f("same_at"), f("other_at"), f("same_exact"), negative & f("positive_exact"), positive & f("rival"))
    by_rule = rule_verdict(f("within"), f("same_closed"), f("other_overlaps"))
    supersedes = F.when(f("same_any"), "SUPPORTED").when(f("reversed"), "CONTRADICTED").otherwise("UNSUPPORTED")
    matching = F.when(f("same_any"), "SUPPORTED").when(f("other_any") & positive & F.col("c.predicate").isin(ABSENCES), "UNSUPPORTED").when(f("other_any"), "CONTRADICTED").otherwise("UNSUPPORTED")
    predicate = F.col("c.predicate")
    verdict = (
        F.when(is_action("c"), F.when(point, at_point).otherwise(by_rule))
        .when(predicate == "SUPERSEDES", supersedes)
        .when((predicate == "CLASSIFIED_AS") & positive & f("end_same"), "SUPPORTED").when((predicate == "CLASSIFIED_AS") & positive & f("class_clash"), "CONTRADICTED")
        .when(predicate == "RISK_RANKING", F.when(f("same_any"), "SUPPORTED").otherwise("UNSUPPORTED"))
        .when(predicate == "ASSOCIATION_RANKING", F.when(f("object_same"), "SUPPORTED").otherwise("UNSUPPORTED"))
        .when((predicate == "ACHIEVES_ENDPOINT") & positive & f("endpoint_met"), "SUPPORTED").when((predicate == "ACHIEVES_ENDPOINT") & positive & F.col("__case").isNotNull(), "UNSUPPORTED")
        .when((predicate == "GUIDELINE_RECOMMENDS") & positive & f("end_same"), "SUPPORTED").when((predicate == "GUIDELINE_RECOMMENDS") & positive & f("other_option"), "CONTRADICTED")
        .otherwise(matching)
    )
    return j.select(*key, verdict.alias("verdict"))


def relations(cases: DataFrame, decided: DataFrame) -> DataFrame:
    """(case_id, supported, contradicted, claims, relation) of every case by its claims' verdicts."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    g = decided.groupBy("case_id").agg(n("SUPPORTED").alias("supported"), n("CONTRADICTED").alias("contradicted"), F.count(F.lit(1)).alias("claims"))
    j = cases.select("case_id").distinct().join(g, "case_id", "left").na.fill(0, ["supported", "contradicted", "claims"])
    return j.withColumn("relation", relation(F.col("supported"), F.col("contradicted"), F.col("claims")))
