"""Contracts as tables of violations: policies, graphs, families, releases, pinned artefacts.

Defined cases: null ids are named by the rule that asks for them and meet nothing in joins; rows that repeat break the rules on
repeats and no others; empty tables break no rule, but a release of nothing fails; texts are hashed whole; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators.core import both_ways

#: What a truth event and its provenance must have.
EVENT_CHECKS = ("subject_id", "predicate", "object_id", "effective_at")
PROVENANCE = ("source_id", "passage_id", "locator", "source_version", "retrieved_at")


def violations(df: DataFrame, entity: str, rules: dict[str, Column]) -> DataFrame:
    """(entity, rule) for every rule whose condition holds; one pass over df."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]))
    return df.select(F.col(entity).cast("string").alias("entity"), F.explode(found).alias("rule"))


def repeated(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    name = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name.alias("entity"), F.lit(rule).alias("rule"))


def missing(df: DataFrame, key: str, other: DataFrame, other_key: str, rule: str) -> DataFrame:
    return df.join(other.select(F.col(other_key).alias(key)), key, "left_anti").select(F.col(key).cast("string").alias("entity"), F.lit(rule).alias("rule")).distinct()


def union(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, found)


def truth_event_reason(partition: str) -> Column:
    """The first reason to reject a truth event (flat columns; proposition and provenance tell whether it has any), or null.

    External and synthetic facts never mix.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    checks = [(F.col("proposition").isNull(), "MISSING_PROPOSITION")] + [(blank(c), f"MISSING_{c.upper()}") for c in EVENT_CHECKS]
    checks += [(F.try_to_timestamp("effective_at", F.lit("yyyy-MM-dd")).isNull(), "INVALID_EFFECTIVE_AT")]
    checks += [(F.col("provenance").isNull(), "MISSING_PROVENANCE")]
    checks += [(blank(c), f"MISSING_PROVENANCE_{c.upper()}") for c in PROVENANCE]
    checks += [(~F.col("s3_relation").eqNullSafe("DIRECT_SUPPORT"), "S3_RELATION_NOT_DIRECT_SUPPORT"), (~F.coalesce(F.col("review_status").isin("verified", "gold_approved"), F.lit(False)), "SOURCE_NOT_VERIFIED")]
    synthetic = F.coalesce("source_scope", F.lit("external")) == "synthetic_controlled"
    checks += [(synthetic, "SYNTHETIC_PARTITION_VIOLATION")] if partition != "benchmark_synthetic" else [(~synthetic, "EXTERNAL_PARTITION_VIOLATION")]
    out = F.lit(None).cast("string")
    for bad, reason in reversed(checks):
        out = F.when(bad, reason).otherwise(out)
    return out


def core_fingerprint(fields: list[str]) -> Column:
    """Digest of the fields that make a case what it is; their order doesn't matter."""
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def cross_split_duplicates(cases: DataFrame, fingerprint: Column) -> DataFrame:
    g = cases.groupBy(fingerprint.alias("entity")).agg(F.countDistinct("split").alias("n"))
    return g.where("n > 1").select("entity", F.lit("CORE_IN_SEVERAL_SPLITS").alias("rule"))


def graph_merge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, conflicts) of several sources: set-valued contexts united, one type for an id.

    nodes: node_id, node_type, label, contexts array, sources array; edges: subject_id, predicate, object_id, contexts, sources.
    """
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    n = nodes.groupBy("node_id").agg(F.min("node_type").alias("node_type"), F.countDistinct("node_type").alias("types"), F.min("label").alias("label"), united("contexts"), united("sources"))
    e = edges.groupBy("subject_id", "predicate", "object_id").agg(united("contexts"), united("sources"))
    e = e.withColumn("edge_id", X.edge_id(F.lit("edge"), F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    ends = e.select(F.explode(F.array("subject_id", "object_id")).alias("node_id"))
    bad = union(violations(n, "node_id", {"TYPE_CONFLICT": F.col("types") > 1}), missing(ends, "node_id", n, "node_id", "DANGLING_END"))
    return n.drop("types"), e, bad


def family_violations(families: DataFrame, cases: DataFrame, held: str = "heldout") -> DataFrame:
    """families: family_id; cases: family_id, case_id, variant_type, split, case_json."""
    own = violations(cases, "case_id", {"FILE_MISSING": F.col("case_json").isNull(), "SPLIT_MISMATCH": (F.col("split") == held) != (F.col("variant_type") == held)})
    heldout = cases.where(F.col("split") == held).select("family_id").distinct()
    return union(own, repeated(cases, ["case_id"], "REPEATED_CASE"), missing(families, "family_id", cases, "family_id", "NO_CASES"), missing(families, "family_id", heldout, "family_id", "NO_HELDOUT"))


def source_violations(sources: DataFrame, claims: DataFrame, passages: DataFrame, hosts: list[str]) -> DataFrame:
    """sources: source_id, url; claims: claim_id, source_id, passage_id; passages: passage_id, locator."""
    host = F.lower(F.regexp_extract("url", "://([^/?#:]*)", 1))
    known = F.lit(False)
    for h in hosts:
        known = known | (host == h) | F.endswith(host, F.lit("." + h))
    return union(
        violations(sources, "source_id", {"HOST_NOT_ALLOWED": ~known}), missing(claims, "source_id", sources, "source_id", "UNKNOWN_SOURCE"),
        missing(claims, "passage_id", passages, "passage_id", "UNKNOWN_PASSAGE"), violations(passages, "passage_id", {"NO_LOCATOR": F.coalesce(F.trim("locator"), F.lit("")) == ""}), repeated(sources, ["source_id"], "REPEATED_SOURCE"),
    )


def release(families: DataFrame, status: str = "status", approved: str = "gold_approved") -> DataFrame:
    """One row: PASS if there are families and all are approved."""
    ok = (F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(F.col(status).eqNullSafe(approved)), F.lit(False))
    return families.agg(F.count(F.lit(1)).alias("families"), F.count_if(F.col(status).eqNullSafe(approved)).alias("approved"), F.when(ok, "PASS").otherwise("FAIL").alias("gate"))


def gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics: name, value; thresholds: name, least, required.  A missing required metric fails, an optional one is skipped."""
    j = thresholds.join(metrics, "name", "left")
    status = F.when(F.col("value").isNull(), F.when(F.col("required"), "FAIL").otherwise("SKIP")).when(F.col("value") >= F.col("least"), "PASS").otherwise("FAIL")
    return j.select("name", "value", "least", status.alias("status"))


def insert_relations(known: DataFrame, new: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """known with new relations (subject, predicate, object) and their inverses; ingesting twice changes nothing."""
    wide = both_ways(new.select("subject", "predicate", "object"), "subject", "object", "predicate", inverse)
    keys = ["subject", "predicate", "object"]
    return known.select(keys).union(wide.select(keys).join(known, keys, "left_anti").distinct())


def merge_vaults(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(name, action, target) of notes (name, content): copy, identical, or rename on conflict."""
    a = ours.select("name", F.sha2("content", 256).alias("a"))
    b = theirs.select("name", F.sha2("content", 256).alias("b"))
    action = F.when(F.col("a").isNull(), "copy").when(F.col("a") == F.col("b"), "identical").otherwise("conflict")
    return b.join(a, "name", "left").select("name", action.alias("action"), F.when(action == "conflict", F.concat("name", F.lit("-imported"))).otherwise(F.col("name")).alias("target"))


def watch_events(events: DataFrame, watched: DataFrame, since: Column) -> DataFrame:
    """Events (entity, event_date as text) of watched entities from a date on; partial dates are their first day, those like `Mar 05, 2024` are read too, unreadable ones stay."""
    d = F.col("event_date")
    day = F.coalesce(*[F.try_to_timestamp(d, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM", "yyyy", "MMM d, yyyy")])
    return events.join(watched.select("entity").distinct(), "entity", "left_semi").where(day.isNull() | (day >= since)).orderBy(F.desc("event_date"), "entity")


def inside_folder(base: Column, relative: Column) -> Column:
    """Whether a relative path stays below its folder: no absolute path, no climbing out."""
    parts = F.filter(F.split(relative, "/"), lambda x: (x != "") & (x != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda s, x: F.struct(F.when(x == "..", s["d"] - 1).otherwise(s["d"] + 1).alias("d"), (s["ok"] & ((x != "..") | (s["d"] > 0))).alias("ok")))
    return base.isNotNull() & ~F.startswith(relative, F.lit("/")) & depth["ok"]
