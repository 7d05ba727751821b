"""Temporal truth ledger: supersession, contested facts, late arrivals, in closed form.

Events carry slot, claim, effective (a date), seq (a total order of arrival) and source.  The state after
all of them is a function of windows over the slot, so nothing is replayed: a row that is older than the
slot's newest date when it arrives is historical at once; rows of one newest date contest each other; a
newer date supersedes.  One shuffle by slot; slots are small, events many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REJECTS = ("MISSING_SUBJECT_ID", "MISSING_PREDICATE", "MISSING_OBJECT_ID", "MISSING_EFFECTIVE_AT", "MISSING_SOURCE_ID")


def reject_reason(checks: list[tuple[Column, str]]) -> Column:
    """The first failing check's reason, or null."""
    out = F.lit(None).cast("string")
    for bad, reason in reversed(checks):
        out = F.when(bad, reason).otherwise(out)
    return out


def actions(events: DataFrame) -> DataFrame:
    """Every event with its action, whether the active truth changed, and its edge (slot, claim, effective)."""
    slot = Window.partitionBy("slot").orderBy("seq")
    before = slot.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("slot", "claim", "effective").orderBy("seq")
    e = events.withColumn("copy", F.row_number().over(same)).withColumn("frontier", F.max("effective").over(before))
    peers = F.count(F.when(F.col("copy") == 1, 1)).over(Window.partitionBy("slot", "effective").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    action = (
        F.when(F.col("copy") > 1, "MERGED_IDEMPOTENT")
        .when(F.col("frontier").isNull(), "INSERTED_ACTIVE")
        .when(F.col("effective") < F.col("frontier"), "INSERTED_HISTORICAL")
        .when(F.col("effective") == F.col("frontier"), "CONTRADICTION_RECORDED")
        .otherwise("SUPERSEDED_PRIOR")
    )
    e = e.withColumn("peers", peers).withColumn("action", action)
    changed = F.when(F.col("action").isin("MERGED_IDEMPOTENT", "INSERTED_HISTORICAL"), False).when(F.col("action") == "CONTRADICTION_RECORDED", F.col("peers") == 1).otherwise(True)
    return e.withColumn("active_truth_changed", changed).drop("copy")


def edges(acted: DataFrame) -> DataFrame:
    """The final edges: one per slot, claim and date, with sources, status and number of conflicts."""
    e = acted.groupBy("slot", "claim", "effective").agg(F.min("seq").alias("seq"), F.min_by("action", "seq").alias("action"), F.countDistinct("source").alias("sources"))
    late = F.col("action") == "INSERTED_HISTORICAL"
    slot = Window.partitionBy("slot")
    date = Window.partitionBy("slot", "effective")
    e = e.withColumn("newest", F.max("effective").over(slot)).withColumn("rivals", F.count(F.lit(1)).over(date)).withColumn("on_time", F.count(F.when(~late, 1)).over(date))
    status = F.when(F.col("effective") < F.col("newest"), "SUPERSEDED").when(F.col("rivals") == 1, "ACTIVE").otherwise("CONTESTED")
    return e.select("slot", "claim", "effective", "seq", "sources", late.alias("late"), status.alias("status"), F.when(late, 0).otherwise(F.col("on_time") - 1).cast("long").alias("conflicts"))


def lifecycle(acted: DataFrame) -> DataFrame:
    """edges() with edge_id, the edge that superseded each (superseded_by) and those that contest it (conflicts_with).

    On-time edges of a slot arrive in the order of their dates, so the first of the next date supersedes all of this one;
    a late edge is superseded at once, by the least id of the dates' newest that had arrived.  On-time edges of one
    date contest each other; these are few.
    """
    e = edges(acted).withColumn("edge_id", F.concat(F.lit("edge:"), F.substring(F.sha2(F.concat_ws("|", "slot", F.coalesce("claim", F.lit("")), F.col("effective").cast("string")), 256), 1, 20)))
    first = acted.groupBy("slot", "claim", "effective").agg(F.min_by("frontier", "seq").alias("frontier"))
    keys = [e[c].eqNullSafe(first[c]) for c in ("slot", "claim", "effective")]
    e = e.join(first, keys).select(e["*"], "frontier")
    on_time = e.where(~F.col("late")).select("slot", "effective", "seq", "edge_id")
    dates = on_time.groupBy("slot", "effective").agg(F.min_by("edge_id", "seq").alias("head"), F.array_sort(F.collect_set("edge_id")).alias("peers"))
    dates = dates.withColumn("next", F.lead("head").over(Window.partitionBy("slot").orderBy("effective")))
    later = e.where("late").select("edge_id", "slot", "frontier", "seq").alias("l").join(on_time.alias("o"), (F.col("l.slot") == F.col("o.slot")) & (F.col("l.frontier") == F.col("o.effective")) & (F.col("o.seq") < F.col("l.seq")))
    later = later.groupBy(F.col("l.edge_id").alias("edge_id")).agg(F.min("o.edge_id").alias("by_late"))
    j = e.join(dates, ["slot", "effective"], "left").join(later, "edge_id", "left")
    none = F.array().cast("array<string>")
    by = F.when(F.col("late"), F.col("by_late")).when(F.col("status") == "SUPERSEDED", F.col("next"))
    peers = F.when(F.col("late"), none).otherwise(F.array_remove(F.coalesce("peers", none), F.col("edge_id")))
    return j.select("edge_id", "slot", "claim", "effective", "seq", "sources", "late", "status", by.alias("superseded_by"), peers.alias("conflicts_with"))


#: What can be wrong with a state.
INVARIANTS = [
    "DUPLICATE_CLAIM_DATE", "MULTI_DATE_CURRENT_FRONTIER", "MULTI_ACTIVE_FRONTIER", "ACTIVE_CONTESTED_COEXIST", "SINGLETON_CONTESTED", "INCOMPLETE_CONTESTED_CLIQUE", "DANGLING_CONFLICT_REF", "ASYMMETRIC_CONFLICT_REF",
    "CROSS_SLOT_OR_DATE_CONFLICT", "MISSING_SUPERSEDED_BY", "CROSS_SLOT_SUPERSESSION", "BACKWARD_TIME_SUPERSESSION", "STALE_ACTIVE_PRESENT",
]


def invariants(state: DataFrame) -> DataFrame:
    """(rule, violations) of all thirteen rules over a state of lifecycle()'s columns."""
    status, current = F.col("status"), F.col("status").isin("ACTIVE", "CONTESTED")
    n = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count(F.lit(1)).alias("violations"))
    twice = state.groupBy("slot", "claim", "effective").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slots = state.groupBy("slot").agg(
        F.count_if(status == "ACTIVE").alias("act"), F.count_if(status == "CONTESTED").alias("con"), F.countDistinct(F.when(current, F.col("effective"))).alias("dates"), F.max("effective").alias("newest"),
        F.count_if((status == "ACTIVE") & (F.col("superseded_by").isNotNull())).alias("stale"), F.sort_array(F.collect_set(F.when(status == "CONTESTED", F.col("edge_id")))).alias("contested"),
    )
    clique = state.where(status == "CONTESTED").join(slots.select("slot", "contested"), "slot").where(~F.array_remove("contested", F.col("edge_id")).eqNullSafe(F.array_sort(F.array_intersect("conflicts_with", "contested"))))
    refs = state.select("edge_id", "slot", "effective", F.explode("conflicts_with").alias("other"))
    other = state.select(F.col("edge_id").alias("other"), F.col("slot").alias("o_slot"), F.col("effective").alias("o_effective"), F.col("conflicts_with").alias("o_refs"))
    met = refs.join(other, "other", "left")
    by = state.where(status == "SUPERSEDED").join(other.withColumnRenamed("other", "superseded_by"), "superseded_by", "left")
    known = F.col("o_slot").isNotNull()
    parts = [
        n("DUPLICATE_CLAIM_DATE", twice), n("MULTI_DATE_CURRENT_FRONTIER", slots.where("dates > 1")), n("MULTI_ACTIVE_FRONTIER", slots.where("act > 1")), n("ACTIVE_CONTESTED_COEXIST", slots.where("act > 0 and con > 0")), n("SINGLETON_CONTESTED", slots.where("con = 1")),
        n("INCOMPLETE_CONTESTED_CLIQUE", clique), n("DANGLING_CONFLICT_REF", met.where(~known)), n("ASYMMETRIC_CONFLICT_REF", met.where(known & ~F.array_contains("o_refs", F.col("edge_id")))),
        n("CROSS_SLOT_OR_DATE_CONFLICT", met.where(known & ((F.col("slot") != F.col("o_slot")) | (F.col("effective") != F.col("o_effective"))))), n("MISSING_SUPERSEDED_BY", by.where(~known)), n("CROSS_SLOT_SUPERSESSION", by.where(known & (F.col("slot") != F.col("o_slot")))),
        n("BACKWARD_TIME_SUPERSESSION", by.where(known & (F.col("o_effective") < F.col("effective")))), n("STALE_ACTIVE_PRESENT", slots.where("stale > 0")),
    ]
    return reduce(DataFrame.union, parts)


def without_last(events: DataFrame, accepted: str = "accepted") -> DataFrame:
    """Rollback: all events but the last accepted one; the state is that of the rest."""
    last = events.where(F.col(accepted)).agg(F.max("seq").alias("__last"))
    return events.join(F.broadcast(last)).where(F.col("__last").isNull() | (F.col("seq") != F.col("__last"))).drop("__last")


def state_hash(edges: DataFrame) -> DataFrame:
    """One order-free digest of the edges: their count and two sums of hashes."""
    h = lambda k: F.sum(F.xxhash64(F.lit(k), "slot", "claim", F.col("effective").cast("string"), "status").cast("decimal(38,0)"))
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), h(1).cast("string"), h(2).cast("string")), 256).alias("state"))
