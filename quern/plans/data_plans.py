"""Ledger, entailment, scoring, graphs, joins and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.scratch import scratch, stored
from quern.operators import comparators, core, ledger, retrieval, stats

from .registry import query, table

# ---- ledger: a slot is a user and a kind of event; what it says is props.k; arrival is in the order of a hash


def ledger_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("slot"),
        F.get_json_object("props", "$.k").alias("claim"),
        F.to_date("ts").alias("effective"),
        F.concat(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit("-"), F.col("event_id").cast("string")).alias("seq"),
        F.col("event_id").alias("source"),
    )


_LEDGER = """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS slot, json_extract_string(props, '$.k') AS claim, CAST(ts AS DATE) AS effective, md5(CAST(event_id AS VARCHAR)) || '-' || CAST(event_id AS VARCHAR) AS seq, event_id AS source FROM events
), w AS (
  SELECT *, row_number() OVER (PARTITION BY slot, claim, effective ORDER BY seq) AS copy, max(effective) OVER (PARTITION BY slot ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM e
), a AS (
  SELECT *, count(CASE WHEN copy = 1 THEN 1 END) OVER (PARTITION BY slot, effective ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peers,
    CASE WHEN copy > 1 THEN 'MERGED_IDEMPOTENT' WHEN frontier IS NULL THEN 'INSERTED_ACTIVE' WHEN effective < frontier THEN 'INSERTED_HISTORICAL' WHEN effective = frontier THEN 'CONTRADICTION_RECORDED' ELSE 'SUPERSEDED_PRIOR' END AS action FROM w
), g AS (SELECT slot, claim, effective, min(seq) AS seq, min_by(action, seq) AS action, count(DISTINCT source) AS sources FROM a GROUP BY 1, 2, 3),
f AS (
  SELECT slot, claim, effective, seq, sources, action = 'INSERTED_HISTORICAL' AS late,
    CASE WHEN effective < max(effective) OVER (PARTITION BY slot) THEN 'SUPERSEDED' WHEN count(*) OVER (PARTITION BY slot, effective) = 1 THEN 'ACTIVE' ELSE 'CONTESTED' END AS status,
    CASE WHEN action = 'INSERTED_HISTORICAL' THEN 0 ELSE count(CASE WHEN action <> 'INSERTED_HISTORICAL' THEN 1 END) OVER (PARTITION BY slot, effective) - 1 END AS conflicts FROM g
)
"""


@query(_LEDGER + "SELECT source AS event_id, slot, action, CASE WHEN action IN ('MERGED_IDEMPOTENT', 'INSERTED_HISTORICAL') THEN false WHEN action = 'CONTRADICTION_RECORDED' THEN peers = 1 ELSE true END AS active_truth_changed FROM a")
def ledger_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.actions(ledger_events(table(spark, sf_dir, "events"))).select(F.col("source").alias("event_id"), "slot", "action", "active_truth_changed")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.edges(ledger.actions(ledger_events(table(spark, sf_dir, "events"))))


@query(_LEDGER + "SELECT slot, claim, CAST(effective AS VARCHAR) AS effective, sources, late, status, conflicts FROM f")
def ledger_final_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("slot", "claim", F.col("effective").cast("string").alias("effective"), "sources", "late", "status", "conflicts")


@query(_LEDGER + "SELECT status, count(*) AS edges, count(DISTINCT slot) AS slots, count(*) FILTER (WHERE late) AS late_edges, CAST(sum(sources) AS BIGINT) AS sources, CAST(sum(conflicts) AS BIGINT) AS conflicts FROM f GROUP BY 1")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("slot").alias("slots"), F.count_if("late").alias("late_edges"), F.sum("sources").alias("sources"), F.sum("conflicts").alias("conflicts"))


@query(
    _LEDGER
    + """, s AS (SELECT slot, count(*) FILTER (WHERE status = 'ACTIVE') AS act, count(*) FILTER (WHERE status = 'CONTESTED') AS con, count(DISTINCT CASE WHEN status <> 'SUPERSEDED' THEN effective END) AS dates,
  bool_or(status = 'ACTIVE' AND late) AS active_late, max(effective) AS newest, max(CASE WHEN status <> 'SUPERSEDED' THEN effective END) AS current FROM f GROUP BY 1)
SELECT count(*) AS slots, count(*) FILTER (WHERE act > 1) AS several_active, count(*) FILTER (WHERE act > 0 AND con > 0) AS active_and_contested, count(*) FILTER (WHERE con = 1) AS lone_contested,
  count(*) FILTER (WHERE act + con = 0) AS nothing_current, count(*) FILTER (WHERE dates > 1) AS several_current_dates, count(*) FILTER (WHERE active_late) AS late_active, count(*) FILTER (WHERE current <> newest) AS stale_current FROM s
"""
)
def ledger_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    s = _edges(spark, sf_dir).groupBy("slot").agg(
        F.count_if(status == "ACTIVE").alias("act"), F.count_if(status == "CONTESTED").alias("con"), F.countDistinct(F.when(status != "SUPERSEDED", F.col("effective"))).alias("dates"),
        F.bool_or((status == "ACTIVE") & F.col("late")).alias("active_late"), F.max("effective").alias("newest"), F.max(F.when(status != "SUPERSEDED", F.col("effective"))).alias("current"),
    )
    n = F.count_if
    return s.agg(
        F.count(F.lit(1)).alias("slots"), n(F.col("act") > 1).alias("several_active"), n((F.col("act") > 0) & (F.col("con") > 0)).alias("active_and_contested"), n(F.col("con") == 1).alias("lone_contested"),
        n(F.col("act") + F.col("con") == 0).alias("nothing_current"), n(F.col("dates") > 1).alias("several_current_dates"), n("active_late").alias("late_active"), n(F.col("current") != F.col("newest")).alias("stale_current"),
    )


_LIFECYCLE = (
    _LEDGER
    + """, fr AS (SELECT slot, claim, effective, min_by(frontier, seq) AS frontier FROM a GROUP BY 1, 2, 3),
ed AS (SELECT f.*, fr.frontier, 'edge:' || substr(sha256(f.slot || '|' || f.claim || '|' || CAST(f.effective AS VARCHAR)), 1, 20) AS edge_id FROM f JOIN fr ON fr.slot = f.slot AND fr.claim = f.claim AND fr.effective = f.effective),
st AS (SELECT e.edge_id, e.slot, e.claim, e.effective, e.status, e.late, CASE WHEN e.late THEN (SELECT min(o.edge_id) FROM ed o WHERE o.slot = e.slot AND NOT o.late AND o.effective = e.frontier AND o.seq < e.seq)
  WHEN e.status = 'SUPERSEDED' THEN (SELECT min_by(o.edge_id, o.seq) FROM ed o WHERE o.slot = e.slot AND NOT o.late AND o.effective > e.effective) END AS superseded_by,
  CASE WHEN e.late THEN '' ELSE coalesce((SELECT string_agg(o.edge_id, ',' ORDER BY o.edge_id) FROM ed o WHERE o.slot = e.slot AND NOT o.late AND o.effective = e.effective AND o.edge_id <> e.edge_id), '') END AS conflicts_with FROM ed e)
"""
)


@query(_LIFECYCLE + "SELECT edge_id, slot, status, late, superseded_by, conflicts_with FROM st")
def ledger_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every final edge with the edge that superseded it and those that contest it."""
    s = ledger.lifecycle(ledger.actions(ledger_events(table(spark, sf_dir, "events"))))
    return s.select("edge_id", "slot", "status", "late", "superseded_by", F.array_join("conflicts_with", ",").alias("conflicts_with"))


_DAMAGED = (
    _LIFECYCLE
    + """, one AS (SELECT min(edge_id) AS least FROM st),
x AS (SELECT st.*, right(edge_id, 1) AS x, least, string_split(CASE WHEN conflicts_with = '' THEN NULL ELSE conflicts_with END, ',') AS cw FROM st, one),
d0 AS (SELECT edge_id, slot, claim, effective, CASE x WHEN '0' THEN 'ACTIVE' WHEN '1' THEN 'CONTESTED' ELSE status END AS status, CASE x WHEN '2' THEN 'edge:none' WHEN '4' THEN least ELSE superseded_by END AS superseded_by,
  list_concat(coalesce(cw, []), CASE x WHEN '5' THEN ['edge:ghost'] WHEN '6' THEN [least] ELSE [] END) AS cw, x FROM x),
d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE x = '7'),
s AS (SELECT slot, count(*) FILTER (WHERE status = 'ACTIVE') AS act, count(*) FILTER (WHERE status = 'CONTESTED') AS con, count(DISTINCT effective) FILTER (WHERE status IN ('ACTIVE', 'CONTESTED')) AS dates,
  count(*) FILTER (WHERE status = 'ACTIVE' AND superseded_by IS NOT NULL) AS stale, list(DISTINCT edge_id) FILTER (WHERE status = 'CONTESTED') AS contested FROM d GROUP BY 1),
refs AS (SELECT edge_id, slot, effective, unnest(cw) AS other FROM d), met AS (SELECT r.*, o.slot AS os, o.effective AS oe, o.cw AS ocw FROM refs r LEFT JOIN d o ON o.edge_id = r.other),
sup AS (SELECT d.slot, d.effective, o.slot AS os, o.effective AS oe FROM d LEFT JOIN d o ON o.edge_id = d.superseded_by WHERE d.status = 'SUPERSEDED')
SELECT 'DUPLICATE_CLAIM_DATE' AS rule, count(*) AS violations FROM (SELECT 1 FROM d GROUP BY slot, claim, effective HAVING count(*) > 1)
UNION ALL SELECT 'MULTI_DATE_CURRENT_FRONTIER', count(*) FROM s WHERE dates > 1 UNION ALL SELECT 'MULTI_ACTIVE_FRONTIER', count(*) FROM s WHERE act > 1
UNION ALL SELECT 'ACTIVE_CONTESTED_COEXIST', count(*) FROM s WHERE act > 0 AND con > 0 UNION ALL SELECT 'SINGLETON_CONTESTED', count(*) FROM s WHERE con = 1
UNION ALL SELECT 'INCOMPLETE_CONTESTED_CLIQUE', count(*) FROM d JOIN s USING (slot) WHERE status = 'CONTESTED' AND list_sort(list_filter(contested, lambda c: c <> edge_id)) IS DISTINCT FROM list_sort(list_intersect(cw, contested))
UNION ALL SELECT 'DANGLING_CONFLICT_REF', count(*) FROM met WHERE os IS NULL UNION ALL SELECT 'ASYMMETRIC_CONFLICT_REF', count(*) FROM met WHERE os IS NOT NULL AND NOT list_contains(ocw, edge_id)
UNION ALL SELECT 'CROSS_SLOT_OR_DATE_CONFLICT', count(*) FROM met WHERE os IS NOT NULL AND (os <> slot OR oe <> effective) UNION ALL SELECT 'MISSING_SUPERSEDED_BY', count(*) FROM sup WHERE os IS NULL
UNION ALL SELECT 'CROSS_SLOT_SUPERSESSION', count(*) FROM sup WHERE os <> slot UNION ALL SELECT 'BACKWARD_TIME_SUPERSESSION', count(*) FROM sup WHERE oe < effective UNION ALL SELECT 'STALE_ACTIVE_PRESENT', count(*) FROM s WHERE stale > 0
"""
)


@query(_DAMAGED)
def ledger_state_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen rules over a state a part of whose edges was damaged: statuses, references, supersessions, repeated edges."""
    s = ledger.lifecycle(ledger.actions(ledger_events(table(spark, sf_dir, "events"))))
    least, x = s.agg(F.min("edge_id").alias("least")), F.substring("edge_id", -1, 1)
    more = F.when(x == "5", F.array(F.lit("edge:ghost"))).when(x == "6", F.array("least")).otherwise(F.array().cast("array<string>"))
    d = s.join(F.broadcast(least)).withColumns({
        "status": F.when(x == "0", "ACTIVE").when(x == "1", "CONTESTED").otherwise(F.col("status")), "superseded_by": F.when(x == "2", "edge:none").when(x == "4", F.col("least")).otherwise(F.col("superseded_by")),
        "conflicts_with": F.concat("conflicts_with", more),
    })
    # thirteen counts read it
    return ledger.invariants(stored(d.union(d.where(x == "7")).drop("least"), scratch(spark, "state")))


# ---- joins and filters


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' AND o_orderdate + INTERVAL 365 DAY >= TIMESTAMP '1998-06-30' AND o_orderpriority IN ('1-URGENT', 'all')")
def eligibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders valid at a date, a year from their own, within a scope."""
    at, start = F.lit("1998-06-30").cast("timestamp"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where(core.valid_at(at, start, start + F.expr("INTERVAL 365 DAYS")) & core.in_scope(F.lit("1-URGENT"), F.array("o_orderpriority"))).select("o_orderkey", "o_orderpriority")


@query(
    """
WITH r AS (SELECT *, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_linenumber = 1),
a AS (SELECT l_orderkey AS k, max_by(l_shipdate, {'a': seq, 'b': l_shipdate}) AS v, count(*) AS m FROM r GROUP BY 1),
b AS (SELECT l_partkey AS p, l_suppkey AS s, max_by(l_shipdate, {'a': seq, 'b': l_shipdate}) AS v, count(*) AS m FROM r GROUP BY 1, 2),
l AS (SELECT l.l_orderkey, l.l_linenumber, CASE WHEN a.m IS NOT NULL THEN 'first' WHEN b.m IS NOT NULL THEN 'second' END AS matched_by, CASE WHEN a.m IS NOT NULL THEN a.v ELSE b.v END AS v
  FROM lineitem l LEFT JOIN a ON a.k = l.l_orderkey LEFT JOIN b ON b.p = l.l_partkey AND b.s = l.l_suppkey)
SELECT coalesce(matched_by, 'none') AS matched_by, count(*) AS n, CAST(CAST(min(v) AS DATE) AS VARCHAR) AS earliest, CAST(CAST(max(v) AS DATE) AS VARCHAR) AS latest FROM l GROUP BY 1
"""
)
def fallback_run_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the first line of their order, else of any order of the same part and supplier."""
    lines = table(spark, sf_dir, "lineitem")
    runs = lines.where("l_linenumber = 1").select(F.col("l_orderkey").alias("run"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_shipdate").alias("shipped"), F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("seq"))
    found = core.fallback_join(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), runs, ("l_orderkey", "run"), (["l_partkey", "l_suppkey"], ["p", "s"]), "shipped", "seq")
    day = lambda c: c.cast("date").cast("string")
    return found.groupBy(F.coalesce("matched_by", F.lit("none")).alias("matched_by")).agg(F.count(F.lit(1)).alias("n"), day(F.min("shipped")).alias("earliest"), day(F.max("shipped")).alias("latest"))


@query(
    """
SELECT o_custkey, o_orderkey AS latest_order, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
"""
)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("r"))
    return last.select("o_custkey", F.col("r.o_orderkey").alias("latest_order"), F.col("r.o_orderdate").cast("date").cast("string").alias("order_date"), F.col("r.o_orderstatus").alias("o_orderstatus"))


@query(
    """
SELECT 'lineitem_without_order' AS rule, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'order_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'document_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'repeated_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
"""
)
def referential_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def missing(rule: str, a: DataFrame, key: str, b: DataFrame, other: str) -> DataFrame:
        gone = a.select(key).join(b.select(F.col(other).alias(key)), key, "left_anti")
        return gone.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))

    out = missing("lineitem_without_order", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey")
    for rule in (("order_without_customer", t("orders"), "o_custkey", t("customer"), "c_custkey"), ("order_without_lines", t("orders"), "o_orderkey", t("lineitem"), "l_orderkey"), ("label_without_document", t("labels"), "doc_id", t("documents"), "doc_id"), ("document_without_label", t("documents"), "doc_id", t("labels"), "doc_id")):
        out = out.union(missing(*rule))
    twice = t("lineitem").groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    return out.union(twice.agg(F.lit("repeated_line").alias("rule"), F.count(F.lit(1)).alias("violations")))


# ---- evaluation: gold labels against a length rule


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels (gold) with the rule's prediction, null where there is no document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rule = F.when(F.col("n_chars").isNotNull(), F.when(F.col("n_chars") >= 400, 1).otherwise(0))
    return table(spark, sf_dir, "labels").join(docs, "doc_id", "left").withColumn("rule", rule)


_RATED = "WITH r AS (SELECT l.*, d.lang, d.n_chars, CASE WHEN d.n_chars IS NOT NULL THEN CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END END AS rule FROM labels l LEFT JOIN documents d USING (doc_id))"


@query(_RATED + " SELECT CAST(quality AS VARCHAR) || '->' || coalesce(CAST(rule AS VARCHAR), 'missing') AS pair, count(*) AS n FROM r GROUP BY 1")
def gold_pred_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.concat(F.col("quality").cast("string"), F.lit("->"), F.coalesce(F.col("rule").cast("string"), F.lit("missing")))
    return _rated(spark, sf_dir).groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _RATED
    + """, c AS (SELECT count(*) FILTER (WHERE quality = 1 AND rule = 1) AS tp, count(*) FILTER (WHERE quality = 0 AND rule = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND coalesce(rule, 0) = 0) AS fn, count(*) AS n FROM r)
SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((n - fp - fn) / nullif(n, 0), 6) AS accuracy FROM c
"""
)
def classification_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, r = F.col("quality"), F.coalesce("rule", F.lit(0))
    c = _rated(spark, sf_dir).agg(F.count_if((q == 1) & (r == 1)).alias("tp"), F.count_if((q == 0) & (r == 1)).alias("fp"), F.count_if((q == 1) & (r == 0)).alias("fn"), F.count(F.lit(1)).alias("n"))
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    return c.select("tp", "fp", "fn", stats.rate(tp, tp + fp).alias("precision"), stats.rate(tp, tp + fn).alias("recall"), stats.rate(2 * tp, 2 * tp + fp + fn).alias("f1"), stats.rate(n - fp - fn, n).alias("accuracy"))


@query(
    """
WITH b AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 0 WHEN n_chars < 1000 THEN 1 ELSE 2 END AS b FROM documents), p AS (SELECT quality + (1 - toxic) AS a, b FROM labels JOIN b USING (doc_id)),
n AS (SELECT count(*) AS n, sum(abs(a - b)) / 2.0 AS o, count(*) FILTER (WHERE a = b) AS x FROM p), m AS (SELECT a, count(*) AS n FROM p GROUP BY 1), k AS (SELECT b, count(*) AS n FROM p GROUP BY 1),
e AS (SELECT sum(abs(a - b) / 2.0 * m.n * k.n) AS e FROM m, k)
SELECT n AS paired, round(o / n, 6) AS observed, round(e / (n * n), 6) AS expected, round(1 - (o / n) / (e / (n * n)), 6) AS kappa, round(x / n, 6) AS exact FROM n, e
"""
)
def rater_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rater a: quality plus absence of toxicity; rater b: length in three steps."""
    b = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 200, 0).when(F.col("n_chars") < 1000, 1).otherwise(2).alias("b"))
    both = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("a")).join(b, "doc_id", "full")
    return stats.weighted_kappa(both, "a", "b")


@query(
    """
WITH s AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS gold, CASE WHEN d.doc_id IS NULL THEN 'missing' WHEN n_chars >= 400 THEN 'good' ELSE 'poor' END AS rule
  FROM labels l FULL JOIN documents d ON d.doc_id = l.doc_id)
SELECT gold, rule, count(*) AS n, gold = rule AS agree FROM s GROUP BY 1, 2
"""
)
def status_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("gold"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 400, "good").otherwise("poor").alias("rule"))
    both = a.join(b, "doc_id", "full").na.fill("missing", ["gold", "rule"])
    return both.groupBy("gold", "rule").agg(F.count(F.lit(1)).alias("n")).withColumn("agree", F.col("gold") == F.col("rule"))


@query(
    """
WITH r AS (SELECT d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT coalesce(lang, 'ALL') AS lang, count(*) AS total, count(quality) AS assessed, round(sum(quality) / nullif(count(quality), 0), 6) AS quality_rate, count(toxic) AS safety_known,
  round(sum(toxic) / nullif(count(toxic), 0), 6) AS toxic_rate, CASE WHEN bool_or(toxic = 1) THEN 'true' WHEN count(*) > count(toxic) THEN 'unknown' ELSE 'false' END AS critical FROM r GROUP BY GROUPING SETS ((lang), ())
"""
)
def score_rollup_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension keeps its own denominator; an unknown label is never a pass."""
    r = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return r.rollup("lang").agg(
        F.count(F.lit(1)).alias("total"), F.count("quality").alias("assessed"), stats.rate(F.sum("quality"), F.count("quality")).alias("quality_rate"), F.count("toxic").alias("safety_known"),
        stats.rate(F.sum("toxic"), F.count("toxic")).alias("toxic_rate"), F.coalesce(stats.tri_state(F.col("toxic") == 1).cast("string"), F.lit("unknown")).alias("critical"),
    ).withColumn("lang", F.coalesce("lang", F.lit("ALL")))


@query(
    """
WITH s AS (SELECT round(least(1.0, n_chars / 2000.0), 3) AS score, quality FROM labels JOIN documents USING (doc_id)), g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM s GROUP BY 1),
c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM g),
r AS (SELECT score AS threshold, round(tp / nullif(ps, 0), 6) AS recall, round(fp / nullif(ns, 0), 6) AS false_rate FROM c)
SELECT * FROM (SELECT * FROM r WHERE false_rate <= 0.2 UNION ALL SELECT 1.000001, 0, 0) ORDER BY recall DESC, false_rate, threshold DESC LIMIT 1
"""
)
def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most recall, then fewest false alarms, then the highest threshold, with at most a fifth of false alarms; else one above all scores.

    Scores have three decimals, so the cumulative window runs over at most 1,001 rows.
    """
    s = _rated(spark, sf_dir).where("n_chars is not null").select(F.round(F.least(F.lit(1.0), F.col("n_chars") / 2000.0), 3).alias("score"), "quality")
    return comparators.choose_threshold(s, "score", "quality", 0.2).select("threshold", F.round("recall", 6).alias("recall"), F.round("false_rate", 6).alias("false_rate"))


@query(
    """
SELECT event_type, list_sort(list(value))[1 + least(count(*) - 1, CAST(floor(count(*) * 0.5) AS BIGINT))] AS p50, list_sort(list(value))[1 + least(count(*) - 1, CAST(floor(count(*) * 0.95) AS BIGINT))] AS p95, max(value) AS longest, count(*) AS n FROM events GROUP BY 1
"""
)
def latency_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks min(n - 1, int(share * n)) by counting equal values first, so no group is gathered."""
    c = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy("value"))
    n = c.groupBy("event_type").agg(F.sum("c").alias("n"), F.max("value").alias("longest"))
    at = lambda share: F.min(F.when(F.col("u") > F.least(F.col("n") - 1, F.floor(F.col("n") * share)), F.col("value")))
    return c.withColumn("u", upto).join(n, "event_type").groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.first("longest").alias("longest"), F.first("n").alias("n"))


@query(
    """
WITH l AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, bool_or(l_shipdate < DATE '1995-01-01') AS early FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, CASE WHEN n IS NULL THEN 'lines' WHEN early THEN 'dates' WHEN s > 400000 THEN 'amount' WHEN o_orderstatus = 'P' THEN 'status' ELSE 'passed' END AS stage FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT stage, count(*) AS orders, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1
"""
)
def stage_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check an order fails."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"), F.bool_or(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).alias("early"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    stage = F.when(F.col("n").isNull(), "lines").when(F.col("early"), "dates").when(F.col("s") > 400000, "amount").when(F.col("o_orderstatus") == "P", "status").otherwise("passed")
    g = o.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("orders"))
    return g.withColumn("share", F.round(F.col("orders") / F.sum("orders").over(Window.partitionBy(F.lit(0))), 6))


@query(
    """
WITH y AS (SELECT c_mktsegment AS segment, c_nationkey, year(o_orderdate) AS y, o_totalprice, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) IN (1996, 1997)),
m AS (SELECT segment, round(avg(o_totalprice / 500000) FILTER (WHERE y = 1996), 6) AS baseline, round(avg(o_totalprice / 500000) FILTER (WHERE y = 1997), 6) AS candidate, count(*) FILTER (WHERE y = 1996) AS baseline_n, count(*) FILTER (WHERE y = 1997) AS candidate_n,
  count(*) FILTER (WHERE y = 1996 AND o_orderstatus = 'P') AS be, count(*) FILTER (WHERE y = 1997 AND o_orderstatus = 'P') AS ce, count(DISTINCT CASE WHEN y = 1996 THEN c_nationkey END) AS bc, count(DISTINCT CASE WHEN y = 1997 THEN c_nationkey END) AS cc, count(DISTINCT c_nationkey) AS nc FROM y GROUP BY 1)
SELECT segment, baseline, candidate, baseline_n, candidate_n, bc = nc AND cc = nc AS same_cases, ce <= be AS critical_ok, CASE WHEN bc = nc AND cc = nc AND ce <= be AND candidate - baseline >= -0.01 THEN 'PASS' ELSE 'FAIL' END AS gate FROM m
"""
)
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline: orders of 1996; candidate: of 1997.  Equal cases, no more critical errors, and no metric down by over 0.01."""
    y = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("y", F.year("o_orderdate")).where("y in (1996, 1997)")
    of = lambda k, x: F.when(F.col("y") == k, x)
    score, bad = F.col("o_totalprice") / 500000, F.col("o_orderstatus") == "P"
    m = y.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.round(F.avg(of(1996, score)), 6).alias("baseline"), F.round(F.avg(of(1997, score)), 6).alias("candidate"), F.count_if(F.col("y") == 1996).alias("baseline_n"), F.count_if(F.col("y") == 1997).alias("candidate_n"),
        F.count_if((F.col("y") == 1996) & bad).alias("be"), F.count_if((F.col("y") == 1997) & bad).alias("ce"), F.countDistinct(of(1996, F.col("c_nationkey"))).alias("bc"), F.countDistinct(of(1997, F.col("c_nationkey"))).alias("cc"), F.countDistinct("c_nationkey").alias("nc"),
    )
    same, ok = (F.col("bc") == F.col("nc")) & (F.col("cc") == F.col("nc")), F.col("ce") <= F.col("be")
    passes = same & ok & (stats.gate(F.col("candidate") - F.col("baseline"), F.lit(-0.01)) == "PASS")
    return m.select("segment", "baseline", "candidate", "baseline_n", "candidate_n", same.alias("same_cases"), ok.alias("critical_ok"), F.when(passes, "PASS").otherwise("FAIL").alias("gate"))


#: What to try for a failure label.
ROUTES = {"BAD_TOOL_CALL": "tools", "STALE_KNOWLEDGE": "refresh", "ERROR": "triage"}


@query(
    """
WITH f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'STALE_KNOWLEDGE' ELSE upper(event_type) END AS failure, value FROM events),
r(failure, route) AS (VALUES ('BAD_TOOL_CALL', 'tools'), ('STALE_KNOWLEDGE', 'refresh'), ('ERROR', 'triage'))
SELECT failure, coalesce(route, 'unmapped') AS route, count(*) AS n, count(DISTINCT user_id) AS users, CASE WHEN failure = 'ERROR' THEN 'BLOCKER' WHEN route IS NOT NULL THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM f LEFT JOIN r USING (failure) GROUP BY 1, 2, 5
"""
)
def failure_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = X.failure_label(F.when(F.col("event_type") == "signup", "stale (seen at sign-up)").otherwise(F.col("event_type")))
    routes = spark.createDataFrame(list(ROUTES.items()), "failure string, route string")
    f = table(spark, sf_dir, "events").select("user_id", label.alias("failure")).join(F.broadcast(routes), "failure", "left")
    g = f.groupBy("failure", "route").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return g.select("failure", F.coalesce("route", F.lit("unmapped")).alias("route"), "n", "users", F.when(F.col("failure") == "ERROR", "BLOCKER").when(F.col("route").isNotNull(), "HIGH").otherwise("NORMAL").alias("priority"))


_FAMILY = """
WITH p AS (SELECT o_custkey, c_nationkey AS family, avg(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE year(o_orderdate) = 1996) AS a, avg(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE year(o_orderdate) = 1997) AS b FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
f AS (SELECT family, count(*) AS pairs, avg(b - a) AS delta FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
"""


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    of = lambda k: F.avg(F.when(F.year("o_orderdate") == k, F.col("o_totalprice")))
    p = o.groupBy("o_custkey", F.col("c_nationkey").alias("family")).agg(of(1996).alias("a"), of(1997).alias("b")).where("a is not null and b is not null")
    return p.groupBy("family").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("b") - F.col("a")).alias("delta"))


@query(_FAMILY + "SELECT family, pairs, round(delta, 2) AS delta FROM f UNION ALL SELECT -1, CAST(sum(pairs) AS BIGINT), round(avg(delta), 2) FROM f")
def paired_family_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation paired over two years; families weigh equally in the total (family -1)."""
    f = _families(spark, sf_dir)
    return f.select("family", "pairs", F.round("delta", 2).alias("delta")).union(f.agg(F.lit(-1), F.sum("pairs"), F.round(F.avg("delta"), 2)))


@query()
def paired_family_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster bootstrap over the families' deltas, one number for each nation."""
    effects = [r["delta"] for r in _families(spark, sf_dir).orderBy("family").collect()]
    low, high = stats.bootstrap_interval(effects, seed=7) or (None, None)
    return spark.createDataFrame([(len(effects), sum(effects) / len(effects) if effects else None, low, high)], "families int, delta double, low double, high double")


# ---- graph


@query(
    """
WITH n AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS label FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
), e AS (
  SELECT 'nation:' || n_nationkey AS s, 'IN_REGION' AS p, 'region:' || n_regionkey AS o FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'IN_NATION', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'IN_NATION', 'nation:' || c_nationkey FROM customer
)
SELECT 'node' AS what, kind AS name, count(DISTINCT id) AS n, min(substr(sha1(kind || '|' || id), 1, 16)) AS first_id FROM n GROUP BY 2
UNION ALL SELECT 'edge', p, count(*), min(substr(sha1('edge|' || s || '|' || p || '|' || o), 1, 16)) FROM (SELECT DISTINCT * FROM e) GROUP BY 2
"""
)
def kg_merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges of several sources, merged by id, with stable ids and counts."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nodes = None
    for kind, df, key in (("region", t("region"), "r_regionkey"), ("nation", t("nation"), "n_nationkey"), ("supplier", t("supplier"), "s_suppkey"), ("customer", t("customer"), "c_custkey")):
        one = df.select(name(kind, key).alias("id"), F.lit(kind).alias("kind"))
        nodes = one if nodes is None else nodes.unionByName(one)
    edges = None
    for df, kind, key, p, okind, other in ((t("nation"), "nation", "n_nationkey", "IN_REGION", "region", "n_regionkey"), (t("supplier"), "supplier", "s_suppkey", "IN_NATION", "nation", "s_nationkey"), (t("customer"), "customer", "c_custkey", "IN_NATION", "nation", "c_nationkey")):
        one = df.select(name(kind, key).alias("s"), F.lit(p).alias("p"), name(okind, other).alias("o"))
        edges = one if edges is None else edges.unionByName(one)
    a = nodes.distinct().groupBy(F.lit("node").alias("what"), F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(F.substring(F.sha1(F.concat_ws("|", "kind", "id")), 1, 16)).alias("first_id"))
    b = edges.distinct().groupBy(F.lit("edge").alias("what"), F.col("p").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(X.edge_id(F.lit("edge"), F.col("s"), F.col("p"), F.col("o"))).alias("first_id"))
    return a.union(b)


@query(
    """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), d AS (SELECT s, count(*) AS n FROM e GROUP BY 1),
x AS (SELECT a.s AS a, b.s AS b, count(*) AS shared FROM e a JOIN e b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2),
v AS (SELECT a, b, shared, na.n - shared AS only_a, nb.n - shared AS only_b, x.a IN (SELECT s_suppkey FROM supplier s WHERE s_nationkey = (SELECT s_nationkey FROM supplier t WHERE t.s_suppkey = x.b)) AS same_nation FROM x JOIN d na ON na.s = a JOIN d nb ON nb.s = b)
SELECT a, b, shared, only_a, only_b, round(0.75 * least(1.0, shared / 150.0) + CASE WHEN same_nation THEN 0.25 ELSE 0 END, 6) AS score,
  CASE WHEN round(0.75 * least(1.0, shared / 150.0) + CASE WHEN same_nation THEN 0.25 ELSE 0 END, 6) >= 0.75 THEN 'alert' WHEN round(0.75 * least(1.0, shared / 150.0) + CASE WHEN same_nation THEN 0.25 ELSE 0 END, 6) >= 0.5 THEN 'watch' ELSE 'note' END AS level FROM v
"""
)
def neighbor_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the parts they share: a part's suppliers meet in cells, which count pairs before anything else."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    n = e.groupBy("s").agg(F.count(F.lit(1)).alias("n")).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s"), "s_nationkey"), "s", "left")
    x = retrieval.shared_neighbours(e.withColumnRenamed("p", "n"))
    side = lambda k: n.select(F.col("s").alias(k), F.col("n").alias(f"n{k}"), F.col("s_nationkey").alias(f"k{k}"))
    v = x.join(side("a"), "a", "left").join(side("b"), "b", "left")  # all are found; a left join never broadcasts the pairs, however few Spark expects
    score = F.round(0.75 * F.least(F.lit(1.0), F.col("shared") / 150.0) + F.when(F.col("ka") == F.col("kb"), 0.25).otherwise(0), 6)
    return v.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), score.alias("score")).withColumn("level", F.when(F.col("score") >= 0.75, "alert").when(F.col("score") >= 0.5, "watch").otherwise("note"))


# ---- export and release


@query(
    """
WITH f AS (SELECT source AS family, bool_and(quality = 1 AND toxic = 0) AS approved, count(*) AS documents, count(*) FILTER (WHERE quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT family, documents, unlabelled, CASE WHEN unlabelled = 0 AND approved THEN 'PASS' ELSE 'FAIL' END AS gate FROM f
"""
)
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is released if all of its documents are labelled good and not toxic."""
    r = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    f = r.groupBy(F.col("source").alias("family")).agg(F.bool_and((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("ok"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))
    return f.select("family", "documents", "unlabelled", F.when((F.col("unlabelled") == 0) & F.col("ok"), "PASS").otherwise("FAIL").alias("gate"))
