"""Journals and diagnosis over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import diagnosis, journal

from .registry import query, table


@query(
    """
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS number, event_id, event_type || '=' || json_extract_string(props, '$.k') AS payload FROM events),
c AS (
  SELECT key, number, event_id, payload, '' AS previous, sha256('|' || payload) AS digest FROM e WHERE number = 1
  UNION ALL SELECT e.key, e.number, e.event_id, e.payload, c.digest, sha256(c.digest || '|' || e.payload) FROM c JOIN e ON e.key = c.key AND e.number = c.number + 1
), h AS (SELECT key, max(number) AS number, max_by(digest, number) AS digest FROM c GROUP BY 1),
-- damage: payloads rewritten, entries taken out, neighbours exchanged
w AS (SELECT key, CASE WHEN event_id % 89 = 0 AND number > 4 THEN number ELSE CASE number WHEN 2 THEN CASE WHEN CAST(key AS INT) % 5 = 0 THEN 3 ELSE 2 END WHEN 3 THEN CASE WHEN CAST(key AS INT) % 5 = 0 THEN 2 ELSE 3 END ELSE number END END AS number,
  CASE WHEN event_id % 89 = 0 AND number > 4 THEN payload || '!' ELSE payload END AS payload, previous, digest FROM c WHERE NOT (event_id % 97 = 0 AND number > 4)),
b AS (SELECT key, number + 1 AS number, list(digest) AS there FROM w GROUP BY 1, 2), p AS (SELECT key, digest AS previous, min(number) AS stands FROM w GROUP BY 1, 2),
x AS (SELECT w.key, w.number, w.digest <> sha256(w.previous || '|' || w.payload) AS changed, (w.number = 1 AND w.previous = '') OR coalesce(list_contains(there, w.previous), false) AS linked, stands, there, w.previous FROM w LEFT JOIN b USING (key, number) LEFT JOIN p ON p.key = w.key AND p.previous = w.previous)
SELECT key, number, 'CHANGED' AS fault FROM x WHERE changed
UNION ALL SELECT key, number, CASE WHEN stands IS NOT NULL OR previous = '' THEN 'REORDERED' WHEN there IS NULL THEN 'MISSING' ELSE 'BROKEN_LINK' END FROM x WHERE NOT linked
UNION ALL SELECT h.key, h.number, 'TRUNCATED' FROM h LEFT JOIN w ON w.key = h.key AND w.number = h.number AND w.digest = h.digest WHERE w.key IS NULL
"""
)
def journal_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal of each user's events, then rewritten, missing and exchanged entries, and what the check finds."""
    e = table(spark, sf_dir, "events")
    payload = F.concat("event_type", F.lit("="), F.get_json_object("props", "$.k"))
    entries = e.select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id").alias("seq"), payload.alias("payload"))
    log = journal.appended(entries)
    ids = e.select(F.col("user_id").cast("string").alias("key"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("number"))
    known, j = journal.heads(log), log.join(ids, ["key", "number"])
    rewritten, swapped = (F.col("event_id") % 89 == 0) & (F.col("number") > 4), F.col("key").cast("int") % 5 == 0
    number = F.when(swapped & (F.col("number") == 2), F.lit(3)).when(swapped & (F.col("number") == 3), F.lit(2)).otherwise(F.col("number"))
    damaged = j.where(~((F.col("event_id") % 97 == 0) & (F.col("number") > 4))).select("key", number.cast("long").alias("number"), F.when(rewritten, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")).alias("payload"), "previous", "digest")
    return journal.faults(damaged, known)


_SAME, _FACTORS = ["criterion"], ["flag", "status", "tax", "discount", "year"]


def _hypotheses_sql() -> str:
    text = lambda c: f"coalesce(CAST({c} AS VARCHAR), chr(0))"
    each = " UNION ALL ".join(f"SELECT run, criterion, outcome, '{f}' AS factor, {text(f)} AS value, concat_ws(chr(31), '{f}', {', '.join(text(c) for c in [*_SAME, *[x for x in _FACTORS if x != f]])}) AS k FROM r" for f in _FACTORS)
    behind = ", ".join(f"('{m}', '{c}')" for m, cs in diagnosis.CANDIDATES.items() for c in cs)
    return f"""
WITH r AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS run, CAST(l_suppkey % 3 AS VARCHAR) AS criterion, l_returnflag AS flag, l_linestatus AS status, CAST(round(l_tax * 100) AS INT) AS tax, CAST(round(l_discount * 100) AS INT) AS discount, year(l_shipdate) AS year,
  'C' || (l_partkey % 8 + 1) AS module, CASE WHEN l_quantity < 10 THEN 'instrumented' ELSE 'black_box' END AS seen, CASE WHEN l_quantity > 48 THEN NULL WHEN l_extendedprice > 60000 THEN 'fail' ELSE 'pass' END AS outcome FROM lineitem),
x AS ({each}), v AS (SELECT k, value, min(run) AS run FROM x WHERE outcome = 'pass' GROUP BY 1, 2),
m AS (SELECT k, min(value) AS lo, max(value) AS hi, min_by(run, value) AS lo_run, max_by(run, value) AS hi_run FROM v GROUP BY 1),
c AS (SELECT x.run, x.criterion, factor, CASE WHEN lo <> value THEN lo_run WHEN hi <> value THEN hi_run END AS control FROM x JOIN m USING (k) WHERE outcome = 'fail'), b(module, category) AS (VALUES {behind})
SELECT c.run, c.criterion, factor AS category, CASE seen WHEN 'instrumented' THEN 'verified_under_test' ELSE 'supported_hypothesis' END AS evidence_level, factor, control FROM c JOIN r ON r.run = c.run AND r.criterion = c.criterion AND r.outcome = 'fail' WHERE control IS NOT NULL
UNION ALL SELECT run, criterion, category, 'needs_investigation', NULL, NULL FROM r JOIN b USING (module) WHERE outcome = 'fail'"""


@query(_hypotheses_sql())
def graded_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as runs: dear ones failed, and those that differ in one factor only and passed are their controls."""
    r = table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("run"), (F.col("l_suppkey") % 3).cast("string").alias("criterion"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.round(F.col("l_tax") * 100).cast("int").alias("tax"),
        F.round(F.col("l_discount") * 100).cast("int").alias("discount"), F.year("l_shipdate").alias("year"), F.concat(F.lit("C"), F.col("l_partkey") % 8 + 1).alias("module"), F.when(F.col("l_quantity") < 10, "instrumented").otherwise("black_box").alias("observability"),
        F.when(F.col("l_quantity") > 48, None).when(F.col("l_extendedprice") > 60000, "fail").otherwise("pass").alias("outcome"),
    )
    return diagnosis.hypotheses(r, "run", _SAME, _FACTORS)
