"""Segments and bound conditions of documents; frames, registries and probed regions over rows made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.scratch import scratch, stored
from quern.operators import frames

from .registry import Derived, query, table

#: What counts as an event and as a condition in the invented words of documents.
_EVENT, _CONDITION = "[a-z]+tion", "[a-z]+ing"


def _places(pattern: str, name: str, of: str = "t") -> str:
    """A CTE of the pattern's matches: doc_id, raw (what stands before), m (the match), beg (where raw begins)."""
    return f"""{name}0 AS (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS parts, list_append(regexp_extract_all(t, '{pattern}'), '') AS ms FROM {of}),
{name}1 AS (SELECT doc_id, unnest(parts) AS raw, unnest(ms) AS m, generate_subscripts(parts, 1) - 1 AS number FROM {name}0),
{name} AS (SELECT *, coalesce(sum(length(raw) + length(m)) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS beg FROM {name}1)"""


_SEGMENTS = f"""WITH t AS (SELECT doc_id, lang, lower(text) AS t FROM documents WHERE text IS NOT NULL), {_places(frames.SEPARATOR, "g")},
seg AS (SELECT doc_id, number, regexp_replace(raw, '^[ ,;]+|[ ,;]+$', '', 'g') AS segment, beg + length(raw) - length(regexp_replace(raw, '^[ ,;]+', '')) AS start FROM g),
s AS (SELECT *, start + length(segment) AS e FROM seg WHERE segment <> '')"""


@query(f'{_SEGMENTS} SELECT doc_id, CAST(number AS INTEGER) AS number, segment, CAST(start AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM s')
def coordination_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut where an independent statement begins."""
    return frames.segments(table(spark, sf_dir, "documents"), "doc_id").withColumn("number", F.col("number").cast("int"))


@query(
    f"""{_SEGMENTS}, {_places(_EVENT, "v")}, {_places(_CONDITION, "w")}, ev AS (SELECT doc_id, m AS kind, beg + length(raw) AS start FROM v WHERE m <> ''), co AS (SELECT doc_id, m AS condition, beg + length(raw) AS c FROM w WHERE m <> ''),
x AS (SELECT ev.*, s.start AS s, s.e, t.lang FROM ev JOIN s ON s.doc_id = ev.doc_id AND ev.start >= s.start AND ev.start < s.e JOIN t ON t.doc_id = ev.doc_id),
n AS (SELECT x.doc_id, x.start, min_by(co.condition, abs(co.c - x.start) * 1000000 + co.c) AS near FROM x JOIN co ON co.doc_id = x.doc_id AND co.c >= x.s AND co.c < x.e GROUP BY 1, 2)
SELECT x.doc_id, kind, CAST(x.start AS INTEGER) AS start, CASE WHEN near IS NOT NULL THEN near WHEN s > 0 THEN NULL ELSE lang END AS condition, CASE WHEN near IS NOT NULL THEN 'nearest' WHEN s > 0 THEN 'dropped' ELSE 'kept' END AS rebind
FROM x LEFT JOIN n ON n.doc_id = x.doc_id AND n.start = x.start"""
)
def segment_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in documents, bound to the conditions of their own segments; all have the document's language as an inherited one."""
    docs = table(spark, sf_dir, "documents")
    found = X.mentions(F.lower("text"), {"event": _EVENT, "condition": _CONDITION})
    spots = docs.select("doc_id", "lang", X.rows_of(found).alias("m")).where("m is not null").select("doc_id", "lang", "m.kind", "m.start", "m.word")
    spots = stored(spots, scratch(spark, "mentions"))  # read twice
    events = spots.where("kind = 'event'").select("doc_id", F.col("word").alias("kind"), "start", F.col("lang").alias("condition"))
    conditions = spots.where("kind = 'condition'").select("doc_id", "start", F.col("word").alias("condition"))
    return frames.bound_in_segment(events, conditions, frames.segments(docs, "doc_id"), "doc_id")


_FRAMES = Derived("lineitem", {"text_id": "l_orderkey", "pos": "l_linenumber * 100000 + l_partkey", "event": "CASE l_suppkey % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'start' WHEN 2 THEN 'deny' ELSE 'unknown' END", "subject": "concat('s', CAST(l_partkey % 2 AS STRING))", "object": "'o'", "population": "CASE WHEN l_quantity > 25 THEN 'adult' END", "condition": "CAST(NULL AS STRING)"})
_REGISTRY = [("stop", "DISCONTINUE", "POSITIVE"), ("start", "START", "POSITIVE"), ("deny", "DISCONTINUE", "NEGATIVE")]


@query(
    f"""
WITH f AS ({_FRAMES.sql()}), r(event, predicate, polarity) AS (VALUES {", ".join(str(x) for x in _REGISTRY)})
SELECT text_id, subject, predicate, polarity, population, min(pos) AS pos FROM f JOIN r USING (event) GROUP BY 1, 2, 3, 4, 5
"""
)
def compiled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.createDataFrame(_REGISTRY, "event string, predicate string, polarity string")
    return frames.compile_frames(_FRAMES.rows(spark, sf_dir), registry).select("text_id", "subject", "predicate", "polarity", "population", "pos")


_SAID = Derived("part", {
    "text_id": "p_brand", "subject": "CASE WHEN p_partkey % 31 = 0 THEN ' ' ELSE 'Drug' END", "predicate": "CASE p_partkey % 40 WHEN 0 THEN 'odd' WHEN 1 THEN 'reports' ELSE 'Stops' END", "object": "'o'", "polarity": "CASE WHEN p_partkey % 1000 = 5 THEN 'maybe' ELSE 'positive' END",
    "confidence": "CASE WHEN p_partkey % 400 = 1 THEN 1.5 ELSE 0.5 END", "variable": "'egfr'", "operator": "CASE WHEN p_partkey % 1000 = 6 THEN 'NEAR' WHEN p_partkey % 2 = 0 THEN 'LT' END", "value": "CASE WHEN p_partkey % 1000 = 8 THEN NULL ELSE CAST(p_size AS DOUBLE) END", "low": "CAST(NULL AS DOUBLE)", "high": "CAST(NULL AS DOUBLE)",
})


@query(
    f"""
WITH p AS ({_SAID.sql()}), k AS (SELECT *, upper(predicate) AS u FROM p), f AS (SELECT text_id, u, trim(subject) = '' OR u = 'ODD' OR polarity = 'maybe' OR confidence > 1 OR coalesce(operator = 'NEAR', false) OR coalesce(operator = 'LT' AND value IS NULL, false) AS bad FROM k)
SELECT text_id, count(*) AS propositions, count(*) FILTER (WHERE bad) AS unresolved, bool_or(bad AND u <> 'REPORTS') AS abstain FROM f GROUP BY 1
"""
)
def registry_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Propositions against a registry; a fault in a critical predicate makes a text abstain."""
    registry = spark.createDataFrame([("STOPS", True), ("REPORTS", False)], "predicate string, critical boolean")
    return frames.registry_faults(_SAID.rows(spark, sf_dir), registry, ["egfr"])[1]


_ACTION = "CASE CAST(substr(p_brand, 7) AS INT) % 2 WHEN 0 THEN 'CONTRAINDICATED' ELSE 'DISCONTINUE' END"
_REGIONS = Derived("part", {"case_id": "p_brand", "claim_id": "p_partkey", "predicate": _ACTION, "population": "CASE WHEN p_partkey % 3 = 0 THEN 'adult' END", "operator": "CASE WHEN p_partkey % 2 = 1 THEN 'LT' ELSE 'RANGE' END", "value": "CAST(p_size AS DOUBLE)", "low": "CAST(p_size AS DOUBLE)", "high": "p_size + 8.0"}, "p_partkey % 5 = 1")
_KNOWN = Derived("part", {"case_id": "p_brand", "predicate": "CASE WHEN p_size % 7 = 0 THEN 'REASSESS_BENEFIT_RISK' ELSE " + _ACTION + " END", "population": "CASE WHEN p_partkey % 4 = 0 THEN 'adult' END", "operator": "'RANGE'", "value": "CAST(NULL AS DOUBLE)", "low": "CAST(p_size AS DOUBLE)", "high": "p_size + 6.0"}, "p_partkey % 10 = 2")


@query(
    f"""
WITH c AS ({_REGIONS.sql()}), e AS ({_KNOWN.sql()}), p AS (SELECT DISTINCT case_id, claim_id, predicate, population, unnest(CASE operator WHEN 'LT' THEN [greatest(0, value - 1), greatest(0, value - 5), greatest(0, value - 14)] ELSE [low, (low + high) / 2, high] END) AS place FROM c),
a AS (SELECT p.claim_id, p.case_id, place, coalesce(bool_or(e.predicate = p.predicate), false) AS same, count(e.case_id) > 0 AS something FROM p LEFT JOIN e ON e.case_id = p.case_id AND (e.population IS NULL OR coalesce(e.population = p.population, false)) AND place BETWEEN e.low AND e.high GROUP BY 1, 2, 3)
SELECT claim_id, count(*) AS probes, count(*) FILTER (WHERE same) AS supported, count(*) FILTER (WHERE something AND NOT same) AS conflicts, CASE WHEN count(*) FILTER (WHERE something AND NOT same) > 0 THEN 'CONTRADICTED' WHEN count(*) FILTER (WHERE same) = count(*) THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict FROM a GROUP BY claim_id, case_id
"""
)
def probed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.probed(_REGIONS.rows(spark, sf_dir), _KNOWN.rows(spark, sf_dir)).drop("case_id")
