"""Stateful plans: the ledger as a stream, and the fold of visible facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.scratch import scratch
from quern.operators import visible_facts as V
from quern.streaming import facts
from quern.streaming import ledger as stream

from .data_plans import _LEDGER, ledger_events
from .registry import query, table


@query(_LEDGER + "SELECT slot, seq, action, CASE WHEN action IN ('MERGED_IDEMPOTENT', 'INSERTED_HISTORICAL') THEN false WHEN action = 'CONTRADICTION_RECORDED' THEN peers = 1 ELSE true END AS active_truth_changed FROM a")
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch ledger's actions from Structured Streaming over the same file; results land in the shared folder."""
    path = scratch(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = ledger_events(events).withColumn("effective", F.col("effective").cast("string"))
    run = stream.actions(rows).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.OUT).parquet(f"{path}/out")


_FACTS = """
WITH RECURSIVE u AS (
  SELECT CAST(user_id AS VARCHAR) || '|' || event_type AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, 't' || event_id AS turn,
    CASE WHEN value < 3 THEN 'unknown' WHEN value < 9 THEN 'conflict' ELSE 'confirmed' END AS status, CASE WHEN value >= 3 OR event_id % 9 = 0 THEN json_extract_string(props, '$.k') END AS value,
    CASE WHEN event_id % 3 = 0 THEN lag('t' || event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS sup FROM events
), r AS (
  SELECT key, 0 AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS turn, CAST([] AS VARCHAR[]) AS alts, 0 AS taken, 0 AS refused FROM (SELECT DISTINCT key FROM u)
  UNION ALL
  SELECT r.key, u.n, CASE WHEN ok THEN u.status ELSE r.status END, CASE WHEN ok THEN u.value ELSE r.value END, CASE WHEN ok THEN u.turn ELSE r.turn END,
    CASE WHEN NOT ok THEN r.alts WHEN u.status <> 'conflict' THEN CAST([] AS VARCHAR[]) ELSE CASE WHEN list_contains(kept, u.value) THEN kept ELSE list_append(kept, u.value) END END, r.taken + CASE WHEN ok THEN 1 ELSE 0 END, r.refused + CASE WHEN ok THEN 0 ELSE 1 END
  FROM r JOIN u ON u.key = r.key AND u.n = r.n + 1,
    LATERAL (SELECT (u.status = 'unknown') = (u.value IS NULL) AND (u.sup IS NULL OR u.sup IS NOT DISTINCT FROM r.turn) AND NOT (r.turn IS NOT NULL AND u.sup IS NULL AND u.status <> 'conflict' AND (u.status IS DISTINCT FROM r.status OR u.value IS DISTINCT FROM r.value)) AS ok,
      CASE WHEN u.sup IS NOT NULL THEN CAST([] AS VARCHAR[]) WHEN r.status = 'conflict' THEN r.alts WHEN r.status = 'confirmed' THEN [r.value] ELSE CAST([] AS VARCHAR[]) END AS kept) x
)
SELECT key, status, value, turn AS turn_id, array_to_string(alts, ',') AS alternatives, CAST(taken AS BIGINT) AS taken, CAST(refused AS BIGINT) AS refused FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1
"""


@query(_FACTS)
def fact_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and kind of event: unknown, contested and confirmed values in order, some of which supersede the turn before."""
    turn = F.concat(F.lit("t"), F.col("event_id").cast("string"))
    e = table(spark, sf_dir, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), F.struct("ts", "event_id").alias("seq"), turn.alias("turn_id"), "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("w"))
    before = F.lag("turn_id").over(Window.partitionBy("key").orderBy("seq"))
    status = F.when(F.col("w") < 3, "unknown").when(F.col("w") < 9, "conflict").otherwise("confirmed")
    updates = e.select("key", "seq", "turn_id", status.alias("status"), F.when((F.col("w") >= 3) | (F.col("event_id") % 9 == 0), F.col("k")).alias("value"), F.when(F.col("event_id") % 3 == 0, before).alias("supersedes"))
    s = facts.fold(updates)
    return s.select("key", "status", "value", "turn_id", F.array_join("alternatives", ",").alias("alternatives"), F.size("history").cast("long").alias("taken"), F.size("refused").cast("long").alias("refused"))


#: What users add to their turns: declarations, doubts, corrections, questions, and two ways at once.
SAYINGS = [
    "没有发热。", "有发热，服药时间是昨天晚上。", "是否发热不清楚。", "更正一下，没有发热。", "服药时间是今天早上，对吗？", "妈妈没有服药；已经服药。", "更正，服药时间为周一，报告日期:三月一日。", "报告日期是三月二日。", "报告日期不知道。", "我是替妈妈问的。",
    "发烧，没有发烧。", "妈妈是否服药不清楚！", "药名尚不清楚，爸爸发热。", "服药时间是可能昨天。", "刚才说错了：发热。是不是有服药呢。", "",
]


def _visible_sql() -> str:
    v = V
    lst = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    labels, times, subjects = (f"MAP {{{', '.join(f'{chr(39)}{a}{chr(39)}: {chr(39)}{b}{chr(39)}' for a, b in m.items())}}}" for m in (v.LABELS, v.TIMES, v.SUBJECTS))
    who = lambda x: f"{subjects}[substr({x}, 1, 2)]"
    rest = lambda x: f"CASE WHEN {who(x)} IS NOT NULL THEN substr({x}, 3) ELSE {x} END"
    dated = rf"^({'|'.join(v.TIMES)})(?:是|为|：|:)\s*(.{{1,40}})$"
    said = " ".join(f"WHEN list_contains({lst(ps)}, r) THEN struct_pack(k := h || '{k}', v := '{val}', st := 'confirmed')" for k, val, ps in v.DECLARED)
    return f"""
WITH RECURSIVE t AS (SELECT conv_id, turn, text || chr(10) || ({lst(SAYINGS)})[(length(text) + turn) % {len(SAYINGS)} + 1] AS text FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{v.SENTENCE}')) AS sentence, generate_subscripts(regexp_extract_all(text, '{v.SENTENCE}'), 1) AS s FROM t),
p AS (SELECT *, list_transform(string_split(regexp_replace(regexp_replace(sentence, '[。！!；;\n]+$', ''), '[，,]+', chr(31), 'g'), chr(31)), lambda x: trim(x)) AS parts FROM s),
q AS (SELECT *, regexp_matches(sentence, '[?？]') OR len(list_filter(parts, lambda x: regexp_matches(x, '{v.QUESTION}') AND {labels}[regexp_extract({rest("x")}, '{v.UNKNOWN}', 1)] IS NULL)) > 0 AS asks FROM p),
c AS (SELECT conv_id, turn, s, asks, unnest(parts) AS raw, generate_subscripts(parts, 1) AS c FROM q),
b AS (SELECT *, trim(regexp_replace(raw, '{v.CORRECTION}', '')) AS bare, bool_or(NOT asks AND regexp_matches(raw, '{v.CORRECTION}')) OVER (PARTITION BY conv_id, turn ORDER BY s, c) AS corrected FROM c WHERE raw <> ''),
x AS (SELECT *, {rest("bare")} AS r, coalesce({who("bare")} || '.', '') AS h FROM b WHERE NOT asks),
d AS (SELECT conv_id, turn, s, c, corrected, CASE WHEN {labels}[regexp_extract(r, '{v.UNKNOWN}', 1)] IS NOT NULL THEN struct_pack(k := h || {labels}[regexp_extract(r, '{v.UNKNOWN}', 1)], v := CAST(NULL AS VARCHAR), st := 'unknown') {said}
  WHEN regexp_matches(r, '{dated}') AND NOT regexp_matches(trim(regexp_extract(r, '{dated}', 2)), '{v.HEDGES}') THEN struct_pack(k := h || {times}[regexp_extract(r, '{dated}', 1)], v := trim(regexp_extract(r, '{dated}', 2)), st := 'confirmed')
  WHEN h = '' AND regexp_matches(bare, '{v.ASKED_FOR}') THEN struct_pack(k := 'patient_subject', v := {subjects}[regexp_extract(bare, '{v.ASKED_FOR}', 1)], st := 'confirmed') END AS d FROM x),
g AS (SELECT conv_id, turn, d.k AS fact, count(DISTINCT coalesce(d.v, chr(0)) || d.st) AS ways, max_by(d, s * 1000 + c) AS d, max_by(corrected, s * 1000 + c) AS corrected FROM d WHERE d IS NOT NULL GROUP BY ALL),
u AS (SELECT conv_id || '|' || fact AS key, row_number() OVER (PARTITION BY conv_id, fact ORDER BY turn) AS n, 'u' || turn AS turn, d.st AS status, d.v AS value, corrected FROM g WHERE ways = 1),
r AS (
  SELECT key, 0 AS n, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS turn, CAST([] AS VARCHAR[]) AS alts, 0 AS taken, 0 AS refused FROM (SELECT DISTINCT key FROM u)
  UNION ALL
  SELECT r.key, u.n, CASE WHEN refuse THEN r.status WHEN clash THEN 'conflict' ELSE u.status END, CASE WHEN refuse THEN r.value ELSE u.value END, CASE WHEN refuse THEN r.turn ELSE u.turn END,
    CASE WHEN refuse THEN r.alts WHEN clash THEN CASE WHEN list_contains(kept, u.value) THEN kept ELSE list_append(kept, u.value) END ELSE CAST([] AS VARCHAR[]) END, r.taken + CASE WHEN refuse THEN 0 ELSE 1 END, r.refused + CASE WHEN refuse THEN 1 ELSE 0 END
  FROM r JOIN u ON u.key = r.key AND u.n = r.n + 1, LATERAL (SELECT r.turn IS NOT NULL AND (r.status <> u.status OR r.value IS DISTINCT FROM u.value) AND NOT (u.corrected OR r.status = 'unknown') AS open) o,
    LATERAL (SELECT open AND u.status = 'unknown' AS refuse, open AND u.status <> 'unknown' AS clash, CASE WHEN r.status = 'conflict' THEN r.alts WHEN r.status = 'confirmed' THEN [r.value] ELSE CAST([] AS VARCHAR[]) END AS kept) k
)
SELECT key, status, value, turn AS turn_id, array_to_string(alts, ',') AS alternatives, CAST(taken AS BIGINT) AS taken, CAST(refused AS BIGINT) AS refused FROM r QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1
"""


@query(_visible_sql())
def visible_fact_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of conversations with what they declare, to the states of their facts."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    said = F.get(F.array(*[F.lit(x) for x in SAYINGS]), ((F.length("text") + F.col("turn")) % len(SAYINGS)).cast("int"))
    turns = c.select("conv_id", "turn", F.concat("text", F.lit("\n"), said).alias("text"))
    told, _ = V.observations(turns, "conv_id", "turn")
    key = F.concat_ws("|", F.col("conv_id").cast("string"), "fact")
    s = facts.observed(told.select(key.alias("key"), F.col("turn").alias("seq"), "value", "status", "corrected", F.concat(F.lit("u"), F.col("turn").cast("string")).alias("turn_id")))
    return s.select("key", "status", "value", "turn_id", F.array_join("alternatives", ",").alias("alternatives"), F.size("history").cast("long").alias("taken"), F.size("refused").cast("long").alias("refused"))
