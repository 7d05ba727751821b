"""Audits over pages and conversations: claims by the tier of their source, and counters of dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import audits

from .registry import query, table

_TIERS = [("VERIFIED", ["example.org"]), ("SUPPORTED", ["example.net", "example.org"]), ("INFERRED", ["example.com"])]
_LEVELS = [*[level for level, _ in _TIERS], audits.UNSUPPORTED]
_TIER_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(u, {chr(39)}{n}{chr(39)})' for n in names)} THEN '{level}'" for level, names in _TIERS)


@query(
    f"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS li FROM pages),
c AS (SELECT page_id, regexp_extract(regexp_extract(li, 'href="([^"]*)"', 1), '^https?://[^\\s）)]+') AS u FROM l WHERE trim(regexp_replace(li, '<[^>]*>', '', 'g')) <> ''),
v AS (SELECT page_id, CASE WHEN u = '' THEN 'UNSUPPORTED' ELSE {_TIER_SQL} ELSE 'UNSUPPORTED' END END AS level FROM c)
SELECT page_id, count(*) AS claims, {", ".join(f"count(*) FILTER (WHERE level = '{x}') AS {x.lower()}" for x in _LEVELS)}, round(count(*) FILTER (WHERE level = 'UNSUPPORTED') / count(*), 6) AS unsupported_rate FROM v GROUP BY ROLLUP (page_id)
"""
)
def claim_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of pages as notes of claims with their links as sources: levels by page and over all."""
    items = F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1))
    line = F.transform(items, lambda x: F.concat(F.lit("- "), F.trim(F.regexp_replace(x, "<[^>]*>", "")), F.lit(" 来源: "), F.regexp_extract(x, 'href="([^"]*)"', 1)))
    full = F.filter(line, lambda x: ~F.startswith(x, F.lit("-  ")))
    notes = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("name"), F.concat(F.lit("intro\n- none\n## 关系\n"), F.array_join(full, "\n"), F.lit("\n## end\n- none")).alias("body"))
    g = audits.claim_levels(audits.claims(notes, _TIERS), _LEVELS)
    return g.select(F.col("name").cast("long").alias("page_id"), "claims", *[x.lower() for x in _LEVELS], F.round("unsupported_rate", 6).alias("unsupported_rate"))


@query(
    r"""
WITH t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) % 3 AS kind FROM conversations),
r AS (SELECT *, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'invalid' END AS known, CASE WHEN before IN ('user', 'assistant') THEN before ELSE 'invalid' END AS known_before FROM t),
d AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE s = '') AS empty, count(*) FILTER (WHERE known = 'invalid') AS invalid, count(*) - count(DISTINCT turn) AS twice, count(*) FILTER (WHERE k > 1 AND known = known_before AND known <> 'invalid') AS adjacent,
  count(*) FILTER (WHERE kind = 0) AS listed, count(*) FILTER (WHERE kind = 1) AS none, min_by(known, k) AS first, max_by(known, k) AS last, string_agg(known || ':' || s, chr(10) ORDER BY k) AS sig, bool_and(known <> 'invalid' AND s <> '') AND count(*) = count(DISTINCT turn) AS good FROM r GROUP BY 1),
o AS (SELECT count(*) AS dialogues, sum(turns) AS turns, sum(empty) AS empty, sum(invalid) AS invalid, sum(twice) AS twice, sum(adjacent) AS adjacent, count(*) FILTER (WHERE adjacent > 0) AS with_adjacent, sum(listed) AS listed, sum(none) AS none, count(*) FILTER (WHERE good) AS usable, count(DISTINCT sig) FILTER (WHERE good) AS uniq FROM d)
SELECT counter, CAST(n AS BIGINT) AS n FROM (
  SELECT 'dialogues' AS counter, dialogues AS n FROM o UNION ALL SELECT 'turns', turns FROM o UNION ALL SELECT 'empty_sentences', empty FROM o UNION ALL SELECT 'invalid_roles', invalid FROM o UNION ALL SELECT 'duplicate_turn_ids', twice FROM o UNION ALL SELECT 'adjacent_same_role_pairs', adjacent FROM o
  UNION ALL SELECT 'dialogues_with_adjacent_same_role', with_adjacent FROM o UNION ALL SELECT 'actions_present_turns', listed + none FROM o UNION ALL SELECT 'actions_nonempty_turns', listed FROM o UNION ALL SELECT 'actions_empty_turns', none FROM o UNION ALL SELECT 'actions_missing_or_nonlist_turns', turns - listed - none FROM o
  UNION ALL SELECT 'action_entries', 2 * listed FROM o UNION ALL SELECT 'nondict_action_entries', 2 * listed FROM o UNION ALL SELECT 'exact_normalized_duplicate_dialogues', usable - uniq FROM o UNION ALL SELECT 'schema_usable_unique_dialogues', uniq FROM o
  UNION ALL SELECT unnest(['malformed_dialogues', 'malformed_turns', 'empty_dialogues', 'missing_dialogue_ids', 'missing_turn_ids', 'duplicate_dialogue_ids', 'message_nonempty_turns']), 0
  UNION ALL SELECT 'role:' || x, (SELECT count(*) FROM r WHERE known = x) FROM (SELECT unnest(['user', 'assistant', 'invalid']) AS x) UNION ALL SELECT 'first_role:' || x, (SELECT count(*) FROM d WHERE first = x) FROM (SELECT unnest(['user', 'assistant', 'invalid']) AS x)
  UNION ALL SELECT 'last_role:' || x, (SELECT count(*) FROM d WHERE last = x) FROM (SELECT unnest(['user', 'assistant', 'invalid']) AS x))
"""
)
def dialogue_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dialogues in JSON, a third of whose turns list two actions, a third none, and a third aren't lists."""
    kind = F.length("text") % 3
    actions = F.when(kind == 0, F.array(F.lit("ask"), F.lit("tell"))).when(kind == 1, F.array().cast("array<string>"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("sentence"), actions.alias("actions"))))
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("information"))
    return audits.dialogue_audit(d.select(F.col("conv_id").alias("position"), F.to_json(F.struct(F.col("conv_id").alias("dialogue"), "information")).alias("body")), roles=("user", "assistant"))
