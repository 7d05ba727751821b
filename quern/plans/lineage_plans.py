"""The whole lineage detector over documents and made variants, against the benchmark as protected records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import concepts as C
from quern.functions import text as X
from quern.functions.scratch import scratch, stored
from quern.operators import lineage

from .registry import query, table

FIELDS = ["evidence_snapshot", "interaction", "scoring"]

#: A protected item's sentences, and what marks it: concepts, codes, numbers and a measured quantity.
_SENTENCES = "filter(transform(split(text, '[.!?\\n]+'), x -> trim(x)), x -> x <> '')"
_SENTENCES_DUCK = "list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: trim(x)), lambda x: x <> '')"
_JSON_DUCK = "'[' || array_to_string(list_transform({0}, lambda x: '\"' || replace(replace(x, '\\', '\\\\'), '\"', '\\\"') || '\"'), ',') || ']'"
_MARKS = "concat('item it-', CAST(item_id AS STRING), ' ab-77 unverified missing causal uncertain audit efficacy protocol deviation 12 345 ', CAST(item_id AS STRING))"
_LABS = "CASE item_id % 2 WHEN 0 THEN 'ALT 40' ELSE 'glucose 7' END"
#: Kinds of candidates made from an item: (kind, interaction, sentences kept (SQL on s, a list), labs, which items).
_MADE = [
    ("exact", _MARKS, "s", _LABS, "true"),
    ("field", "concat('another task ', CAST(item_id AS STRING))", "s", _LABS, "item_id % 2 = 0"),
    ("part", "concat('part task ', CAST(item_id AS STRING))", "s[1:1]", _LABS, "item_id % 3 = 0"),
    ("han", "concat('研究 it-', CAST(item_id AS STRING), ' 未经核实 缺失 因果')", "[]", "NULL", "item_id % 2 = 1"),
    ("hangul", "'시험 미확인 누락 인과 불확실 판정'", "[]", "NULL", "item_id % 4 = 0"),
    ("terms", "concat('未经核实 缺失 因果 不确定 审计 临床疗效 方案偏离 12 345 ', CAST(item_id AS STRING))", "[]", "NULL", "item_id % 5 = 0"),
    ("plain", "concat('weather number ', CAST(item_id AS STRING))", "[]", "'eeg'", "true"),
]


def _spark_rows(df: DataFrame, kind: str, interaction: str, kept: str, labs: str, where: str, key: str) -> DataFrame:
    own = df.where(where).withColumn("s", F.expr(_SENTENCES))
    some = {"s": F.col("s"), "s[1:1]": F.slice("s", 1, 1), "[]": F.array().cast("array<string>")}[kept]
    snapshot = F.when(F.size("__k") > 0, F.concat(F.lit("["), F.array_join(F.transform("__k", lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ","), F.lit("]")))
    return own.withColumn("__k", some).select(F.concat(F.lit(f"{kind}-"), F.col(key).cast("string")).alias("case_id"), snapshot.alias("evidence_snapshot"), F.expr(interaction).alias("interaction"), F.lit(None).cast("string").alias("scoring"), F.expr(labs).cast("string").alias("labs"))


def _duck_rows(name: str, kind: str, interaction: str, kept: str, labs: str, where: str, key: str) -> str:
    some = {"s": "s", "s[1:1]": "s[1:1]", "[]": "CAST([] AS VARCHAR[])"}[kept]
    return (
        f"SELECT '{kind}-' || {key} AS case_id, CASE WHEN len({some}) > 0 THEN {_JSON_DUCK.format(some)} END AS evidence_snapshot, {interaction} AS interaction, CAST(NULL AS VARCHAR) AS scoring, CAST({labs} AS VARCHAR) AS labs "
        f"FROM (SELECT *, {_SENTENCES_DUCK} AS s FROM {name}) WHERE {where}"
    )


_DOC = ("doc", "concat(lang, ' ', source)", "s", "NULL", "true")
_REFERENCE = ("ref", _MARKS, "s", _LABS, "true")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, references, allowed): documents of good quality with even ids are allowed, whatever they hold; the others are candidates."""
    docs, items, labels = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "labels"))
    good = labels.where("quality = 1 AND doc_id % 2 = 0").select("doc_id").distinct()
    as_rows = lambda df: _spark_rows(df, *_DOC, "doc_id")
    cands = as_rows(docs.join(good, "doc_id", "left_anti"))
    for made in _MADE:
        cands = cands.unionByName(_spark_rows(items, *made, "item_id"))
    return cands, _spark_rows(items, *_REFERENCE, "item_id"), as_rows(docs.join(good, "doc_id", "left_semi"))


def _full_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in X.STOPWORDS)
    form = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ' ', 'g'))"
    content = "list_distinct(list_filter(string_split({0}, ' '), lambda x: x NOT IN (" + stop + ") AND (length(x) >= 4 OR regexp_matches(x, '\\p{{Nd}}'))))"
    dice = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"
    blend = lambda a, b: f"round(0.58 * {dice(f'{a}.words', f'{b}.words')} + 0.42 * {dice(f'{a}.grams', f'{b}.grams')}, 6)"
    phrases = ", ".join(f"('{name}', '{C._form(p)}')" for name, ps in C.CONCEPTS.items() for p in ps)
    spanish = " + ".join(f"CAST(contains(f, '{w}') AS INT)" for w in C.SPANISH)
    lang = f"CASE WHEN regexp_matches(f, '[\\x{{ac00}}-\\x{{d7af}}]') THEN 'ko' WHEN regexp_matches(f, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'ja' WHEN regexp_matches(f, '[\\x{{3400}}-\\x{{9fff}}]') THEN 'zh' WHEN {spanish} >= 2 THEN 'es' ELSE 'en' END"
    roles = "list_filter([CASE WHEN regexp_matches(labs, '(?i)\\balt\\b') THEN 'hepatic_enzyme' END, CASE WHEN regexp_matches(labs, '(?i)\\bglucose\\b') THEN 'glucose' END, CASE WHEN regexp_matches(labs, '(?i)\\beeg\\b') THEN 'neurophysiology' END], lambda x: x IS NOT NULL)"
    part = lambda f: f"'{f} ' || coalesce({form.format(f)}, 'null')"
    good = "SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 2 = 0"
    cands = " UNION ALL ".join([_duck_rows(f"(SELECT * FROM documents WHERE doc_id NOT IN ({good}))", *_DOC, "doc_id"), *[_duck_rows("benchmark", *m, "item_id") for m in _MADE]])
    texts = """from_json(evidence_snapshot, '["VARCHAR"]')"""
    leaves = lambda t: (
        f"SELECT case_id, 'evidence_snapshot' AS field, {form.format('s')} AS span, '[' || (k - 1) || ']' AS path FROM (SELECT case_id, unnest({texts}) AS s, generate_subscripts({texts}, 1) AS k FROM {t}) "
        f"UNION ALL SELECT case_id, 'interaction', {form.format('interaction')}, '' FROM {t}"
    )
    long_enough = "length(span) >= 30 AND len(string_split(span, ' ')) >= 5"
    review = "(rec >= 0.70 AND n > 0) OR (near >= 1 AND n > 0) OR span_anchored OR (n >= 2 AND rec >= 0.52)"
    strong = "(rec >= 0.70 AND n > 0) OR (near >= 2 AND n > 0) OR span_anchored OR (n >= 8 AND rec >= 0.52)"
    return f"""
WITH cand AS ({cands}), ref AS ({_duck_rows("benchmark", *_REFERENCE, "item_id")}), free AS ({_duck_rows(f"(SELECT * FROM documents WHERE doc_id IN ({good}))", *_DOC, "doc_id")}),
p(concept, phrase) AS (VALUES {phrases}),
rows AS (SELECT 'c' AS side, * FROM cand UNION ALL SELECT 'r', * FROM ref UNION ALL SELECT 'a', * FROM free),
f0 AS (SELECT side, case_id, labs, evidence_snapshot, interaction, {part("evidence_snapshot")} || ' ' || {part("interaction")} || ' ' || {part("scoring")} AS f1 FROM rows),
f AS (SELECT *, trim(regexp_replace(f1, ' +', ' ', 'g')) AS f FROM f0),
con AS (SELECT side, case_id, list(DISTINCT concept) AS concepts FROM f JOIN p ON contains(f, phrase) WHERE side <> 'a' GROUP BY 1, 2),
w AS (SELECT f.side, f.case_id, f, {content.format("f")} AS content, {lang} AS lang, {roles} AS roles, list_distinct(list_filter(string_split(f, ' '), lambda x: regexp_full_match(x, '[0-9]+'))) AS numbers, coalesce(con.concepts, []) AS concepts,
  list_distinct(regexp_extract_all(lower(coalesce(evidence_snapshot, '') || ' ' || interaction), '\\b[a-z][a-z0-9]{{1,20}}-[a-z0-9]{{1,20}}\\b')) AS ids FROM f LEFT JOIN con ON con.side = f.side AND con.case_id = f.case_id),
c AS (SELECT * FROM w WHERE side = 'c'), r AS (SELECT * FROM w WHERE side = 'r'), a AS (SELECT * FROM w WHERE side = 'a'),
known AS (SELECT DISTINCT unnest(content) AS word FROM a), known_ids AS (SELECT DISTINCT unnest(ids) AS id FROM a),
ranch AS (SELECT case_id, word FROM (SELECT case_id, unnest(content) AS word FROM r) WHERE word NOT IN (SELECT word FROM known)), rall AS (SELECT case_id, count(*) AS total FROM ranch GROUP BY 1),
rids AS (SELECT case_id, id FROM (SELECT case_id, unnest(ids) AS id FROM r) WHERE id NOT IN (SELECT id FROM known_ids)),
cl AS (SELECT DISTINCT * FROM ({leaves("cand")}) WHERE {long_enough}), rl AS (SELECT DISTINCT * FROM ({leaves("ref")}) WHERE {long_enough}), al AS (SELECT DISTINCT field, span FROM ({leaves("free")}) WHERE {long_enough}),
rs AS (SELECT * FROM rl WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.field = rl.field AND al.span = rl.span)),
rsw AS (SELECT case_id, field, path, list(word) AS anchors FROM (SELECT case_id, field, path, unnest({content.format("span")}) AS word FROM rs) WHERE word NOT IN (SELECT word FROM known) GROUP BY 1, 2, 3),
rsa AS (SELECT rs.case_id, rs.field, rs.path, rs.span, coalesce(rsw.anchors, []) AS anchors FROM rs LEFT JOIN rsw ON rsw.case_id = rs.case_id AND rsw.field = rs.field AND rsw.path = rs.path),
fields AS (SELECT side, case_id, 'evidence_snapshot' AS field, {form.format("evidence_snapshot")} AS form FROM f WHERE evidence_snapshot IS NOT NULL UNION ALL SELECT side, case_id, 'interaction', {form.format("interaction")} FROM f),
rf AS (SELECT case_id, field, form FROM fields x WHERE side = 'r' AND NOT EXISTS (SELECT 1 FROM fields y WHERE y.side = 'a' AND y.field = x.field AND y.form = x.form)),
by_anchor AS (SELECT c.case_id AS ci, ranch.case_id AS ri, count(*) AS n FROM (SELECT case_id, unnest(content) AS word FROM c) c JOIN ranch USING (word) GROUP BY 1, 2),
by_id AS (SELECT c.case_id AS ci, rids.case_id AS ri, count(*) AS nid FROM (SELECT case_id, unnest(ids) AS id FROM c) c JOIN rids USING (id) GROUP BY 1, 2),
sp AS (SELECT cl.case_id AS ci, rsa.case_id AS ri, cl.span AS cs, rsa.span AS rsp, rsa.anchors, list_has_any(anchors, {content.format("cl.span")}) AS shares FROM cl JOIN rsa ON cl.field = rsa.field AND (cl.span = rsa.span OR list_has_any(rsa.anchors, {content.format("cl.span")}))),
tx0 AS (SELECT t, string_split(t, '') AS ch FROM (SELECT f AS t FROM w WHERE side <> 'a' UNION SELECT form FROM fields WHERE side <> 'a' UNION SELECT span FROM cl UNION SELECT span FROM rsa)),
tx AS MATERIALIZED (SELECT t, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS words, CASE WHEN length(t) = 0 THEN [] WHEN len(ch) <= 4 THEN [t] ELSE list_distinct(list_transform(range(1, len(ch) - 2), lambda i: ch[i] || ch[i + 1] || ch[i + 2] || ch[i + 3])) END AS grams FROM tx0),
sps AS (SELECT ci, ri, shares, CASE WHEN cs = rsp THEN 1.0 ELSE {blend("x", "y")} END AS sim FROM sp JOIN tx x ON x.t = cs JOIN tx y ON y.t = rsp),
by_span AS (SELECT ci, ri, max(sim) AS max_span, count(*) AS spans, bool_or(sim >= 0.95 AND (sim = 1.0 OR shares)) AS span_blocks, bool_or(shares) AS span_anchored FROM sps WHERE sim >= 0.82 GROUP BY 1, 2),
by_exact AS (SELECT DISTINCT x.case_id AS ci, rf.case_id AS ri FROM fields x JOIN rf ON x.side = 'c' AND x.field = rf.field AND x.form = rf.form),
by_concept AS (SELECT c.case_id AS ci, r.case_id AS ri FROM c JOIN r ON c.lang <> r.lang AND len(list_intersect(c.concepts, r.concepts)) >= 3),
found AS (SELECT ci, ri FROM by_anchor UNION SELECT ci, ri FROM by_id UNION SELECT ci, ri FROM by_span UNION SELECT ci, ri FROM by_exact UNION SELECT ci, ri FROM by_concept),
pf AS (SELECT found.ci, found.ri, z.form = rf.form AS same, CASE WHEN z.form = rf.form THEN 1.0 ELSE {blend("x", "y")} END AS s
  FROM found JOIN rf ON rf.case_id = found.ri JOIN fields z ON z.side = 'c' AND z.case_id = found.ci AND z.field = rf.field JOIN tx x ON x.t = z.form JOIN tx y ON y.t = rf.form),
by_field AS (SELECT ci, ri, max(s) AS max_field, count(*) FILTER (WHERE same) AS exact, count(*) FILTER (WHERE s >= 0.90) AS near FROM pf GROUP BY 1, 2),
j0 AS (SELECT found.ci, found.ri, c.f AS cf, r.f AS rf, coalesce(n, 0) AS n, coalesce(nid, 0) AS nid, coalesce(max_span, 0) AS max_span, coalesce(spans, 0) AS spans,
  coalesce(span_blocks, false) AS span_blocks, coalesce(span_anchored, false) AS span_anchored, coalesce(max_field, 0) AS max_field, coalesce(exact, 0) AS exact, coalesce(near, 0) AS near, coalesce(total, 1) AS total,
  c.lang AS cl, r.lang AS rlang, len(list_intersect(c.concepts, r.concepts)) AS nc, len(list_intersect(c.numbers, r.numbers)) AS nn, len(list_intersect(list_intersect(c.concepts, r.concepts), ['missing_evidence', 'causal_attribution', 'uncertainty'])) AS nb,
  len(c.roles) > 0 AND len(r.roles) > 0 AND NOT list_has_any(c.roles, r.roles) AS conflict
  FROM found JOIN c ON c.case_id = ci JOIN r ON r.case_id = ri LEFT JOIN by_anchor USING (ci, ri) LEFT JOIN by_id USING (ci, ri) LEFT JOIN by_span USING (ci, ri) LEFT JOIN by_field USING (ci, ri) LEFT JOIN rall ON rall.case_id = ri),
j AS (SELECT j0.*, CASE WHEN cf = rf THEN 1.0 ELSE {blend("x", "y")} END AS rec, cl <> rlang AS crossing FROM j0 JOIN tx x ON x.t = cf JOIN tx y ON y.t = rf),
d AS (SELECT *, list_filter([CASE WHEN cf = rf THEN 'EXACT_SEMANTIC_CORE' END, CASE WHEN exact > 0 THEN 'PROTECTED_EXCLUSIVE_FIELD_REUSE' END, CASE WHEN span_blocks THEN 'PROTECTED_EXCLUSIVE_SPAN_REUSE' END, CASE WHEN rec >= 0.88 AND n > 0 THEN 'ANCHORED_HIGH_RECORD_NEAR_DUPLICATE' END,
  CASE WHEN near >= 2 AND rec >= 0.62 AND n > 0 THEN 'ANCHORED_MULTI_FIELD_NEAR_REUSE' END, CASE WHEN n >= 3 AND rec >= 0.62 THEN 'DENSE_PROTECTED_ANCHOR_REUSE' END], lambda x: x IS NOT NULL) AS own,
  round(least(1.0, greatest(rec, 0.92 * max_field, 0.96 * max_span, CASE WHEN n > 0 THEN 0.62 + 0.25 * n / greatest(1, total) ELSE 0 END)), 6) AS risk0,
  crossing AND (nid >= 2 OR (nid > 0 AND nc >= 3) OR (nc >= 7 AND nn >= 2)) AS across, crossing AND cl = 'ko' AND nc >= 5 AND nb >= 2 AS script FROM j),
e AS (SELECT *, list_concat(own, list_filter([CASE WHEN across THEN 'MULTILINGUAL_SEMANTIC_LINEAGE_REUSE' END, CASE WHEN script THEN 'SCRIPT_SEMANTIC_LINEAGE_REUSE' END], lambda x: x IS NOT NULL)) AS reasons0,
  CASE WHEN across OR script THEN greatest(risk0, 0.94) ELSE risk0 END AS risk, CASE WHEN across OR script OR len(own) > 0 THEN 'BLOCK' WHEN ({review}) AND ({strong}) THEN 'REVIEW' ELSE 'ALLOW' END AS decision0 FROM d),
full_pairs AS (SELECT ci AS candidate_id, ri AS reference_id, rec AS record_similarity, risk, n AS n_anchors, nid AS shared_ids, nc AS shared_concepts, spans, max_span, max_field,
  conflict AND decision0 = 'BLOCK' AND reasons0 = ['DENSE_PROTECTED_ANCHOR_REUSE'] AND nid = 0 AND exact = 0 AND near = 0 AS typed, script, CASE WHEN conflict AND decision0 = 'BLOCK' AND reasons0 = ['DENSE_PROTECTED_ANCHOR_REUSE'] AND nid = 0 AND exact = 0 AND near = 0 THEN 'ALLOW' ELSE decision0 END AS decision,
  array_to_string(CASE WHEN conflict AND decision0 = 'BLOCK' AND reasons0 = ['DENSE_PROTECTED_ANCHOR_REUSE'] AND nid = 0 AND exact = 0 AND near = 0 THEN ['TYPED_MEASUREMENT_ROLE_MISMATCH'] ELSE list_sort(reasons0) END, ',') AS reasons FROM e)
"""


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cands, refs, free = _tables(spark, sf_dir)
    return cands, stored(lineage.pairs(cands, refs, free, FIELDS, labs="labs"), scratch(spark, "scored"))


@query(_full_sql() + "SELECT candidate_id, reference_id, record_similarity, risk, decision, reasons, n_anchors, shared_ids, shared_concepts, spans, round(max_span, 6) AS max_span, round(max_field, 6) AS max_field FROM full_pairs")
def lineage_pairs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and variants made from items, each against every item it has evidence with: all reasons of the detector."""
    s = _scored(spark, sf_dir)[1]
    n = lambda c: F.size(c).cast("long")
    return s.select(
        "candidate_id", "reference_id", "record_similarity", "risk", "decision", F.array_join("reasons", ",").alias("reasons"), F.col("n_anchors").cast("long").alias("n_anchors"), n("shared_ids").alias("shared_ids"), n("shared_concepts").alias("shared_concepts"),
        "spans", F.round("max_span", 6).alias("max_span"), F.round("max_field", 6).alias("max_field"),
    )


@query(
    _full_sql()
    + """, best AS (SELECT * FROM full_pairs QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY CASE decision WHEN 'BLOCK' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END DESC, risk DESC, record_similarity DESC, reference_id) = 1),
mosaic AS (SELECT candidate_id FROM full_pairs WHERE record_similarity >= 0.52 AND n_anchors >= 8 GROUP BY 1 HAVING count(*) >= 2 AND sum(n_anchors) >= 16)
SELECT c.case_id AS candidate_id, CASE WHEN coalesce(b.decision, 'ALLOW') <> 'ALLOW' THEN b.reference_id END AS nearest_reference_id, CASE WHEN m.candidate_id IS NOT NULL THEN 'BLOCK' ELSE coalesce(b.decision, 'ALLOW') END AS decision,
  CASE WHEN m.candidate_id IS NOT NULL THEN greatest(0.96, b.risk) ELSE coalesce(b.risk, 0) END AS risk, m.candidate_id IS NOT NULL AS mosaic FROM cand c LEFT JOIN best b ON b.candidate_id = c.case_id LEFT JOIN mosaic m ON m.candidate_id = c.case_id
"""
)
def lineage_decisions_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands, scored = _scored(spark, sf_dir)
    d = lineage.decisions(cands, scored)
    return d.select("candidate_id", "nearest_reference_id", "decision", "risk", F.array_contains("reasons", "MULTI_PROTECTED_REFERENCE_MOSAIC").alias("mosaic"))


@query(
    _full_sql()
    + """, k AS (SELECT regexp_extract(c.case_id, '^[a-z]+') AS kind, coalesce(max(CASE p.decision WHEN 'BLOCK' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END), 0) AS worst FROM cand c LEFT JOIN full_pairs p ON p.candidate_id = c.case_id GROUP BY c.case_id)
SELECT kind, count(*) AS candidates, count(*) FILTER (WHERE worst = 2) AS blocked, count(*) FILTER (WHERE worst = 1) AS review, round(count(*) FILTER (WHERE worst = 2) / count(*), 6) AS block_rate FROM k GROUP BY 1
"""
)
def lineage_by_transformation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection by the way in which a candidate was made from a protected record."""
    cands, scored = _scored(spark, sf_dir)
    worst = scored.groupBy("candidate_id").agg(F.max(F.when(F.col("decision") == "BLOCK", 2).when(F.col("decision") == "REVIEW", 1).otherwise(0)).alias("w"))
    j = cands.select(F.col("case_id").alias("candidate_id")).join(worst, "candidate_id", "left").withColumn("kind", F.regexp_extract("candidate_id", "^[a-z]+", 0))
    g = j.groupBy("kind").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("w") == 2).alias("blocked"), F.count_if(F.col("w") == 1).alias("review"))
    return g.withColumn("block_rate", F.round(F.col("blocked") / F.col("candidates"), 6))
