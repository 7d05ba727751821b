"""Governance over the driver's tables: policies, materialised cases, partition decisions, gated exports, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import governance as gov
from quern.operators import trust

from .registry import Derived, query, table
from .text_plans import _DECIDED, _decisions

_SPLIT = "CASE p_partkey % 5 WHEN 0 THEN 'heldout' WHEN 1 THEN 'regression' ELSE 'dev' END"
_CASES = Derived("part", {"case_id": "CASE WHEN p_partkey % 97 = 3 THEN 'ｃase' ELSE concat('case-', CAST(p_partkey % 1500 AS STRING)) END", "split": "CASE WHEN p_partkey % 101 = 7 THEN 'other' ELSE " + _SPLIT + " END", "blob": "CASE WHEN p_partkey % 89 = 5 THEN NULL ELSE concat('b', CAST(p_partkey AS STRING)) END", "core": "concat(p_type, p_brand, CAST(p_size AS STRING))"})
_SOURCES = Derived("supplier", {"path": "concat('src/', CAST(s_suppkey AS STRING))", "case_id": "concat('source-', CAST(s_suppkey AS STRING))", "blob": "concat('b', CAST(s_suppkey + 2000000 * (s_suppkey % 2) AS STRING))", "core": "CASE WHEN s_suppkey % 3 = 0 THEN concat('ECONOMYBrand#', CAST(1 + s_suppkey % 25 AS STRING), CAST(s_suppkey % 50 AS STRING)) ELSE 'own' END"})


@query(
    f"""
WITH c AS ({_CASES.sql()}), s AS ({_SOURCES.sql()}), e AS (SELECT case_id, blob FROM c UNION ALL SELECT case_id, blob FROM s)
SELECT case_id AS entity, 'ID_NOT_CANONICAL' AS rule FROM c WHERE case_id = 'ｃase' UNION ALL SELECT case_id, 'UNKNOWN_SPLIT' FROM c WHERE split = 'other' UNION ALL SELECT case_id, 'MISSING_BLOB' FROM c WHERE blob IS NULL
UNION ALL SELECT case_id, 'REPEATED_ID' FROM e GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT blob, 'REPEATED_BLOB' FROM e WHERE blob IS NOT NULL GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT core, 'CORE_IN_SEVERAL_SPLITS' FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1 UNION ALL SELECT path, 'SOURCE_DERIVED_FROM_BENCHMARK' FROM s WHERE core IN (SELECT core FROM c)
"""
)
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.policy_violations(_CASES.rows(spark, sf_dir), _SOURCES.rows(spark, sf_dir))


_FILES = Derived("customer", {"path": "concat('fam/', CAST(c_custkey AS STRING), '.json')", "text": "c_name"}, "c_custkey % 10 <> 0")
_TRUSTED = Derived("customer", {"path": "CASE WHEN c_custkey % 17 = 0 THEN concat('fam/../', CAST(c_custkey AS STRING), '.json') ELSE concat('fam/', CAST(c_custkey AS STRING), '.json') END", "base": "'fam'", "blob_of": "CASE WHEN c_custkey % 7 = 0 THEN 'changed' ELSE c_name END"})
_BLOB = "sha1('blob ' || CAST(octet_length(encode({0})) AS VARCHAR) || chr(0) || {0})"


@query(
    f"""
WITH f AS (SELECT path, {_BLOB.format("text")} AS observed FROM ({_FILES.sql()})), t AS (SELECT path, {_BLOB.format("blob_of")} AS blob FROM ({_TRUSTED.sql()})), j AS (SELECT t.*, observed FROM t LEFT JOIN f USING (path))
SELECT path AS entity, 'OUTSIDE_FOLDER' AS rule FROM j WHERE contains(path, '..') UNION ALL SELECT path, 'FILE_MISSING' FROM j WHERE observed IS NULL UNION ALL SELECT path, 'BLOB_MISMATCH' FROM j WHERE observed <> blob
"""
)
def source_authentication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted entries against the files' own git hashes; paths that climb out of their folder."""
    entries = _TRUSTED.rows(spark, sf_dir).select("path", "base", X.git_blob_sha1(F.col("blob_of")).alias("blob"))
    return trust.authentication(entries, _FILES.rows(spark, sf_dir).select("path", F.col("text").cast("binary").alias("content")))


_REFS = Derived("part", {"case_id": "concat('p', CAST(p_partkey AS STRING))", "family_id": "p_brand", "split": _SPLIT, "variant_type": "p_type", "path": "concat(p_brand, '/', CAST(p_partkey AS STRING))", "size": "p_size"})


def _materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _REFS.rows(spark, sf_dir)
    cases = refs.select("path", F.concat(F.lit('{"size":'), F.col("size").cast("string"), F.lit(',"name":"x"}')).alias("case_json"))
    return trust.materialised(refs.drop("size"), cases, {"suite_id": "s1", "stage": "S5"}, ["dev"], ["heldout", "regression"])


_MATERIAL = f"""
WITH r AS ({_REFS.sql()}), k AS (SELECT *, '{{"size":' || size || ',"name":"x"}}' AS own, split = 'dev' AS ok FROM r),
m AS (SELECT case_id, family_id, split, variant_type, ok, sha256('{{"benchmark_provenance":{{"family_id":"' || family_id || '","source_case_path":"' || path || '","source_case_sha256":"' || sha256(own) || '","split":"' || split || '","stage":"S5","suite_id":"s1","training_eligible":' || CASE WHEN ok THEN 'true' ELSE 'false' END
  || ',"variant_type":"' || variant_type || '"}},"case":{{"name":"x","size":' || size || '}}}}') AS digest FROM k)
"""


@query(_MATERIAL + "SELECT case_id, split, ok AS training_eligible, digest AS payload_sha256 FROM m")
def materialised_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases bound to their provenance, with the digest of the canonical payload."""
    return _materialised(spark, sf_dir).select("case_id", "split", "training_eligible", "payload_sha256")


@query(_MATERIAL + "SELECT coalesce(split, 'ALL') AS split, count(*) AS cases, count(*) FILTER (WHERE ok) AS eligible, count(*) FILTER (WHERE NOT ok) AS blocked, count(DISTINCT family_id) AS families FROM m GROUP BY GROUPING SETS ((split), ())")
def materialisation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.materialisation_summary(_materialised(spark, sf_dir)).withColumn("split", F.coalesce("split", F.lit("ALL")))


@query(
    _MATERIAL
    + """, q AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 3 THEN 'x' || p_partkey ELSE 'p' || p_partkey END AS case_id, p_partkey % 6 = 1 AS changed, CASE WHEN p_partkey % 8 = 7 THEN 'dev' END AS declared FROM part)
SELECT q.case_id, m.split, CASE WHEN m.case_id IS NOT NULL THEN NOT changed AND ok ELSE declared IS NULL AND k % 12 = 3 AND NOT changed END AS eligible,
  CASE WHEN m.case_id IS NOT NULL THEN CASE WHEN changed THEN 'PAYLOAD_DIVERGES_FROM_AUTHORITY' WHEN NOT ok THEN 'SPLIT_IS_EVALUATION_ONLY' END WHEN declared IS NOT NULL THEN 'PARTITIONED_WITHOUT_AUTHORITY' WHEN k % 12 <> 3 THEN 'NO_AUTHORITY' WHEN changed THEN 'PAYLOAD_DIVERGES_FROM_SOURCE' END AS reason
FROM q LEFT JOIN m ON m.case_id = q.case_id
"""
)
def partition_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cases may be trained on: payloads equal to their authority, splits, ordinary sources."""
    made = _materialised(spark, sf_dir)
    k = F.col("p_partkey")
    asked = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.when(k % 4 == 3, "x").otherwise("p"), k.cast("string")).alias("case_id"), (k % 6 == 1).alias("changed"), F.when(k % 8 == 7, "dev").alias("declared_split"))
    plain = F.concat(F.lit('{"own":'), F.col("k").cast("string"), F.lit("}"))
    j = asked.join(made.select("case_id", "body"), "case_id", "left")
    payload = F.when(F.col("changed"), F.lit('{"other":1}')).otherwise(F.coalesce("body", plain))
    sources = asked.where("k % 12 = 3").select("case_id", trust.payload_digest(plain).alias("payload_sha256"))
    return trust.partition_decisions(j.select("case_id", payload.alias("payload"), "declared_split"), made, sources)


_EXPORTED = (
    _DECIDED
    + """, t AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations WHERE role <> 'system'),
cand AS (SELECT conv_id, turn, text, next_text, CASE conv_id % 3 WHEN 0 THEN 'preference' WHEN 1 THEN 'sft' ELSE CASE WHEN turn = 0 THEN 'none' ELSE 'sft' END END AS kind, length(text) >= 20 AS approved, CASE WHEN length(next_text) >= 40 THEN next_text END AS best, text AS rejected FROM t WHERE role = 'user' AND next_role = 'assistant'),
x AS (SELECT c.*, d.decision, CASE WHEN NOT approved THEN 'NOT_APPROVED' WHEN kind = 'none' THEN 'NO_KIND' WHEN d.decision IS NULL THEN 'NO_DECISION' WHEN d.decision = 'BLOCK' THEN 'LINEAGE_BLOCK' WHEN d.decision = 'REVIEW' THEN 'LINEAGE_REVIEW' WHEN best IS NULL THEN 'MISSING_IDEAL'
  WHEN kind = 'preference' AND rejected = best THEN 'MISSING_DIFFERENCE' END AS why FROM cand c LEFT JOIN decided d ON d.doc_id = c.conv_id)
"""
)


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w)).where("role = 'user' and next_role = 'assistant'")
    c = F.col("conv_id") % 3
    kind = F.when(c == 0, "preference").when(c == 1, "sft").otherwise(F.when(F.col("turn") == 0, "none").otherwise("sft"))
    cands = t.select(F.col("conv_id").alias("case_id"), "turn", F.col("text").alias("prompt"), kind.alias("kind"), F.when(F.length("text") >= 20, "approved").otherwise("pending").alias("review_status"), F.when(F.length("next_text") >= 40, F.col("next_text")).alias("ideal"), F.lit(None).cast("string").alias("chosen"), F.col("text").alias("rejected"))
    gate = _decisions(spark, sf_dir)[0].select(F.col("doc_id").alias("case_id"), "decision")
    return trust.export_rows(cands, gate)


@query(_EXPORTED + "SELECT conv_id, turn, kind, sha256(text) AS prompt_hash, sha256(best) AS chosen_hash, CASE WHEN kind = 'preference' THEN sha256(rejected) END AS rejected_hash FROM x WHERE why IS NULL")
def training_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT and preference rows of approved turns whose case the lineage gate allows."""
    x = _exports(spark, sf_dir).where("exported in ('sft', 'preference')")
    return x.select(F.col("case_id").alias("conv_id"), "turn", "kind", F.sha2("prompt", 256).alias("prompt_hash"), F.sha2(F.coalesce("ideal", "chosen"), 256).alias("chosen_hash"), F.when(F.col("kind") == "preference", F.sha2("rejected", 256)).alias("rejected_hash"))


@query(_EXPORTED + "SELECT CASE WHEN why IS NULL THEN kind WHEN why IN ('NOT_APPROVED', 'NO_KIND') THEN 'skipped' ELSE 'blocked' END AS exported, coalesce(why, '') AS why, count(*) AS n FROM x GROUP BY 1, 2")
def training_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trust.export_manifest(_exports(spark, sf_dir)).withColumn("why", F.coalesce("why", F.lit("")))


# ---- contracts as violations

_TRUTH = Derived("orders", {
    "event_id": "o_orderkey", "proposition": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'p' END", "subject_id": "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 's' END", "predicate": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'p' END", "object_id": "'o'",
    "effective_at": "CASE WHEN o_orderkey % 19 = 0 THEN '2024-13-01' ELSE '2024-01-05' END", "provenance": "CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'v' END", "source_id": "'s'", "passage_id": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'p' END", "locator": "'l'", "source_version": "'v'", "retrieved_at": "'t'",
    "s3_relation": "CASE WHEN o_orderkey % 7 = 0 THEN 'PARTIAL_SUPPORT' ELSE 'DIRECT_SUPPORT' END", "review_status": "CASE WHEN o_orderkey % 5 = 0 THEN 'draft' ELSE 'verified' END", "source_scope": "CASE WHEN o_orderkey % 11 = 0 THEN 'synthetic_controlled' END",
})


@query(
    f"""
WITH e AS ({_TRUTH.sql()})
SELECT event_id, CASE WHEN proposition IS NULL THEN 'MISSING_PROPOSITION' WHEN subject_id = '' THEN 'MISSING_SUBJECT_ID' WHEN predicate IS NULL THEN 'MISSING_PREDICATE' WHEN effective_at = '2024-13-01' THEN 'INVALID_EFFECTIVE_AT' WHEN provenance IS NULL THEN 'MISSING_PROVENANCE' WHEN passage_id IS NULL THEN 'MISSING_PROVENANCE_PASSAGE_ID'
  WHEN s3_relation <> 'DIRECT_SUPPORT' THEN 'S3_RELATION_NOT_DIRECT_SUPPORT' WHEN review_status = 'draft' THEN 'SOURCE_NOT_VERIFIED' WHEN source_scope IS NOT NULL THEN 'SYNTHETIC_PARTITION_VIOLATION' END AS reason FROM e
"""
)
def truth_event_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason to refuse a truth event, or null."""
    return _TRUTH.rows(spark, sf_dir).select("event_id", gov.truth_event_reason("external").alias("reason"))


_FAMILIES = Derived("part", {"family_id": "p_brand", "case_id": "CASE WHEN p_partkey % 50 = 1 THEN 'twice' ELSE CAST(p_partkey AS STRING) END", "variant_type": "CASE WHEN p_partkey % 5 = 0 OR p_partkey % 31 = 0 THEN 'heldout' ELSE 'base' END", "split": "CASE WHEN p_partkey % 5 = 0 THEN 'heldout' ELSE 'dev' END", "case_json": "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE '{}' END"}, "p_brand <> 'Brand#7'")


@query(
    f"""
WITH c AS ({_FAMILIES.sql()}), f AS (SELECT DISTINCT p_brand AS family_id FROM part)
SELECT case_id AS entity, 'FILE_MISSING' AS rule FROM c WHERE case_json IS NULL UNION ALL SELECT case_id, 'SPLIT_MISMATCH' FROM c WHERE (split = 'heldout') <> (variant_type = 'heldout') UNION ALL SELECT case_id, 'REPEATED_CASE' FROM c GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT family_id, 'NO_CASES' FROM f WHERE family_id NOT IN (SELECT family_id FROM c) UNION ALL SELECT family_id, 'NO_HELDOUT' FROM f WHERE family_id NOT IN (SELECT family_id FROM c WHERE split = 'heldout')
"""
)
def family_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = table(spark, sf_dir, "part").select(F.col("p_brand").alias("family_id")).distinct()
    return gov.family_violations(families, _FAMILIES.rows(spark, sf_dir))


@query(
    """
WITH s AS (SELECT page_id AS source_id, url FROM pages), c AS (SELECT event_id AS claim_id, user_id * 3 AS source_id, user_id AS passage_id FROM events), p AS (SELECT c_custkey AS passage_id, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'l' END AS locator FROM customer WHERE c_custkey % 4 <> 0),
h AS (SELECT source_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM s)
SELECT CAST(source_id AS VARCHAR) AS entity, 'HOST_NOT_ALLOWED' AS rule FROM h WHERE NOT (host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org'))
UNION ALL SELECT DISTINCT CAST(source_id AS VARCHAR), 'UNKNOWN_SOURCE' FROM c WHERE source_id NOT IN (SELECT source_id FROM s) UNION ALL SELECT DISTINCT CAST(passage_id AS VARCHAR), 'UNKNOWN_PASSAGE' FROM c WHERE passage_id NOT IN (SELECT passage_id FROM p)
UNION ALL SELECT CAST(passage_id AS VARCHAR), 'NO_LOCATOR' FROM p WHERE locator = ' '
"""
)
def source_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry's hosts, sources, passages and locators."""
    sources = table(spark, sf_dir, "pages").select(F.col("page_id").alias("source_id"), "url")
    claims = table(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), (F.col("user_id") * 3).alias("source_id"), F.col("user_id").alias("passage_id"))
    passages = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("passage_id"), F.when(F.col("c_custkey") % 9 == 0, " ").otherwise("l").alias("locator"))
    return gov.source_violations(sources, claims, passages, ["example.com", "example.org"])


@query(
    """
SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN false ELSE true END AS inside FROM supplier
"""
)
def path_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths that stay below their folder."""
    path = F.element_at(F.array(*[F.lit(p) for p in ("a/b.json", "../x", "a/../b", "a/../../b", "./c", "/etc/x", "a//b")]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", gov.inside_folder(F.lit("base"), path).alias("inside"))


@query("SELECT count(*) AS files, sha256(string_agg(sha256(s_name) || '  f' || s_suppkey, chr(10) ORDER BY sha256(s_name) || '  f' || s_suppkey)) AS aggregate FROM supplier")
def pinned_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of all pinned files."""
    return trust.aggregate_digest(table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), F.sha2("s_name", 256).alias("sha256")))
