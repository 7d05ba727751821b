"""Graphs, notes, retrieval, small readers of text and JSON, and ordered picks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import core, cues, extract, retrieval, review
from quern.operators import governance as gov

from .registry import Derived, query, table

# ---- notes: a supplier is a note that links to others

_NOTES = Derived("supplier", {
    "name": "concat('n', CAST(s_suppkey AS STRING))",
    "body": "concat('See [[n', CAST((s_suppkey * 7 + 3) % 150 AS STRING), ']] and [[old', CAST(s_suppkey % 5 AS STRING), '|the old one]], then [[gone]]. ', CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '[[n1#top]]' END)",
})


@query(
    f"""
WITH n AS ({_NOTES.sql()}), k AS (SELECT s_suppkey AS k, (s_suppkey * 7 + 3) % 150 AS t FROM supplier), m AS (SELECT count(*) AS n FROM supplier)
SELECT 'n' || k AS name, 'See ' || CASE WHEN t < m.n THEN '[[n' || t || ']]' ELSE 'n' || t END || ' and ' || CASE WHEN k % 5 < m.n THEN '[[n' || (k % 5) || '|the old one]]' ELSE 'the old one' END || ', then gone. ' || CASE WHEN k % 4 = 0 THEN '' ELSE '[[n1#top]]' END AS body FROM k, m
"""
)
def repaired_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wikilinks that follow renamed notes, and plain text for links to none."""
    renamed = spark.createDataFrame([(f"old{k}", f"n{k}") for k in range(5)], "old string, new string")
    return cues.links_repaired(_NOTES.rows(spark, sf_dir), renamed)


@query(
    f"""
WITH n AS ({_NOTES.sql()}), l AS (SELECT DISTINCT name AS a, trim(unnest(regexp_extract_all(body, '\\[\\[([^\\[\\]|#]+)', 1))) AS b FROM n), e AS (SELECT a, b FROM l WHERE b IN (SELECT name FROM n) AND a <> b), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT a, count(*) AS neighbours, min(b) AS first FROM s GROUP BY 1
"""
)
def note_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and backlinks between notes that exist."""
    notes = _NOTES.rows(spark, sf_dir)
    e = cues.links(notes).distinct().join(notes.select(F.col("name").alias("target")), "target", "left_semi").where("name <> target").select(F.col("name").alias("a"), F.col("target").alias("b"))
    return core.both_ways(e, "a", "b").groupBy("a").agg(F.count(F.lit(1)).alias("neighbours"), F.min("b").alias("first"))


#: What a concept's label tells of its type, first match first.
NODE_TYPES = [
    ("ENZYME", r"^(?:CYP|UGT)"), ("TRANSPORTER", r"P-GP|BCRP|OATP|OAT|OCT|MATE"), ("GENETIC_OR_PHENOTYPE_CONTEXT", r"^HLA-|METABOLIZER|GENOTYPE"),
    ("SAFETY_OUTCOME_OR_CONTEXT", r"BLEED|QT|RESPIRATORY|SEDATION|COMA|DEATH|HYPERSENSITIVITY|HYPOGLYC|SEROTONIN|LIVER DAMAGE"), ("SPECIAL_POPULATION_OR_ORGAN_CONTEXT", r"PREGNANC|LACTATION|REPRODUCTIVE|RENAL|HEPATIC"),
]
_LABELS = Derived("part", {"node": "p_partkey", "label": "concat(CASE p_partkey % 11 WHEN 0 THEN 'CYP3A' WHEN 1 THEN 'x-CYP' WHEN 2 THEN 'p-gp' WHEN 3 THEN 'HLA-B' WHEN 4 THEN 'poor metabolizer' WHEN 5 THEN 'coma' WHEN 6 THEN 'renal' WHEN 7 THEN 'Oct' WHEN 8 THEN 'ugt1' WHEN 9 THEN 'liver damage' ELSE 'drug' END, ' ', CAST(p_size AS STRING))"})


@query(
    f"""
WITH l AS ({_LABELS.sql()})
SELECT CASE node % 11 WHEN 0 THEN 'ENZYME' WHEN 8 THEN 'ENZYME' WHEN 2 THEN 'TRANSPORTER' WHEN 7 THEN 'TRANSPORTER' WHEN 3 THEN 'GENETIC_OR_PHENOTYPE_CONTEXT' WHEN 4 THEN 'GENETIC_OR_PHENOTYPE_CONTEXT' WHEN 5 THEN 'SAFETY_OUTCOME_OR_CONTEXT' WHEN 9 THEN 'SAFETY_OUTCOME_OR_CONTEXT'
  WHEN 6 THEN 'SPECIAL_POPULATION_OR_ORGAN_CONTEXT' ELSE 'DRUG_OR_CLINICAL_CONCEPT' END AS node_type, count(*) AS nodes, count(DISTINCT label) AS labels FROM l GROUP BY 1
"""
)
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = cues.node_type(F.upper("label"), NODE_TYPES, "DRUG_OR_CLINICAL_CONCEPT")
    return _LABELS.rows(spark, sf_dir).groupBy(kind.alias("node_type")).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("label").alias("labels"))


@query(
    """
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), mine AS (SELECT p FROM e WHERE s = 1),
x AS (SELECT s, count(*) AS shared, count(*) FILTER (WHERE p % 4 = 0) AS target, count(*) FILTER (WHERE p % 4 = 1) AS indication, count(*) FILTER (WHERE p % 4 = 2) AS modality, count(*) FILTER (WHERE p % 4 = 3) AS investor FROM e WHERE p IN (SELECT p FROM mine) AND s <> 1 GROUP BY 1),
y AS (SELECT *, s % 5 = 0 AS competitor, s % 6 = 0 AS licensing, s % 7 = 0 AS trial, s % 4 = 0 AS marketed FROM x),
z AS (SELECT *, least(1.0, target / 1.5) * 0.30 + least(1.0, indication / 1.5) * 0.25 + least(1.0, modality / 1.5) * 0.15 + least(1.0, investor / 1.5) * 0.10 + CASE WHEN licensing THEN 0.15 ELSE 0 END + CASE WHEN trial THEN 0.10 ELSE 0 END AS score FROM y)
SELECT 'supplier' || s AS entity, shared, round(CAST(score AS DOUBLE), 6) AS score, CASE WHEN round(score, 6) >= 0.75 THEN 'alert' WHEN round(score, 6) >= 0.5 THEN 'watch' WHEN round(score, 6) >= 0.4 THEN 'note' ELSE 'none' END AS level,
  CASE WHEN target > 0 AND indication > 0 THEN CASE WHEN marketed THEN 'DIRECT_COMMERCIAL_COMPETITOR' ELSE 'PIPELINE_COMPETITOR' END WHEN target > 0 THEN 'MECHANISTIC_NEIGHBOR+SHARED_TARGET' WHEN indication > 0 THEN 'MARKET_COMPETITOR' WHEN modality > 0 THEN 'SHARED_MODALITY'
    WHEN licensing THEN 'LICENSING_LINK' WHEN trial THEN 'TRIAL_OVERLAP' WHEN investor > 0 THEN 'SHARED_INVESTOR' ELSE 'COMMON_ECOSYSTEM' END AS first_type FROM z
"""
)
def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One supplier against all others by the parts they share: kinds, ties, types of relation, score, level."""
    l = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("b"), "l_partkey").distinct()
    kind = F.element_at(F.array(*[F.lit(k) for k in ("target", "indication", "modality", "investor")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    kinds = l.select(F.col("b").alias("node"), kind.alias("kind")).distinct()
    s = F.col("s_suppkey")
    ties = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier"), s.cast("string")).alias("entity"), (s % 5 == 0).alias("direct_competitor"), (s % 6 == 0).alias("licensing"), (s % 7 == 0).alias("trial"), (s % 4 == 0).alias("both_marketed"))
    found = retrieval.entity_overlap(l.select("a", "b"), kinds, "supplier1", ties).where(F.startswith("entity", F.lit("supplier")))  # parts are tied to it, too
    return found.select("entity", "shared", "score", "level", F.get("types", F.lit(0)).alias("first_type"))


@query(
    """
WITH k AS (SELECT DISTINCT 's' || l_suppkey AS subject, 'SUPPLIES' AS predicate, 'p' || l_partkey AS object FROM lineitem WHERE l_linenumber = 1), n AS (SELECT DISTINCT 's' || l_suppkey AS subject, 'SUPPLIES' AS predicate, 'p' || l_partkey AS object FROM lineitem WHERE l_linenumber = 2),
w AS (SELECT * FROM n UNION SELECT object, 'SUPPLIED_BY', subject FROM n), r AS (SELECT * FROM k UNION SELECT * FROM w)
SELECT predicate, count(*) AS relations, count(DISTINCT subject) AS subjects FROM r GROUP BY 1
"""
)
def relation_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New relations and their inverses; ingesting them twice changes nothing."""
    of = lambda n: table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") == n).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject"), F.lit("SUPPLIES").alias("predicate"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object")).distinct()
    once = gov.insert_relations(of(1), of(2), {"SUPPLIES": "SUPPLIED_BY"})
    twice = gov.insert_relations(once, of(2), {"SUPPLIES": "SUPPLIED_BY"})
    return twice.groupBy("predicate").agg(F.count(F.lit(1)).alias("relations"), F.countDistinct("subject").alias("subjects"))


@query(
    """
SELECT 'n' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'copy' WHEN c_custkey % 5 = 0 THEN 'conflict' ELSE 'identical' END AS action, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'n' || c_custkey || '-imported' ELSE 'n' || c_custkey END AS target FROM customer WHERE c_custkey % 2 = 0
"""
)
def vault_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("n"), k.cast("string")).alias("name")
    ours = c.where(k % 3 != 0).select(name, F.when(k % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("content"))
    return gov.merge_vaults(ours, c.where(k % 2 == 0).select(name, F.col("c_name").alias("content")))


@query(
    """
WITH e AS (SELECT o_orderkey, o_custkey AS entity, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_date FROM orders),
d AS (SELECT *, coalesce(try_strptime(event_date, '%Y-%m-%d'), try_strptime(event_date, '%Y-%m'), try_strptime(event_date, '%Y')) AS day FROM e WHERE entity % 4 = 0)
SELECT o_orderkey, event_date FROM d WHERE day IS NULL OR day >= TIMESTAMP '1997-06-01'
"""
)
def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of watched entities since a date; partial dates are their first day, unreadable ones stay."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    fmt = lambda f: F.date_format("o_orderdate", f)
    e = o.select("o_orderkey", F.col("o_custkey").alias("entity"), F.when(k % 5 == 0, fmt("yyyy-MM")).when(k % 5 == 1, fmt("yyyy")).when(k % 5 == 2, "soon").otherwise(fmt("yyyy-MM-dd")).alias("event_date"))
    watched = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity")).where("entity % 4 = 0").union(o.select("o_custkey").where("o_custkey % 4 = 0"))
    return gov.watch_events(e, watched, F.lit("1997-06-01").cast("timestamp")).select("o_orderkey", "event_date")


# ---- retrieval

_ASKED = Derived("nation", {"question_id": "n_nationkey", "question": "CASE n_nationkey % 4 WHEN 0 THEN concat('what of NATION_', CAST(n_nationkey AS STRING), ' and NATION_1?') WHEN 1 THEN concat('nation_', CAST(n_nationkey AS STRING)) WHEN 2 THEN 'nothing at all' ELSE concat('REGION of nation_', CAST(n_nationkey % 3 AS STRING)) END"})
_ENTITIES = "SELECT n_name AS entity FROM nation"


@query(
    f"""
WITH q AS (SELECT question_id, ' ' || trim(regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ' AS q FROM ({_ASKED.sql()})), e AS (SELECT entity, lower(entity) AS name FROM ({_ENTITIES})),
h AS (SELECT question_id, entity, CASE WHEN trim(q) = name THEN 100 ELSE 10 END AS score, length(name) AS l FROM q JOIN e ON contains(q, ' ' || name || ' ')), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, l DESC, entity DESC) = 1)
SELECT q.question_id, b.entity, CAST(b.score AS INTEGER) AS score FROM q LEFT JOIN b USING (question_id)
"""
)
def entity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity that a question names: equal, else the longest name in it."""
    e = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.lit(None).cast("string").alias("body"))
    return retrieval.find_entity(_ASKED.rows(spark, sf_dir), e)


@query(
    """
WITH s AS (SELECT c_nationkey AS doc_id, c_custkey AS position, c_mktsegment AS title, c_name || ' of ' || lower(c_mktsegment) AS text FROM customer), w(query_id, word) AS (VALUES (1, 'building'), (1, 'customer'), (2, 'machinery')), p(query_id, title) AS (VALUES (2, 'furniture')),
bag AS (SELECT *, list_filter(string_split(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '') AS tw, list_filter(string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' '), lambda x: x <> '') AS xw FROM s),
h AS (SELECT query_id, doc_id, position, title, sum(CASE WHEN list_contains(tw, word) THEN 4 ELSE 1 END) AS base FROM bag JOIN w ON list_contains(tw, word) OR list_contains(xw, word) GROUP BY 1, 2, 3, 4),
r AS (SELECT h.query_id, doc_id, h.title, base + CASE WHEN p.title IS NOT NULL THEN 6 ELSE 0 END AS score, row_number() OVER (PARTITION BY h.query_id ORDER BY base + CASE WHEN p.title IS NOT NULL THEN 6 ELSE 0 END DESC, doc_id, position) AS rank FROM h LEFT JOIN p ON p.query_id = h.query_id AND p.title = lower(h.title))
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, title, CAST(score AS INTEGER) AS score FROM r WHERE rank <= 3
"""
)
def section_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by words in their titles and texts, with preferred titles."""
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("position"), F.col("c_mktsegment").alias("title"), F.concat("c_name", F.lit(" of "), F.lower("c_mktsegment")).alias("text"))
    q = spark.createDataFrame([(1, ["building", "customer"]), (2, ["machinery"])], "query_id int, words array<string>")
    return retrieval.rank_sections(q, s, spark.createDataFrame([(2, "furniture")], "query_id int, title string"))


@query(
    """
WITH c AS (SELECT c_custkey AS case_id, unnest(['n' || (c_nationkey), 'n' || (c_nationkey + 3), 'n' || (c_nationkey + 1)]) AS id, unnest([1, 2, 3]) AS place FROM customer), j AS (SELECT c.*, n.n_name FROM c LEFT JOIN nation n ON 'n' || n.n_nationkey = id WHERE place <= 2)
SELECT case_id, string_agg(n_name, '|' ORDER BY place) AS evidence, count(*) FILTER (WHERE n_name IS NULL) AS missing FROM j GROUP BY 1
"""
)
def evidence_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two allowed passages of each case in order, with those that are missing."""
    n = F.col("c_nationkey")
    name = lambda d: F.concat(F.lit("n"), (n + d).cast("string"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.array(name(0), name(3), name(1)).alias("allowed"))
    passages = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("text"))
    found, bad = retrieval.inject_evidence(cases, passages, 2)
    gone = bad.groupBy("case_id").agg(F.count(F.lit(1)).alias("missing"))
    texts = F.filter("evidence", lambda x: x.isNotNull())
    return found.join(gone, "case_id", "left").select("case_id", F.when(F.size(texts) > 0, F.array_join(texts, "|")).alias("evidence"), F.coalesce("missing", F.lit(0)).alias("missing"))


# ---- JSON and text

_PROPS = "concat('{\"k\": ', CAST(event_id % 50 AS STRING), ', \"a\": {\"b\": [', CAST(user_id AS STRING), ', {\"c\": \"x', CAST(user_id AS STRING), '\"}]}}')"
_BODIES = Derived("events", {"event_id": "event_id", "body": f"CASE event_id % 6 WHEN 0 THEN 'no json' WHEN 1 THEN concat('Here: ```json\n', {_PROPS}, '\n``` done') WHEN 2 THEN concat('said ', {_PROPS}, ' so') WHEN 3 THEN NULL ELSE {_PROPS} END"})


@query(
    """
SELECT event_id, CASE WHEN event_id % 6 IN (0, 3) THEN NULL ELSE CAST(event_id % 50 AS VARCHAR) END AS k, CASE WHEN event_id % 6 IN (0, 3) THEN NULL ELSE 'x' || user_id END AS c, CAST(NULL AS VARCHAR) AS missing FROM events
"""
)
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON out of a model's words, and the scalars at a dotted path and at a pointer."""
    b = _BODIES.rows(spark, sf_dir).withColumn("j", cues.fenced_json(F.col("body")))
    at = lambda p: cues.json_at(F.col("j"), p)
    return b.select("event_id", at("k").alias("k"), at(cues.pointer_path("/a/b/1/c")).alias("c"), at("a.z.k").alias("missing"))


_STATUS = Derived("part", {"k": "p_partkey", "status": "CASE p_partkey % 8 WHEN 0 THEN '已上市' WHEN 1 THEN 'FDA Approved' WHEN 2 THEN 'NDA filed' WHEN 3 THEN 'Phase III' WHEN 4 THEN 'phase II, 受理中' WHEN 5 THEN 'Phase II' WHEN 6 THEN 'Phase I' ELSE 'none' END", "uses": "CASE p_partkey % 3 WHEN 0 THEN 'a/b、 a ;c' WHEN 1 THEN '' ELSE 'x；y' END"})


@query(
    """
SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'MARKETED' WHEN 1 THEN 'MARKETED' WHEN 2 THEN 'REGULATORY' WHEN 3 THEN 'PHASE3' WHEN 4 THEN 'REGULATORY' WHEN 5 THEN 'PHASE2' WHEN 6 THEN 'PHASE1' ELSE 'UNKNOWN' END AS stage, CASE p_partkey % 3 WHEN 0 THEN 'a,b,c' WHEN 1 THEN '' ELSE 'x,y' END AS parts FROM part
"""
)
def stage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _STATUS.rows(spark, sf_dir).select("k", cues.stage(F.col("status")).alias("stage"), F.array_join(F.array_sort(cues.parts_of(F.col("uses"))), ",").alias("parts"))


@query(
    """
SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'a.b=1,a.c=9,z=' || n_nationkey WHEN 1 THEN 'a.b=1,a.c=2' ELSE 'z=' || n_nationkey END AS merged FROM nation
"""
)
def merged_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template of dotted paths, patched, with paths dropped."""
    k = F.col("n_nationkey")
    base = F.create_map(F.lit("a.b"), F.lit("1"), F.lit("a.c"), F.lit("2"), F.lit("z"), k.cast("string"))
    patch = F.when(k % 3 == 0, F.create_map(F.lit("a.c"), F.lit("9"))).otherwise(F.create_map().cast("map<string,string>"))
    drop = F.when(k % 3 == 1, F.array(F.lit("z"))).when(k % 3 == 2, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    m = F.array_sort(F.map_entries(cues.merged(base, patch, drop)))
    return table(spark, sf_dir, "nation").select(k.alias("k"), F.array_join(F.transform(m, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))


@query(
    r"""
SELECT doc_id, 'EMAIL' AS rule FROM documents WHERE regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') UNION ALL SELECT doc_id, 'MOBILE' FROM documents WHERE regexp_matches(text, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])')
UNION ALL SELECT doc_id, 'LONG_NUMBER' FROM documents WHERE regexp_matches(text, '(^|[^0-9])[0-9]{17}[0-9Xx]($|[^0-9])') UNION ALL SELECT doc_id, 'SECRET' FROM documents WHERE regexp_matches(text, '(?i)(?:api[_-]?key|token|secret|password)\s*[:=]')
UNION ALL SELECT doc_id, 'LOCAL_PATH' FROM documents WHERE regexp_matches(text, '(?:/Users/|/home/|[A-Z]:\\\\)') UNION ALL SELECT doc_id, 'MISSING_LICENCE' FROM documents WHERE doc_id % 3 = 0
"""
)
def release_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that must not be released: private text, secrets, local paths, missing provenance."""
    d = table(spark, sf_dir, "documents").withColumn("licence", F.when(F.col("doc_id") % 3 == 0, "").otherwise("ok"))
    return cues.release_violations(d, "doc_id", "text", ["licence", "source"])


# ---- matrices, sets and ordered picks


@query("SELECT r_name AS model, count(*) AS cases, CAST(sum(n_nationkey * 10 + r_regionkey) AS BIGINT) AS seeds FROM nation CROSS JOIN region GROUP BY 1")
def case_model_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case with every model; both sides are short lists, and the models' size is checked."""
    m = core.matrix(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"))
    return m.groupBy(F.col("r_name").alias("model")).agg(F.count(F.lit(1)).alias("cases"), F.sum(F.col("n_nationkey") * 10 + F.col("r_regionkey")).alias("seeds"))


@query("SELECT p_type AS metric, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS failures, count(DISTINCT p_brand) AS n FROM part WHERE p_size > 40 GROUP BY 1")
def metric_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with their sorted distinct failures."""
    return core.sorted_sets(table(spark, sf_dir, "part").where("p_size > 40"), "p_type", "p_brand").select(F.col("p_type").alias("metric"), F.array_join("values", ",").alias("failures"), F.size("values").cast("long").alias("n"))


@query(
    r"""
WITH s AS (SELECT conv_id, sha256(string_agg(role || ':' || trim(regexp_replace(text, '\s+', ' ', 'g')), chr(10) ORDER BY turn)) AS signature FROM conversations GROUP BY 1), f AS (SELECT signature, min(conv_id) AS conv_id, count(*) AS copies FROM s GROUP BY 1)
SELECT signature, conv_id, copies FROM f ORDER BY signature LIMIT 50
"""
)
def unique_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty different dialogues by signature, each with its first copy."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("dialogue"), F.col("turn").alias("position"), "role", F.col("text").alias("sentence"), F.col("turn").alias("turn_id"))
    s = review.source_audit(t).groupBy("signature").agg(F.min("dialogue").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return s.orderBy("signature").limit(50)


@query(
    """
WITH f AS (SELECT o_custkey, o_orderpriority AS line, min(o_orderkey) AS place FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY place, line) AS n FROM f)
SELECT o_custkey, string_agg(line, '|' ORDER BY n) AS lines FROM r WHERE n <= 3 GROUP BY 1
"""
)
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three different lines of each customer, in order."""
    return cues.context_lines(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey", 3).select("o_custkey", F.array_join("lines", "|").alias("lines"))


@query("SELECT s_suppkey, 'b-' || substr(sha256('seed|' || s_suppkey), 1, 16) AS blind_id, sha256('identity|seed|' || s_suppkey) AS identity FROM supplier")
def blind_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.blind_packet(table(spark, sf_dir, "supplier"), "s_suppkey", "seed", 4).select("s_suppkey", "blind_id", "identity")


@query("SELECT o_custkey, o_orderkey, coalesce(v, lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)) AS carried FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS v FROM orders)")
def carried_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order without a value takes that of the customer's order just before, one step only."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("carried"))
    return extract.carried(o, "o_custkey", "o_orderkey", "carried")


@query("SELECT slug, count(*) AS n, min(edge) AS first_edge FROM (SELECT trim(regexp_replace(lower(trim(p_name || '!')), '[^a-z0-9]+', '_', 'g'), '_') AS slug, substr(sha1('e|' || p_name || '|MADE_BY|' || p_brand), 1, 16) AS edge FROM part) GROUP BY 1")
def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(X.slug(F.concat("p_name", F.lit("!"))).alias("slug"), X.edge_id(F.lit("e"), F.col("p_name"), F.lit("MADE_BY"), F.col("p_brand")).alias("edge"))
    return p.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("first_edge"))
