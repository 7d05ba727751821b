"""The registered queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, linededup, merkle, minhash, mixing, packing, preference, topk, toxicity, urlfilter, warc, whitening
from .common import table

FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(b)) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT h.page_id, h.payload_bytes, h.payload_digest, CASE WHEN f.first IS NULL OR f.first = h.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first <> h.page_id THEN f.first END AS refers_to
FROM h LEFT JOIN f ON f.payload_digest = h.payload_digest AND h.payload_bytes >= 100
"""
)
def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder, parts = warc.archive(pages)
    keys = pages.select(warc.key_of(F.col("url"), F.col("page_id")).alias("key"))
    return warc.fetch(warc.lookup(keys, parts, folder), folder).drop("url")


@query()
def op2_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model).withColumn("held_out", ~toxicity.may_train(F.col("doc_id")))
    return found.select("doc_id", "held_out", "score", "predicted")


@query(
    """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents
), nb AS (
  SELECT doc_id, no, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k
  FROM l WHERE trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''
), w AS (
  SELECT doc_id, k, line AS a, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY k) AS b, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM nb
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, k) AS r FROM w WHERE c IS NOT NULL) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, k + j AS k FROM later, (VALUES (0), (1), (2)) v(j)),
removed AS (SELECT nb.doc_id, nb.no FROM nb JOIN gone USING (doc_id, k)),
kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.raw, chr(10) ORDER BY l.no), '') AS text FROM l LEFT JOIN removed r USING (doc_id, no) WHERE r.no IS NULL GROUP BY 1
)
SELECT d.doc_id, (SELECT count(*) FROM nb WHERE nb.doc_id = d.doc_id) AS n_lines,
  (SELECT count(*) FROM removed r WHERE r.doc_id = d.doc_id) AS removed_lines, coalesce(k.text, '') AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
)
def op3_window_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
least AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""
)
def op4_minmax_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), words=4, percent=80).drop("row", "group")


@query(
    """
WITH c AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (
  SELECT pair_id AS p, turn AS "end", text AS reply FROM c WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC NULLS LAST) = 1
), first AS (
  SELECT pair_id AS p, turn AS place, text AS reply FROM c WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY turn, text NULLS FIRST) = 1
), ends AS (
  SELECT a.p, a."end", CASE WHEN a.p % 2 = 1 THEN f.place ELSE a."end" END AS place, CASE WHEN a.p % 2 = 1 THEN f.reply ELSE a.reply END AS reply, CASE WHEN a.p % 2 = 1 THEN g.reply ELSE b.reply END AS other
  FROM last a JOIN last b ON b.p + 1 = a.p JOIN first f ON f.p = a.p JOIN first g ON g.p = b.p
), rows AS (SELECT c.* FROM c JOIN ends ON p = pair_id AND turn <= "end" AND turn <> place),
both_sides AS (
  SELECT 'chosen' AS side, * FROM (SELECT * FROM rows UNION ALL SELECT p, place, 'assistant', reply FROM ends)
  UNION ALL SELECT 'rejected' AS side, * FROM (SELECT * FROM rows UNION ALL SELECT p, place, 'assistant', other FROM ends)
), turns AS (
  SELECT pair_id, turn, list(role || chr(0) || text ORDER BY role, text) FILTER (WHERE side = 'chosen') AS a, list(role || chr(0) || text ORDER BY role, text) FILTER (WHERE side = 'rejected') AS b
  FROM both_sides GROUP BY 1, 2
), split AS (SELECT pair_id, min(turn) AS split FROM turns WHERE a IS DISTINCT FROM b GROUP BY 1),
placed AS (
  SELECT s.pair_id, CASE WHEN split IS NULL OR turn < split THEN 'prompt' ELSE side END AS part, turn, role, '<|im_start|>' || role || chr(10) AS head, text
  FROM both_sides s LEFT JOIN split USING (pair_id) WHERE NOT (side = 'rejected' AND (split IS NULL OR turn < split))
)
SELECT pair_id, part, turn, role, head || text || '<|im_end|>' || chr(10) AS rendered,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) ELSE 0 END AS INTEGER) AS learn_from,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(head) + length(text) + 11 ELSE 0 END AS INTEGER) AS learn_to
FROM placed
"""
)
def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.with_foreign_reply(table(spark, sf_dir, "conversations")))


def _license_sql() -> str:
    rows = ", ".join(f"('{name}', {size}, '{gram}', {n})" for name, size, gram, n in licenses.template_bigrams(licenses.TEMPLATES))
    return rf"""
WITH t(license, size, gram, t) AS (VALUES {rows}),
seg AS (
  SELECT doc_id, 'text' AS kind, 0 AS line, text AS s FROM documents WHERE len(string_split(text, chr(10))) > 1
  UNION ALL SELECT doc_id, 'line' AS kind, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS s FROM documents
), w AS (SELECT doc_id, kind, line, list_filter(regexp_split_to_array(lower(s), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM seg),
g AS (SELECT doc_id, kind, line, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM w),
c AS (SELECT doc_id, kind, line, n, gram, count(*) AS c FROM g GROUP BY ALL),
m AS (SELECT doc_id, kind, line, n, license, size, CAST(sum(least(c, t)) AS BIGINT) AS shared FROM c JOIN t USING (gram) GROUP BY ALL),
whole AS (SELECT doc_id, kind, line, license, shared, 2 * shared / CAST(n + size AS DOUBLE) AS dice FROM m WHERE 2 * shared / CAST(n + size AS DOUBLE) >= 0.8),
tok AS (SELECT doc_id, line, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM w WHERE kind = 'line'),
pos AS (
  SELECT doc_id, line, word || ' ' || lead(word) OVER d AS gram, row_number() OVER d - 1 AS pos, count(*) OVER (PARTITION BY doc_id) - 1 AS alls FROM tok WINDOW d AS (PARTITION BY doc_id ORDER BY line, k)
), hit AS (SELECT p.*, license, size, t FROM pos p JOIN t USING (gram)),
inside AS (
  SELECT a.doc_id, a.license, a.size, a.line, a.pos, a.alls, b.gram, least(count(*), b.t) AS c FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.license = b.license AND b.pos BETWEEN a.pos AND a.pos + a.size - 1
  GROUP BY a.doc_id, a.license, a.size, a.line, a.pos, a.alls, b.gram, b.t
), runs AS (
  SELECT doc_id, license, size, line, pos, CAST(sum(c) AS BIGINT) AS shared, 2 * sum(c) / CAST(least(size, alls - pos) + size AS DOUBLE) AS dice FROM inside GROUP BY doc_id, license, size, line, pos, alls
), good AS (
  SELECT *, coalesce(2 * (pos - lag(pos) OVER (PARTITION BY doc_id, license ORDER BY pos)) > size, true) AS apart FROM runs WHERE dice >= 0.8
), placed AS (SELECT *, sum(CAST(apart AS INTEGER)) OVER (PARTITION BY doc_id, license ORDER BY pos ROWS UNBOUNDED PRECEDING) AS place FROM good),
best AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY doc_id, license, place ORDER BY dice DESC, pos) = 1)
SELECT doc_id, kind, CAST(line AS INTEGER) AS line, license, shared, dice FROM whole
UNION ALL SELECT doc_id, 'run', CAST(line AS INTEGER), license, shared, dice FROM best b
WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.kind = 'line' AND w.doc_id = b.doc_id AND w.line = b.line AND w.license = b.license)
"""


@query(_license_sql())
def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
)
def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def _verdict_sql() -> str:
    """Rules, then the rounds of both walks written out."""
    u = urlfilter
    parsed = "CASE WHEN strpos({0}, '://') > 0 THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
    host = "translate(regexp_extract({0}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in u.RULES)
    href = u.HREF.replace("'", "''")
    rounds = "".join(
        f""", r{k} AS (SELECT way, host, sum(m) AS m FROM (
  SELECT e.way, e.dst AS host, m * p * {u.DAMPING} AS m FROM r{k - 1} r JOIN e ON e.way = r.way AND e.src = r.host UNION ALL SELECT * FROM r0) GROUP BY 1, 2)"""
        for k in range(1, u.ROUNDS + 1)
    )
    return f"""
WITH a AS (SELECT page_id, html, {parsed.format("coalesce(url, '')")} AS rest FROM pages),
b AS (SELECT page_id, html, {host.format("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
rules(verdict, h, p) AS (VALUES {rules}),
fit AS (
  SELECT page_id, h || p AS rule, verdict FROM b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, h || p) = 1
), j AS (SELECT b.page_id, b.host, b.path, f.rule, f.verdict FROM b LEFT JOIN fit f USING (page_id)),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE verdict = 'allow') AS a, count(*) FILTER (WHERE verdict = 'block') AS b FROM j WHERE host <> '' GROUP BY 1),
r0 AS (
  SELECT 0 AS way, host, 1 - {u.DAMPING} AS m FROM hosts WHERE 2 * a >= n UNION ALL SELECT 1, host, 1 - {u.DAMPING} FROM hosts WHERE 2 * b >= n
), href AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM b),
l AS (SELECT src, {host.format(parsed.format("CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END"))} AS dst, count(*) AS n FROM href GROUP BY 1, 2),
k AS (SELECT * FROM l WHERE src <> '' AND dst <> '' AND src <> dst),
e AS (
  SELECT 0 AS way, src, dst, n / sum(n) OVER (PARTITION BY src) AS p FROM k UNION ALL SELECT 1, dst, src, n / sum(n) OVER (PARTITION BY dst) FROM k
){rounds},
bad AS (SELECT host FROM r{u.ROUNDS} GROUP BY 1 HAVING round(sum(m) FILTER (WHERE way = 1), 9) >= {u.THRESHOLD} AND round(sum(m) FILTER (WHERE way = 1), 9) > round(coalesce(sum(m) FILTER (WHERE way = 0), 0), 9))
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN bad ON bad.host = j.host
"""


@query(_verdict_sql())
def op8_host_rank_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


@query()
def op9_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decide(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("item_id").alias("best_item_id"), "covered_words", "coverage", "item_ids", "contaminated")


@query()
def op10_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_apart(table(spark, sf_dir, "documents"))


def _manifest_sql() -> str:
    field = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
    leaf = " || ".join(field.format(c) for c in merkle.FIELDS)
    forged = " || ".join(field.format("(CAST(n_chars AS HUGEINT) + 1)" if c == "n_chars" else c) for c in merkle.FIELDS)
    # CRC-32: after each byte, eight steps (marked -1) shift one bit out
    crc = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(substr(s, CAST(i AS INTEGER), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""
    up = "list_transform(range(1, len(h) + 1, 2), lambda i: sha256(h[i] || coalesce(h[i + 1], '')))"
    return f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, lang, CAST(doc_id AS VARCHAR) AS s, sha256({leaf}) AS leaf, sha256({forged}) AS forged FROM documents
), leaves AS (
  SELECT row, doc_id, lang, leaf, CASE WHEN ({crc}) % 7 = 0 THEN forged ELSE leaf END AS shown,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx FROM d
), lv AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY idx) AS h FROM leaves GROUP BY lang
  UNION ALL SELECT lang, level + 1, {up} FROM lv WHERE len(h) > 1
), sub AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM lv WHERE len(h) = 1),
tv AS (
  SELECT 100 AS level, list(subroot ORDER BY idx) AS h FROM sub HAVING count(*) > 0
  UNION ALL SELECT level + 1, {up} FROM tv WHERE len(h) > 1
), nodes AS (
  SELECT coalesce(lang, '-') AS tree, lang IS NULL AS none, level, unnest(h) AS digest, generate_subscripts(h, 1) - 1 AS idx FROM lv WHERE len(h) > 1
  UNION ALL SELECT 'top', NULL, level, unnest(h), generate_subscripts(h, 1) - 1 FROM tv WHERE len(h) > 1
), steps AS (
  SELECT row, x.level, l.idx >> x.level AS at, coalesce(l.lang, '-') AS tree, l.lang IS NULL AS none FROM leaves l JOIN lv x ON x.lang IS NOT DISTINCT FROM l.lang AND len(x.h) > 1
  UNION ALL SELECT row, x.level, s.idx >> (x.level - 100), 'top', NULL FROM leaves l JOIN sub s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tv x ON len(x.h) > 1
), beside AS (
  SELECT row, s.level, CASE WHEN n.digest IS NULL THEN 'N' WHEN s.at % 2 = 1 THEN 'L' || n.digest ELSE 'R' || n.digest END AS step
  FROM steps s LEFT JOIN nodes n ON n.tree = s.tree AND n.none IS NOT DISTINCT FROM s.none AND n.level = s.level AND n.idx = xor(s.at, 1)
), proof AS (SELECT row, list(step ORDER BY level) AS steps FROM beside GROUP BY row),
found AS (
  SELECT l.*, sub.subroot, (SELECT h[1] FROM tv WHERE len(h) = 1) AS root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x[2:]), ''), '')) AS proof_sha256,
    list_reduce(list_prepend(shown, coalesce(steps, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM leaves l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang LEFT JOIN proof p ON p.row = l.row
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM found
"""


@query(_manifest_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(docs, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, tampered).proofs
    return found.select(F.col("place").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query()
def op12_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
