"""Cues, spans and concepts in texts: what identifies a person, what a question asks, what a record is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import concepts as C
from quern.functions import text as X
from quern.operators import cues, extract, privacy, review

from .registry import Derived, query, table

# ---- identifying cues


def _counted() -> dict[str, str]:
    """The seven patterns for engines without look-behind: a boundary is matched as a character instead."""
    edge, out = "(?:^|[^A-Za-z0-9])", "(?:$|[^A-Za-z0-9])"
    return {
        "email": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "mobile": edge + r"(?:\+?86[ -]?)?1[3-9][0-9][ -]?[0-9]{4}[ -]?[0-9]{4}" + out,
        "national_id": edge + "([1-8][0-9]{16}[0-9Xx])" + out,
        "contact_handle": r"(?i)(?:微信(?:号)?|微号|QQ(?:号)?|联系账号|社交账号|账号|账户)\s*(?:[:：]|是|为)\s*(?:[A-Za-z][A-Za-z0-9_-]{4,31}|[1-9][0-9]{4,11})(?:$|[^A-Za-z0-9_-])",
        "name": r"(?:患者姓名|姓名|联系人)\s*(?:[:：]|是|为)\s*[一-鿿]{2,4}(?:[\s，,。；;！？!?]|$)",
        "address": r"(?:家庭地址|居住地址|收件地址|联系地址|住址)\s*(?:[:：]|是|为)\s*[^\s，,。；;！？!?][^，,。；;！？!?\r\n]{2,79}",
        "url": r"(?i)(?:https?://|www\.)[^\s<>\"''（），,。！？!；;]+",
    }


def _plausible_sql(number: str) -> str:
    day = f"try_strptime(substr({number}, 7, 8), '%Y%m%d')"
    return f"coalesce(year({day}) BETWEEN 1800 AND 2099 AND substr({number}, 15, 3) <> '000', false)"


def _count_sql() -> str:
    plain = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS {k}" for k, p in _counted().items() if k != "national_id")
    return f"SELECT doc_id, {plain}, CAST(len(list_filter(regexp_extract_all(text, '{_counted()['national_id']}', 1), lambda x: {_plausible_sql('x')})) AS INTEGER) AS national_id FROM documents"


@query(_count_sql())
def privacy_cue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of each kind per document, counted in the JVM."""
    n = lambda kind: F.regexp_count("text", F.lit(privacy.CUES[kind].replace("?P<", "?<"))).cast("int")
    ids = F.filter(F.regexp_extract_all("text", F.lit(privacy.CUES["national_id"]), F.lit(0)), privacy.plausible_id)
    plain = [n(k).alias(k) for k in privacy.CUES if k != "national_id"]
    return table(spark, sf_dir, "documents").select("doc_id", *plain, F.size(ids).cast("int").alias("national_id"))


#: Texts whose cues are known by how they are made: what stands before and after, the cue's kind, and its value.
_YEAR = "CAST(1700 + c_custkey % 450 AS STRING)"
_MADE = [
    ("email", "'Write to '", "concat('user', CAST(c_custkey % 40 AS STRING), '@mail.example.com')", "' soon'"),
    ("mobile", "'call '", "concat('+86 138-', CAST(1000 + c_custkey % 9000 AS STRING), '-', CAST(2000 + c_custkey % 30 AS STRING))", "', please'"),
    ("national_id", "'id '", f"concat('110105', {_YEAR}, CASE WHEN c_custkey % 16 = 2 THEN '1332' ELSE '0229' END, CASE WHEN c_custkey % 32 = 10 THEN '000' ELSE '123' END, 'X')", "' end'"),
    ("contact_handle", "'加我 微信号: '", "concat('abcde_', CAST(c_custkey % 50 AS STRING))", "' 谢谢'"),
    ("name", "'患者姓名：'", "CASE c_custkey % 3 WHEN 0 THEN '王小明' WHEN 1 THEN '李雷' ELSE '欧阳娜娜' END", "'，女'"),
    ("address", "'住址是 '", "concat('幸福路', CAST(c_custkey % 60 AS STRING), '号院')", "'。完'"),
    ("url", "'see '", "concat('https://host', CAST(c_custkey % 9 AS STRING), '.example.com/p')", "'; ok'"),
    ("none", "'nothing '", "'to see'", "' here 12345'"),
]
_case = lambda at: "CASE c_custkey % 8 " + " ".join(f"WHEN {k} THEN {m[at]}" for k, m in enumerate(_MADE)) + " END"
_MESSAGES = Derived("customer", {"message": "c_custkey", "head": _case(1), "value": _case(2), "tail": _case(3), "kind": "CASE c_custkey % 8 " + " ".join(f"WHEN {k} THEN '{m[0]}'" for k, m in enumerate(_MADE)) + " END"})
_KNOWN = f"""
WITH m AS ({_MESSAGES.sql()}),
s AS (SELECT message, head, value, tail, kind, CAST(length(head) AS INTEGER) AS start, CAST(length(head) + length(value) AS INTEGER) AS "end" FROM m WHERE kind <> 'none' AND (kind <> 'national_id' OR {_plausible_sql("value")}))
"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _MESSAGES.rows(spark, sf_dir).select("message", F.concat("head", "value", "tail").alias("text"))


@query(_KNOWN + 'SELECT message, kind, start, "end" FROM s')
def privacy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the seven kinds in messages whose cues are known by construction; implausible dates and sequences are none."""
    return privacy.scan(_messages(spark, sf_dir), "message")


@query(
    _KNOWN
    + """, f AS (SELECT kind, value, min(message) AS first FROM s GROUP BY 1, 2), n AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY first) AS n FROM f)
SELECT m.message, CASE WHEN n.n IS NULL THEN m.head || m.value || m.tail ELSE m.head || '[REDACTED_' || upper(s.kind) || '_' || n.n || ']' || m.tail END AS text
FROM m LEFT JOIN s USING (message) LEFT JOIN n ON n.kind = s.kind AND n.value = s.value
"""
)
def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue approved and replaced; a value keeps its number over all messages."""
    texts = _messages(spark, sf_dir)
    return privacy.redacted(texts, privacy.scan(texts, "message"), "message").select("message", "text")


_APPROVED = Derived("customer", {"message": "c_custkey", "kind": "CASE WHEN c_custkey % 6 = 0 THEN 'Bad Kind' ELSE 'name' END", "start": "CAST(c_custkey % 4 AS INT)", "end": "CAST(c_custkey % 4 + c_custkey % 30 AS INT)"})
_SECOND = Derived("customer", {"message": "c_custkey", "kind": "'url'", "start": "CAST(c_custkey % 9 AS INT)", "end": "CAST(c_custkey % 9 + 2 AS INT)"})


@query(
    f"""
WITH m AS (SELECT message, length(head || value || tail) AS n FROM ({_MESSAGES.sql()})), a AS ({_APPROVED.sql().replace(" AS end", ' AS "end"')} UNION ALL {_SECOND.sql().replace(" AS end", ' AS "end"')}),
j AS (SELECT a.*, n, max("end") OVER (PARTITION BY message ORDER BY start, "end", kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a JOIN m USING (message))
SELECT message, start, 'OUT_OF_BOUNDS' AS rule FROM j WHERE NOT (start >= 0 AND start < "end" AND "end" <= n) UNION ALL SELECT message, start, 'BAD_KIND' FROM j WHERE kind = 'Bad Kind' UNION ALL SELECT message, start, 'OVERLAP' FROM j WHERE start < before
"""
)
def redaction_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved spans that overlap, leave their text, or have no kind."""
    return privacy.violations(_messages(spark, sf_dir), _APPROVED.rows(spark, sf_dir).union(_SECOND.rows(spark, sf_dir)), "message")


# ---- what a record is about

_ABOUT = Derived("supplier", {
    "record": "s_suppkey",
    "text": "concat(CASE s_suppkey % 5 WHEN 0 THEN '시험 약물 ' WHEN 1 THEN 'プロトコル逸脱 ' WHEN 2 THEN '方案偏离 ' WHEN 3 THEN 'desviación del protocolo, evidencia ' ELSE 'Protocol deviation: ' END, CASE s_suppkey % 4 WHEN 0 THEN 'rescue dose AB-12 ' WHEN 1 THEN 'Unverified, AB-12 x9-z Ab-12 ' WHEN 2 THEN '인과 causal ' ELSE '' END, CASE s_suppkey % 3 WHEN 0 THEN 'blood  sugar 7.5 ' WHEN 1 THEN 'ALT 40 40 eeg' ELSE 'uncertain a1b 12-13' END)",
})


def _about_sql() -> str:
    phrases = ", ".join(f"('{name}', '{C._form(p)}')" for name, ps in C.CONCEPTS.items() for p in ps)
    spanish = " + ".join(f"CAST(contains(f, '{w}') AS INT)" for w in C.SPANISH)
    return f"""
WITH t AS ({_ABOUT.sql()}), f AS (SELECT record, text, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS f FROM t), p(concept, phrase) AS (VALUES {phrases}),
c AS (SELECT record, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts FROM f JOIN p ON contains(f, phrase) GROUP BY 1)
SELECT record, coalesce(c.concepts, '') AS concepts,
  CASE WHEN regexp_matches(f, '[\\x{{ac00}}-\\x{{d7af}}]') THEN 'ko' WHEN regexp_matches(f, '[\\x{{3040}}-\\x{{30ff}}]') THEN 'ja' WHEN regexp_matches(f, '[\\x{{3400}}-\\x{{9fff}}]') THEN 'zh' WHEN {spanish} >= 2 THEN 'es' ELSE 'en' END AS lang,
  array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '\\b[a-z][a-z0-9]{{1,20}}-[a-z0-9]{{1,20}}\\b'))), ',') AS ids,
  array_to_string(list_sort(list_distinct(list_filter(string_split(f, ' '), lambda x: regexp_full_match(x, '[0-9]+')))), ',') AS numbers,
  array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)\\balt\\b') THEN 'hepatic_enzyme' END, CASE WHEN regexp_matches(text, '(?i)\\bblood\\s+sugar\\b') THEN 'glucose' END, CASE WHEN regexp_matches(text, '(?i)\\beeg\\b') THEN 'neurophysiology' END], lambda x: x IS NOT NULL), ',') AS roles
FROM f LEFT JOIN c USING (record)
"""


@query(_about_sql())
def record_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts, language, identifiers, numbers and measurement roles of multilingual records."""
    t = _ABOUT.rows(spark, sf_dir).withColumn("form", X.word_form(F.col("text")))
    joined = lambda a: F.array_join(F.array_sort(a), ",")
    return t.select(
        "record", joined(C.concepts(F.col("form"))).alias("concepts"), C.language(F.col("form")).alias("lang"), joined(C.identifiers(F.col("text"))).alias("ids"), joined(C.numbers(F.col("form"))).alias("numbers"), F.array_join(C.roles(F.col("text")), ",").alias("roles")
    )


# ---- questions and utterances

_ASKED = Derived("nation", {
    "question_id": "n_nationkey",
    "text": "CASE n_nationkey % 12 WHEN 0 THEN '请问疼痛多久？' WHEN 1 THEN '不要告诉我年龄' WHEN 2 THEN '告诉医生你的年龄' WHEN 3 THEN '他说“年龄多少”疼痛多久' WHEN 4 THEN '年龄多少？不必现在回复我' WHEN 5 THEN '年龄多少？疼痛多久？以上问题不用回答' WHEN 6 THEN '我已经记录年龄' WHEN 7 THEN '今天天气好' WHEN 8 THEN '原文日期是哪天？' WHEN 9 THEN '患者之前问年龄多少' WHEN 10 THEN '不问年龄但是疼痛多久' ELSE '多少岁？' END",
})
_SLOTS = {"pain": ["疼痛"], "age": ["年龄", "多少岁"], "years": ["多少岁"], "date": ["日期"], "source_date": ["原文日期"]}
#: What the rules say of each question above: (clause, requested slots, reason).
_DECIDED = [
    [("pain", "direct_supported_request")], [("", "negated_request")], [("", "third_party_instruction")], [("", "reported_or_example"), ("pain", "direct_supported_request")],
    [("", "cancelled_by_following_clause"), ("", "negated_request")], [("", "cancelled_by_following_clause"), ("", "cancelled_by_following_clause"), ("", "negated_request")],
    [("", "deferred_or_declarative")], [("", "no_direct_request")], [("source_date", "direct_supported_request")], [("", "reported_or_example")], [("", "no_direct_request"), ("pain", "direct_supported_request")], [("", "unsupported_or_ambiguous_slot")],
]
_DECIDED_SQL = ", ".join(f"({k}, {c}, '{slots}', '{why}')" for k, rows in enumerate(_DECIDED) for c, (slots, why) in enumerate(rows))


@query(f"WITH d(k, clause, requested, reason) AS (VALUES {_DECIDED_SQL}) SELECT n_nationkey AS question_id, CAST(clause AS INTEGER) AS clause, requested, reason FROM nation JOIN d ON k = n_nationkey % 12")
def requested_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each clause of a question asks for, with the reason where it asks nothing."""
    found = review.requested_slots(_ASKED.rows(spark, sf_dir), _SLOTS, "question_id")
    return found.select("question_id", F.col("clause").cast("int").alias("clause"), F.array_join("requested", ",").alias("requested"), "reason")


_SAID = Derived("events", {
    "said_id": "event_id", "text": "concat(CASE event_type WHEN 'click' THEN '昨天没有发热' WHEN 'view' THEN '妈妈可能头痛' WHEN 'purchase' THEN '更正，不是左腿而是右腿' WHEN 'error' THEN '我不清楚，是否三' ELSE '孩子咳嗽' END, CAST(user_id % 7 AS STRING), '天了')",
})


@query(
    f"""
WITH t AS ({_SAID.sql()}), p(category, pattern) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in cues.REVIEW_CUES.items())})
SELECT said_id, category, CAST(len(regexp_extract_all(text, pattern)) AS BIGINT) AS cues, min(instr(text, regexp_extract(text, pattern))) - 1 AS first FROM t JOIN p ON regexp_matches(text, pattern) GROUP BY said_id, category, text, pattern
"""
)
def review_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six categories of words that a reviewer looks at, with the first place of each."""
    found = cues.review_spans(_SAID.rows(spark, sf_dir), "said_id")
    return found.groupBy("said_id", "category").agg(F.count(F.lit(1)).alias("cues"), F.min("start").cast("long").alias("first"))


_QUOTED = Derived("region", {"q": "r_regionkey", "text": "CASE r_regionkey WHEN 0 THEN 'say “a 「b」 c” end' WHEN 1 THEN 'open “never closed' WHEN 2 THEN '\"x\" y' WHEN 3 THEN 'plain' ELSE 'a” stray 「z」' END"})


@query(
    """
SELECT r_regionkey AS q, CASE r_regionkey WHEN 0 THEN 'say         ; end' WHEN 1 THEN 'open ' || repeat(' ', 13) WHEN 2 THEN '  ; y' WHEN 3 THEN 'plain' ELSE 'a” stray   ;' END AS masked,
  CASE r_regionkey WHEN 0 THEN '4-13' WHEN 1 THEN '5-18' WHEN 2 THEN '0-3' WHEN 3 THEN '' ELSE '9-12' END AS spans FROM region
"""
)
def quote_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations blanked, nested and unclosed ones as a whole, with their spans."""
    t = _QUOTED.rows(spark, sf_dir).withColumn("s", X.quoted_spans(F.col("text")))
    return t.select("q", X.quotes_masked(F.col("text"), F.col("s")).alias("masked"), F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("spans"))


@query(
    """
WITH t AS (SELECT doc_id, string_split(replace(text, ',', '"'), '"') AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(p) // 2 AS BIGINT) AS quotations, len(p) % 2 = 0 AS open, md5(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE repeat(' ', length(x) + 1) || CASE WHEN i < len(p) THEN ';' ELSE '' END END), '')) AS masked FROM t
"""
)
def quoted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose commas are taken for quotation marks: their quotations, whether the last is open, and the masked text's digest."""
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.replace("text", F.lit(","), F.lit('"')).alias("text"))
    t = t.withColumn("s", X.quoted_spans(F.col("text")))
    opened = F.exists("s", lambda x: x["kind"] == "open")
    return t.select("doc_id", F.size("s").cast("long").alias("quotations"), opened.alias("open"), F.md5(X.quotes_masked(F.col("text"), F.col("s")).cast("binary")).alias("masked"))


# ---- spans with windows, conditions, sentences

_NOTES = Derived("customer", {
    "note": "c_custkey",
    "text": "concat('Start drug', CASE c_custkey % 3 WHEN 0 THEN ' now' ELSE '' END, ' if egfr is below ', CAST(30 + c_custkey % 20 AS STRING), '. ', CASE c_custkey % 2 WHEN 0 THEN 'Stop drug when egfr between 15 and 30' ELSE 'Stop it' END, '. End')",
})


@query(
    f"""
WITH t AS ({_NOTES.sql()}), s AS (SELECT note, unnest(string_split(text, '.')) AS raw, generate_subscripts(string_split(text, '.'), 1) AS n FROM t),
o AS (SELECT note, raw, n, coalesce(sum(length(raw) + 1) OVER (PARTITION BY note ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM s)
SELECT note, CAST(n - 1 AS INTEGER) AS number, raw AS sentence, CAST(place AS INTEGER) AS start, CAST(place + length(raw) AS INTEGER) AS "end" FROM o WHERE raw <> ''
"""
)
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.sentences(_NOTES.rows(spark, sf_dir), "note").withColumn("number", F.col("number").cast("int"))


@query(
    f"""
WITH t AS ({_NOTES.sql()}), m AS (SELECT note, 'start' AS kind, 0 AS s, 5 AS e FROM t UNION ALL SELECT note, 'stop', instr(lower(text), 'stop') - 1, instr(lower(text), 'stop') + 3 FROM t),
w AS (SELECT *, lag(e) OVER (PARTITION BY note ORDER BY s) AS before, lead(s) OVER (PARTITION BY note ORDER BY s) AS after FROM m)
SELECT note, kind, CAST(s AS INTEGER) AS start, CAST(coalesce((before + s) // 2, 0) AS INTEGER) AS own_from, CAST((e + after) // 2 AS INTEGER) AS own_to FROM w
"""
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of events and the stretch of text that each of them owns."""
    found = extract.mentions(_NOTES.rows(spark, sf_dir), ["note"], "text", {"start": r"\bstart\b", "stop": r"\bstop\b"})
    return extract.owned_windows(found, ["note"]).select("note", "kind", "start", "own_from", "own_to")


@query(
    f"""
WITH t AS ({_NOTES.sql()})
SELECT note, 0 AS n, 'LT' AS operator, CAST(30 + note % 20 AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM t
UNION ALL SELECT note, 1, 'RANGE', NULL, 15.0, 30.0 FROM t WHERE note % 2 = 0
"""
)
def numeric_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _NOTES.rows(spark, sf_dir).select("note", F.posexplode(extract.conditions(F.col("text"), "egfr")).alias("n", "c"))
    return t.select("note", F.col("n").cast("int").alias("n"), "c.*")
