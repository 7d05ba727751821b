"""Frames over `documents`: every sentence told with a statement of a domain, whole texts for what binds across sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import typed_frames as T

from .registry import query, table

#: What the sentences are joined with.
STATEMENTS = [
    "Starting is not recommended from eGFR 30 to 45", "It is contraindicated below eGFR 30; stop it at eGFR of 20", "Do not stop the drug, but review its benefit when eGFR falls below 45", "It is not contraindicated; reassess risk at the same eGFR",
    "Patients of age 60 with low potassium withdraw", "Discontinue at the same renal value", "A spontaneous reporting system can detect a signal", "Reports cannot establish a cause", "The trial proves that it caused harm", "Report counts cannot give the incidence",
    "Report counts estimate incidence", "The registry lists the study as recruiting with a declared primary endpoint", "The completed trial met its primary endpoint", "No result on the primary outcome", "Guideline B supersedes guideline A and is current", "The trial favors option Alpha-1",
    "The current guideline still recommends strategy beta", "Genotype is associated with exposure", "Genotype gives no dose rule", "The lesion was classified as indeterminate", "The report calls the lesion malignant", "Biomarker X is not associated with outcome Y", "Biomarker Z was associated with outcome Q",
    "Biomarker X showed no association with outcome Y", "Biomarker W was unrelated to outcome V", "A relationship between biomarker M and outcome N", "",
]


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\.", -1)
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pieces).alias("n", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    said = F.get(F.array(*[F.lit(x) for x in STATEMENTS]), ((F.length("s") + F.col("n")) % len(STATEMENTS)).cast("int"))
    return s.select((F.col("doc_id") * 100_000 + F.col("n")).alias("id"), F.concat(said, F.lit(" "), F.col("s")).alias("text"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents each sentence of which is followed by a statement."""
    bank = F.array(*[F.lit(x) for x in STATEMENTS])
    parts = F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\.", -1), lambda s, i: F.concat(s, F.lit(". "), F.get(bank, ((F.length(s) + i) % len(STATEMENTS)).cast("int")), F.lit(". ")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(parts, "").alias("text"))


def _detect_sql() -> str:
    normal = r"trim(regexp_replace(translate(lower(text), '–—', '--'), '\s+', ' ', 'g'))"
    cut = "t"
    for p in T.CLAUSE_END:
        cut = f"regexp_replace({cut}, '{p}', '{chr(92) + '1' if '(' in p.replace('(?:', '') and 'but' not in p else ''}' || chr(31), 'g')"
    found = lambda ps: "(" + " OR ".join(f"regexp_matches(x, '{p}')" for p in ps) + ")"
    num = lambda p, g: f"TRY_CAST(regexp_extract(x, '{p}', {g}) AS DOUBLE)"
    conds = []
    for op, p in T.CLAUSE_CONDITIONS:
        if op == "RANGE":
            low, high = f"least({num(p, 1)}, {num(p, 2)})", f"greatest({num(p, 1)}, {num(p, 2)})"
            value = ["CAST(NULL AS DOUBLE)", low, high]
        else:
            value = [num(p, 1), "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"]
        conds.append(f"WHEN regexp_matches(x, '{p}') THEN struct_pack(o := '{op}', v := {value[0]}, l := {value[1]}, h := {value[2]})")
    slot = lambda t, ps: f"'{t}'" if not t.startswith("$") else f"trim(regexp_replace(trim(regexp_extract(x, '{ps[0]}', {t[1:]}), '.,;:()[]{{}}'), '[^a-z0-9]+', '_', 'g'), '_')"
    groups: dict[tuple, list[str]] = {}
    for k, r in enumerate(T.DOMAIN_RULES):
        holds = " AND ".join(found(n) for n in r.needs) + "".join(f" AND NOT regexp_matches(x, '{p}')" for p in r.unless)
        value = f"struct_pack(d := '{r.domain}', e := '{r.event}', s := {slot(r.subject, r.needs[-1])}, ob := {slot(r.object, r.needs[-1])}, p := '{r.polarity}', b := {str(r.bears).lower()})"
        groups.setdefault((r.per, r.group or k), []).append(f"WHEN {holds} THEN {value}")
    items = {per: ", ".join(f"CASE {' '.join(rules)} END" for (p, _), rules in groups.items() if p == per) for per in ("clause", "text")}
    each = "unnest(list_filter([{0}], lambda f: f IS NOT NULL))"
    return f"""
WITH sent AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), '.')) AS s, generate_subscripts(string_split(replace(text, chr(10), ' '), '.'), 1) - 1 AS n FROM documents),
src AS (SELECT doc_id * 100000 + n AS id, ({_list(STATEMENTS)})[(length(trim(s)) + n) % {len(STATEMENTS)} + 1] || ' ' || trim(s) AS text FROM sent WHERE trim(s) <> ''),
t AS (SELECT id, {normal} AS t FROM src), c AS (SELECT id, string_split({cut}, chr(31)) AS parts FROM t WHERE t <> ''),
cl AS (SELECT id, trim(unnest(parts), ' ,') AS x, generate_subscripts(parts, 1) - 1 AS clause FROM c),
a AS (SELECT id, clause, x, CASE {" ".join(conds)} END AS k, {each.format(items["clause"])} AS f FROM cl),
b AS (SELECT id, -1 AS clause, t AS x, CAST(NULL AS STRUCT(o VARCHAR, v DOUBLE, l DOUBLE, h DOUBLE)) AS k, {each.format(items["text"])} AS f FROM (SELECT id, t, t AS x FROM t WHERE t <> ''))
SELECT id, f.d AS domain, f.e AS event, f.s AS subject, f.ob AS object, f.p AS polarity, CASE WHEN f.b THEN k.o END AS operator, CASE WHEN f.b THEN k.v END AS value, CASE WHEN f.b THEN k.l END AS low, CASE WHEN f.b THEN k.h END AS high, CAST(clause AS INTEGER) AS clause
FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@query(_detect_sql())
def domain_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of seven domains in every sentence."""
    return T.detect(_sentences(spark, sf_dir), "id").drop("source_span")


@query()
def typed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Management frames of whole texts, bound within nested spans, after the vetoes; compared with a plain version in tests."""
    return T.vetoed(_told(spark, sf_dir), "doc_id")
