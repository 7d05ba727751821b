"""Facts that users declare in their own turns, clause by clause.

A turn is read through scopes: a sentence that asks declares nothing; a correction holds from its clause to the end of the
turn; a subject named at a clause's head owns its facts.  What a turn says twice and differently about a key is settled
nowhere: it is reported, and no fact is made.  Everything is built-in expressions and windows within a turn; the order of
turns matters only in streaming.facts.observed(), which folds the declarations to states.

Null and empty turns declare nothing; clauses outside of the rules are reported with their reason; rows that repeat a turn
are one turn, read in the order of their texts; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of dated facts, of facts that may be unknown, subjects, and phrases of the declared values.
TIMES = {"症状开始时间": "symptom_onset", "服药时间": "medication_time", "报告日期": "report_date", "上次咨询日期": "last_consultation_date", "截图转发日期": "screenshot_forward_date", "原文发布日期": "original_publication_date"}
LABELS = {"是否发热": "fever", "发热情况": "fever", "是否服药": "medication_taken", "药名": "medication_name", "报告项目名": "report_item", "期间是否变化": "interval_change", **TIMES}
SUBJECTS = {"妈妈": "mother", "母亲": "mother", "爸爸": "father", "父亲": "father"}
DECLARED = [
    ("fever", "false", ["没有发热", "没有发烧", "不发热", "不发烧"]), ("fever", "true", ["有发热", "有发烧", "发热", "发烧"]),
    ("medication_taken", "false", ["没有服药", "尚未服药", "还没有服药"]), ("medication_taken", "true", ["已经服药", "已服药", "有服药"]),
]
UNKNOWN = r"^(.*?)(?:尚不清楚|不清楚|不知道)$"
HEDGES = "不清楚|不知道|可能|也许|不是|没有"
ASKED_FOR = r"^(?:我)?(?:是)?(?:替|帮)(妈妈|母亲|爸爸|父亲)问的?$"
CORRECTION = r"^(?:(?:更正(?:一下)?|刚才说错了?|我刚才说错了?|纠正一下|改口)[：:，,\s]*)+"
QUESTION = "吗|么|呢|是否|是不是|对不对"
SENTENCE = r"[^。！？!?；;\n]+[。！？!?；;\n]?"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def declared(clause: Column) -> Column:
    """struct<key, value, status> of a clause, null outside of the rules."""
    who = F.try_element_at(_map(SUBJECTS), F.substring(clause, 1, 2))
    rest = F.when(who.isNotNull(), F.substring(clause, F.lit(3), F.length(clause))).otherwise(clause)
    head = F.when(who.isNotNull(), F.concat(who, F.lit("."))).otherwise("")
    out = lambda key, value, status: F.struct(key.alias("key"), value.alias("value"), F.lit(status).alias("status"))
    none = F.lit(None).cast("string")
    unknown = F.try_element_at(_map(LABELS), F.regexp_extract(rest, UNKNOWN, 1))
    dated = rf"^({'|'.join(TIMES)})(?:是|为|：|:)\s*(.{{1,40}})$"
    value = F.trim(F.regexp_extract(rest, dated, 2))
    rules = [F.when(unknown.isNotNull(), out(F.concat(head, unknown), none, "unknown"))]
    rules += [F.when(rest.isin(phrases), out(F.concat(head, F.lit(key)), F.lit(v), "confirmed")) for key, v, phrases in DECLARED]
    rules += [F.when(rest.rlike(dated) & ~value.rlike(HEDGES), out(F.concat(head, F.try_element_at(_map(TIMES), F.regexp_extract(rest, dated, 1))), value, "confirmed"))]
    rules += [F.when(who.isNull() & clause.rlike(ASKED_FOR), out(F.lit("patient_subject"), F.try_element_at(_map(SUBJECTS), F.regexp_extract(clause, ASKED_FOR, 1)), "confirmed"))]
    return F.coalesce(*rules)


def clauses(turns: DataFrame, key: str, turn: str, text: str = "text") -> DataFrame:
    """(key, turn, __at, __raw, __bare, __asks, __sentence, __corrected, __d): clauses in order, whether their sentence asks, and what they declare."""
    s = turns.select(key, turn, F.col(text).alias("__t"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0))).alias("__s", "__sentence"))
    parts = F.transform(F.split(F.regexp_replace("__sentence", r"[。！!；;\n]+$", ""), "[，,]+"), lambda c: F.trim(c))
    s = s.withColumn("__parts", parts)
    # a clause that says that something is unknown doesn't ask, though its label may hold a question's word
    doubtful = F.exists("__parts", lambda c: c.rlike(QUESTION) & ~F.coalesce(declared(c)["status"] == "unknown", F.lit(False)))
    s = s.withColumn("__asks", F.col("__sentence").rlike("[?？]") | doubtful)
    c = s.select(key, turn, "__t", "__s", "__asks", F.trim("__sentence").alias("__sentence"), F.posexplode("__parts").alias("__c", "__raw")).where("__raw <> ''")
    c = c.withColumn("__bare", F.trim(F.regexp_replace("__raw", CORRECTION, "")))
    w = Window.partitionBy(key, turn).orderBy("__t", "__s", "__c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    corrected = F.coalesce(F.max(~F.col("__asks") & F.col("__raw").rlike(CORRECTION)).over(w), F.lit(False))
    return c.withColumns({"__corrected": corrected, "__d": declared(F.col("__bare")), "__at": F.struct("__t", "__s", "__c")})


def observations(turns: DataFrame, key: str, turn: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(declarations (key, turn, fact, value, status, corrected), what was not read (key, turn, text, reason))."""
    c = clauses(turns, key, turn, text)
    told = c.where("not __asks and __d is not null").groupBy(key, turn, F.col("__d.key").alias("fact")).agg(
        F.count_distinct(F.struct(F.col("__d.value").isNull(), F.coalesce("__d.value", F.lit("")), "__d.status")).alias("__ways"), F.max_by("__d", "__at").alias("__d"), F.max_by("__corrected", "__at").alias("corrected")
    )
    declarations = told.where("__ways = 1").select(key, turn, "fact", F.col("__d.value").alias("value"), F.col("__d.status").alias("status"), "corrected")
    asked = c.where("__asks").select(key, turn, F.col("__sentence").alias("text"), F.lit("question_not_declaration").alias("reason"), "__s").distinct().drop("__s")
    outside = c.where("not __asks and __d is null and __bare <> ''").select(key, turn, F.col("__raw").alias("text"), F.lit("outside_supported_rules").alias("reason"))
    unsettled = told.where("__ways > 1").select(key, turn, F.col("fact").alias("text"), F.lit("within_turn_conflict").alias("reason"))
    return declarations, asked.union(outside).union(unsettled)
