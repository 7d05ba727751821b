"""Duplicates, lineage, retrieval and extraction over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.automaton import Cues
from quern.functions.scratch import scratch, stored
from quern.operators import core
from quern.operators.components import components

from .registry import query, table

_FORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_WORDS = "list_filter(string_split(" + _FORM + ", ' '), lambda x: x <> '')"


# ---- duplicates


@query(
    r"""
WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT sha256(t) AS signature, count(*) AS copies, min(doc_id) AS first_doc FROM s GROUP BY t HAVING count(*) > 1
"""
)
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.spaced_form(F.col("text"), lambda c: c), 256).alias("signature"))
    return rows.groupBy("signature").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, rep (smallest doc_id of an equal word form; null texts are one class), set (5-shingle hashes of the rep, else null), stored.

    A form of one to four words is one shingle; without words there is none.
    """
    form = docs.select("doc_id", X.word_form(F.col("text"), X.light_fold).alias("form"))
    w = F.filter(F.split("form", " "), lambda x: x != "")
    own = form.select("doc_id", F.sha2("form", 256).alias("own"), w.alias("w"))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - 5), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(5)]))
    shingles = F.when(F.size("w") >= 5, F.array_distinct(grams)).when(F.size("w") > 0, F.array(F.xxhash64("w"))).otherwise(F.array().cast("array<bigint>"))
    path = scratch(docs.sparkSession, "classes")
    rows = own.select("doc_id", "own", F.coalesce(shingles, F.array().cast("array<bigint>")).alias("set"))
    reps = stored(own.select("doc_id", "own"), f"{path}/forms").groupBy("own").agg(F.min("doc_id").alias("rep")).select(F.col("own").alias("h"), "rep")
    return stored(rows.join(reps, F.col("own").eqNullSafe(F.col("h"))).select("doc_id", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("set")).alias("set")), f"{path}/classes")


def _near_pairs(classes: DataFrame) -> DataFrame:
    """Links between representatives: word 5-shingles, Jaccard at least 0.8."""
    return core.similar_pairs(classes.where("set is not null and size(set) > 0").select("rep", "set"), "rep", "set", 0.8, 4, 5, held=True)


_NEAR = rf"""
WITH RECURSIVE f AS (SELECT doc_id, {_FORM.format("text")} AS form FROM documents),
c AS (SELECT doc_id, form, min(doc_id) OVER (PARTITION BY form) AS rep FROM f),
w AS (SELECT rep, list_filter(string_split(form, ' '), lambda x: x <> '') AS w FROM c WHERE doc_id = rep),
s AS (SELECT DISTINCT rep, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.rep AS a, y.rep AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.rep < y.rep GROUP BY 1, 2),
p AS (SELECT a, b, round(i / (na.n + nb.n - i), 6) AS similarity FROM i JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE i * 5 >= (na.n + nb.n - i) * 4)
"""


@query(_NEAR + "SELECT * FROM p")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_pairs(_classes(table(spark, sf_dir, "documents")))


@query(
    _NEAR
    + """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
l AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a), d AS (SELECT a, count(*) AS links FROM e GROUP BY a)
SELECT c.doc_id, coalesce(l.c, c.rep) AS component, coalesce(d.links, 0) AS links FROM c LEFT JOIN l ON l.a = c.rep LEFT JOIN d ON d.a = c.rep
"""
)
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = _classes(table(spark, sf_dir, "documents"))
    pairs = stored(_near_pairs(classes), scratch(spark, "near"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    label = components(pairs)
    out = classes.drop("set").join(label, F.col("rep") == F.col("node"), "left").join(ends, F.col("rep") == F.col("x"), "left")
    return out.select("doc_id", F.coalesce("label", "rep").alias("component"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query(
    r"""
WITH v AS (SELECT conv_id, text FROM conversations WHERE role = 'user' UNION ALL SELECT -1 - conv_id, substr(text, 1, CAST(length(text) * 9 // 10 AS BIGINT)) FROM conversations WHERE role = 'user' AND conv_id % 3 = 0),
t AS (SELECT conv_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', '', 'g') AS t FROM v),
s AS (SELECT DISTINCT conv_id, unnest(CASE WHEN length(t) = 0 THEN [] WHEN length(t) <= 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)) END) AS g FROM t),
n AS (SELECT conv_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.conv_id AS a, y.conv_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.conv_id < y.conv_id GROUP BY 1, 2)
SELECT a, b, round(i / (na.n + nb.n - i), 6) AS similarity FROM i JOIN n na ON na.conv_id = a JOIN n nb ON nb.conv_id = b WHERE i * 2 >= na.n + nb.n - i
"""
)
def conv_user_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and a shortened second version of every third one (a negative id), by their users' trigrams."""
    own = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "text")
    cut = own.where("conv_id % 3 = 0").select((-1 - F.col("conv_id")).alias("conv_id"), F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") * 9 / 10).cast("int")).alias("text"))
    turns = own.union(cut).select("conv_id", X.dense_form(F.col("text"), X.light_fold).alias("s")).select("conv_id", F.explode(X.char_ngrams(F.col("s"), 3)).alias("g"))
    return core.similar_pairs_dense(turns.groupBy("conv_id").agg(F.collect_set(F.xxhash64("g")).alias("set")), "conv_id", "set", 1, 2)


# ---- lineage: protected items against an allowed corpus


#: Bytes of short items that one automaton holds; more of them take further passes over the texts.
SHORT_BYTES = 8 << 20


def _truth(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document holds the item's whole text.

    A probe of four inner words of the item finds the few pairs for which the texts are compared.  Items of under six
    words have no four inner words: all of them are looked for in one pass over each text, in blocks of SHORT_BYTES.
    """
    w = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda x: x != "")
    gram = lambda c, i: F.xxhash64(*[F.get(F.col(c), i + k) for k in range(4)])
    sized = items.where("text <> ''").withColumn("w", w("text"))
    probes = sized.where(F.size("w") >= 6).select("item_id", F.col("text").alias("item"), gram("w", F.lit(1)).alias("g"))
    grams = docs.select("doc_id", w("text").alias("w")).where(F.size("w") >= 4).select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 4), lambda i: gram("w", i)))).alias("g"))
    found = grams.join(probes, "g").select("doc_id", "item_id", "item").join(docs.select("doc_id", "text"), "doc_id")
    truth = found.where(F.contains("text", F.col("item"))).select("doc_id", "item_id").distinct()
    short = sized.where(F.size("w") < 6).groupBy(F.col("text").alias("item")).agg(F.collect_set("item_id").alias("ids"))
    short = stored(short, scratch(docs.sparkSession, "short-items"))
    blocks = -(-(short.agg(F.sum(F.octet_length("item"))).first()[0] or 0) // SHORT_BYTES)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        cues = Cues(sorted(r["item"] for r in block.select("item").collect()))  # the block's bytes
        names = docs.sparkSession.createDataFrame(list(enumerate(cues.cues)), "cue int, item string")
        hits = docs.select("doc_id", F.explode(cues.found(F.col("text"))).alias("cue")).join(names, "cue").join(block, "item")
        truth = truth.union(hits.select("doc_id", F.explode("ids").alias("item_id")))
    return truth


def _spans(df: DataFrame, key: str) -> DataFrame:
    """Normalised sentences of 30 characters and five words at least."""
    s = df.select(key, F.explode(F.split("text", r"[.!?\n]+")).alias("s")).select(key, X.word_form(F.col("s"), X.light_fold).alias("span"))
    return s.where((F.length("span") >= 30) & (F.size(F.split("span", " ")) >= 5)).distinct()


def _lineage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Verbatim pairs, candidates, and (item_id, anchor) of words that only protected items hold."""
    docs, items, labels = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "labels"))
    truth = stored(_truth(docs, items), scratch(spark, "truth"))
    good = labels.where("quality = 1").select("doc_id").distinct().join(truth.select("doc_id").distinct(), "doc_id", "left_anti")
    words = lambda df, key: df.select(key, F.explode(X.content_words(F.col("text"), X.light_fold)).alias("word"))
    known = words(docs.join(good, "doc_id", "left_semi"), "doc_id").select("word").distinct()
    anchors = words(items, "item_id").join(known, "word", "left_anti")
    return truth, good, anchors


_CONTENT = f"list_distinct(list_filter({_WORDS.format('text')}, lambda x: x NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)}) AND (length(x) >= 4 OR regexp_matches(x, '\\p{{Nd}}'))))"
_LINEAGE = rf"""
WITH truth AS (SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM truth)),
dw AS (SELECT doc_id, unnest({_CONTENT}) AS word FROM documents),
iw AS (SELECT item_id, unnest({_CONTENT}) AS word FROM benchmark),
anchors AS (SELECT * FROM iw WHERE word NOT IN (SELECT word FROM dw WHERE doc_id IN (SELECT doc_id FROM good))),
ds AS (SELECT DISTINCT doc_id, {_FORM.format("s")} AS span FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s FROM documents)),
bs AS (SELECT DISTINCT item_id, {_FORM.format("s")} AS span FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s FROM benchmark)),
spans AS (SELECT * FROM bs WHERE length(span) >= 30 AND len(string_split(span, ' ')) >= 5 AND span NOT IN (SELECT span FROM ds WHERE doc_id IN (SELECT doc_id FROM good))),
pa AS (SELECT doc_id, item_id, count(*) AS anchors FROM dw JOIN anchors USING (word) WHERE doc_id NOT IN (SELECT doc_id FROM good) GROUP BY 1, 2),
ps AS (SELECT doc_id, item_id, count(*) AS spans FROM ds JOIN spans USING (span) WHERE doc_id NOT IN (SELECT doc_id FROM good) GROUP BY 1, 2),
pk AS (SELECT doc_id, item_id, coalesce(anchors, 0) AS anchors, coalesce(spans, 0) AS spans FROM pa FULL JOIN ps USING (doc_id, item_id)),
tw AS (SELECT doc_id, list_distinct({_WORDS.format("text")}) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM pk)),
ti AS (SELECT item_id, list_distinct({_WORDS.format("text")}) AS w FROM benchmark),
pairs AS (
  SELECT doc_id, item_id, anchors, spans, round(2 * len(list_intersect(tw.w, ti.w)) / (len(tw.w) + len(ti.w)), 6) AS token_dice,
    CASE WHEN spans > 0 THEN 'BLOCK' WHEN anchors >= 3 THEN 'REVIEW' ELSE 'ALLOW' END AS decision
  FROM pk JOIN tw USING (doc_id) JOIN ti USING (item_id)
)
"""


@query(_LINEAGE + "SELECT item_id, count(*) AS anchors, min(word) AS first_anchor FROM anchors GROUP BY 1")
def benchmark_exclusive_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lineage(spark, sf_dir)[2].groupBy("item_id").agg(F.count(F.lit(1)).alias("anchors"), F.min("word").alias("first_anchor"))


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    truth, good, anchors = _lineage(spark, sf_dir)
    others = docs.join(good, "doc_id", "left_anti")
    words = others.select("doc_id", F.explode(X.content_words(F.col("text"), X.light_fold)).alias("word"))
    by_anchor = words.join(anchors, "word").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("anchors"))
    own = _spans(items, "item_id").join(_spans(docs.join(good, "doc_id", "left_semi"), "doc_id").select("span").distinct(), "span", "left_anti")
    by_span = _spans(others, "doc_id").join(own, "span").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("spans"))
    keys = by_anchor.join(by_span, ["doc_id", "item_id"], "full").na.fill(0, ["anchors", "spans"])
    distinct = lambda c: F.array_distinct(X.words_a(F.col(c), X.light_fold))
    scored = keys.join(docs.select("doc_id", distinct("text").alias("x")), "doc_id").join(items.select("item_id", distinct("text").alias("y")), "item_id")
    decision = F.when(F.col("spans") > 0, "BLOCK").when(F.col("anchors") >= 3, "REVIEW").otherwise("ALLOW")
    return scored.select("doc_id", "item_id", "anchors", "spans", F.round(X.dice(F.col("x"), F.col("y")), 6).alias("token_dice"), decision.alias("decision")), truth, good


@query(_LINEAGE + "SELECT * FROM pairs")
def lineage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)[0]


_DECIDED = (
    _LINEAGE
    + """, mosaic AS (
  SELECT doc_id FROM pairs WHERE anchors >= 8 AND token_dice >= 0.52 GROUP BY 1 HAVING count(*) >= 2 AND sum(anchors) >= 16
), best AS (
  SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE decision WHEN 'BLOCK' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END DESC, token_dice DESC, anchors DESC, item_id) = 1
), decided AS (
  SELECT d.doc_id, CASE WHEN coalesce(b.decision, 'ALLOW') = 'ALLOW' THEN -1 ELSE b.item_id END AS nearest_item, CASE WHEN m.doc_id IS NOT NULL THEN 'BLOCK' ELSE coalesce(b.decision, 'ALLOW') END AS decision,
    m.doc_id IS NOT NULL AS mosaic
  FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id LEFT JOIN mosaic m ON m.doc_id = d.doc_id WHERE d.doc_id NOT IN (SELECT doc_id FROM good)
)
"""
)


def _decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs, truth, good = _pairs(spark, sf_dir)
    rank = F.when(F.col("decision") == "BLOCK", 2).when(F.col("decision") == "REVIEW", 1).otherwise(0)
    dense = (F.col("anchors") >= 8) & (F.col("token_dice") >= 0.52)
    best = pairs.groupBy("doc_id").agg(
        F.max_by(F.struct("item_id", "decision"), F.struct(rank, "token_dice", "anchors", -F.col("item_id"))).alias("b"),
        ((F.count_if(dense) >= 2) & (F.sum(F.when(dense, F.col("anchors"))) >= 16)).alias("m"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id").join(good, "doc_id", "left_anti").join(best, "doc_id", "left")
    mosaic = F.coalesce("m", F.lit(False))
    found = F.coalesce(F.col("b.decision"), F.lit("ALLOW"))
    return docs.select("doc_id", F.when(found != "ALLOW", F.col("b.item_id")).otherwise(-1).alias("nearest_item"), F.when(mosaic, "BLOCK").otherwise(found).alias("decision"), mosaic.alias("mosaic")), truth


@query(_DECIDED + "SELECT * FROM decided")
def lineage_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir)[0]


@query(
    _DECIDED
    + """, t AS (SELECT decision, doc_id IN (SELECT doc_id FROM truth) AS bad FROM decided),
c AS (SELECT count(*) FILTER (WHERE bad AND decision = 'BLOCK') AS tp, count(*) FILTER (WHERE NOT bad AND decision = 'BLOCK') AS fp, count(*) FILTER (WHERE bad AND decision <> 'BLOCK') AS fn,
  count(*) FILTER (WHERE NOT bad AND decision <> 'BLOCK') AS tn, count(*) FILTER (WHERE NOT bad AND decision = 'REVIEW') AS rv FROM t)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS clean_false_block, round(rv / nullif(fp + tn, 0), 6) AS clean_review FROM c
"""
)
def lineage_detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided, truth = _decisions(spark, sf_dir)
    bad = F.col("t").isNotNull()
    rows = decided.join(truth.select("doc_id", F.lit(1).alias("t")).distinct(), "doc_id", "left")
    block = F.col("decision") == "BLOCK"
    c = rows.agg(F.count_if(bad & block).alias("tp"), F.count_if(~bad & block).alias("fp"), F.count_if(bad & ~block).alias("fn"), F.count_if(~bad & ~block).alias("tn"), F.count_if(~bad & (F.col("decision") == "REVIEW")).alias("rv"))
    rate = lambda n, d: F.round(F.try_divide(F.col(n), d), 6)
    clean = F.col("fp") + F.col("tn")
    return c.select("tp", "fp", "fn", "tn", rate("tp", F.col("tp") + F.col("fp")).alias("precision"), rate("tp", F.col("tp") + F.col("fn")).alias("recall"), rate("fp", clean).alias("clean_false_block"), rate("rv", clean).alias("clean_review"))


# ---- retrieval and routing


@query(
    rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE lang IN ('en', 'all')),
t AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY 1, 2),
c AS (SELECT count(*) AS n, avg(len(w)) AS average FROM d), df AS (SELECT word, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({_WORDS.format("text")}) AS word FROM benchmark),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / average))), 6) AS score
  FROM q JOIN t USING (word) JOIN df USING (word) JOIN d USING (doc_id), c GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 3
"""
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics are of the eligible corpus only (scope: English or all)."""
    docs = table(spark, sf_dir, "documents").where(core.in_scope(F.lit("en"), F.array("lang"))).select("doc_id", X.words_a(F.col("text"), X.light_fold).alias("w"))
    size = docs.select("doc_id", F.size("w").alias("len"))
    whole = size.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("average"))
    query_words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(X.words_a(F.col("text"), X.light_fold))).alias("word"))
    wanted = query_words.select("word").distinct()
    path = scratch(spark, "bm25")
    # both stored: texts are cut into words once for counts and scores, and weights are broadcast where they are small
    tf = stored(docs.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("word")).join(wanted, "word", "left_semi").groupBy("doc_id", "len", "word").agg(F.count(F.lit(1)).alias("tf")), f"{path}/tf")
    asked = stored(query_words.join(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word"), f"{path}/asked")
    n = whole.first()  # two numbers
    term = X.bm25_term(F.col("tf"), F.col("df"), F.lit(n["n"]), F.col("len"), F.lit(n["average"]))
    # a document's words stay together, so pairs of items and documents are added up where they are made, and not shuffled
    scored = tf.repartition("doc_id").join(asked, "word").groupBy("item_id", "doc_id").agg(F.round(F.sum(term), 6).alias("score")).where("score > 0")
    return core.top(scored, ["item_id"], [F.desc("score"), F.col("doc_id")], 3).select("item_id", "rank", "doc_id", "score")


#: Intent rules by priority; words of each feature.
FEATURES = {"place": ["with", "from", "at"], "state": ["is", "was", "are", "be"], "reason": ["for", "by", "to"], "many": ["the", "that", "this"]}
INTENTS = [("compare", 3.0, ["place"], ["state", "reason"], []), ("describe", 2.0, ["state"], [], ["place"]), ("explain", 2.0, ["reason"], ["many"], []), ("mention", 1.0, [], ["many", "place", "state", "reason"], [])]


def _intent_sql() -> str:
    feats = ", ".join(f"CASE WHEN list_has_any(w, {words!r}) THEN '{name}' END" for name, words in FEATURES.items())
    scores = ", ".join(
        f"CASE WHEN {' AND '.join([*(f"list_contains(f, '{x}')" for x in need), *([f'list_has_any(f, {some!r})'] if some else []), *(f"NOT list_contains(f, '{x}')" for x in none)]) or 'true'} "
        f"THEN round({prio} + 0.01 * len(list_filter({[*need, *some]!r}, lambda x: list_contains(f, x))), 6) END AS s{k}"
        for k, (_, prio, need, some, none) in enumerate(INTENTS)
    )
    best = "greatest(" + ", ".join(f"coalesce(s{k}, -1)" for k in range(len(INTENTS))) + ")"
    pick = " ".join(f"WHEN s{k} = {best} THEN '{name}'" for k, (name, *_) in enumerate(INTENTS))
    return f"""
WITH w AS (SELECT conv_id, turn, {_WORDS.format("text")} AS w FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, turn, list_filter([{feats}], lambda x: x IS NOT NULL) AS f FROM w),
s AS (SELECT conv_id, turn, {scores} FROM f)
SELECT conv_id, turn, CASE {pick} ELSE 'fallback' END AS intent, {best} AS score FROM s
"""


@query(_intent_sql())
def intent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by words, then the rule of the highest priority plus 0.01 for each matched group; earlier rules win ties."""
    words = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", X.words_a(F.col("text"), X.light_fold).alias("w"))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    found = words.withColumn("f", F.array_compact(F.array(*[F.when(F.arrays_overlap("w", lit(v)), F.lit(k)) for k, v in FEATURES.items()])))
    rules = [F.when(core.rule_holds(F.col("f"), lit(need), lit(some), lit(none)), F.struct(F.round(F.lit(prio) + 0.01 * F.size(F.array_intersect(lit([*need, *some]), F.col("f"))), 6).alias("score"), F.lit(-k).alias("k"), F.lit(name).alias("name"))) for k, (name, prio, need, some, none) in enumerate(INTENTS)]
    best = F.array_max(F.array_compact(F.array(*rules)))
    return found.withColumn("b", best).select("conv_id", "turn", F.coalesce(F.col("b.name"), F.lit("fallback")).alias("intent"), F.coalesce(F.col("b.score"), F.lit(-1.0)).alias("score"))


@query(
    """
SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]') THEN 'privacy' WHEN contains(lower(text), 'licens') THEN 'license'
  WHEN contains(text, ' | ') THEN 'table' WHEN lang <> 'en' THEN 'foreign' WHEN n_chars < 200 THEN 'short' ELSE 'prose' END AS route FROM documents
"""
)
def ordered_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    route = F.when(text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"), "privacy").when(F.contains(F.lower(text), F.lit("licens")), "license").when(F.contains(text, F.lit(" | ")), "table")
    return table(spark, sf_dir, "documents").select("doc_id", route.when(F.col("lang") != "en", "foreign").when(F.col("n_chars") < 200, "short").otherwise("prose").alias("route"))


# ---- extraction


@query(
    r"""
SELECT doc_id, count(*) AS numbers, max(length(n)) AS longest, min(n) AS first_number
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?\b')) AS n FROM documents) GROUP BY 1
"""
)
def identifier_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]+(?:\.[0-9]+)?\b"), F.lit(0))).alias("n"))
    return n.groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers"), F.max(F.length("n")).cast("long").alias("longest"), F.min("n").alias("first_number"))


#: Hosts of each evidence tier, first match wins.
TIERS = [("A", ["example.org"]), ("B", ["example.net"]), ("C", ["example.com"])]


@query(
    r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages),
t AS (SELECT host, CASE WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'A' WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'B'
  WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'C' ELSE 'NONE' END AS tier FROM h)
SELECT host, count(*) FILTER (WHERE tier = 'A') AS tier_a, count(*) FILTER (WHERE tier = 'B') AS tier_b, count(*) FILTER (WHERE tier = 'C') AS tier_c, count(*) FILTER (WHERE tier = 'NONE') AS unsupported FROM t GROUP BY 1
"""
)
def url_evidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    tier = F.lit("NONE")
    for name, hosts in reversed(TIERS):
        for h in hosts:
            tier = F.when(core.host_in(F.col("host"), F.lit(h)), name).otherwise(tier)
    n = lambda v: F.count_if(F.col("tier") == v)
    return host.withColumn("tier", tier).groupBy("host").agg(n("A").alias("tier_a"), n("B").alias("tier_b"), n("C").alias("tier_c"), n("NONE").alias("unsupported"))


@query(
    r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS li FROM pages),
a AS (SELECT page_id, regexp_extract(li, 'href="([^"]*)"', 1) AS target, regexp_replace(li, '<[^>]*>', '', 'g') AS label FROM l)
SELECT target, count(*) AS lines, count(DISTINCT page_id) AS pages, count(*) FILTER (WHERE contains(target, '://')) AS absolute, min(label) AS label FROM a GROUP BY 1
"""
)
def html_claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1))).alias("li"))
    rows = items.select("page_id", F.regexp_extract("li", 'href="([^"]*)"', 1).alias("target"), F.regexp_replace("li", "<[^>]*>", "").alias("label"))
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("page_id").alias("pages"), F.count_if(F.contains("target", F.lit("://"))).alias("absolute"), F.min("label").alias("label"))


# ---- dialogues


@query(
    """
WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
c AS (SELECT conv_id, count(*) AS turns, min_by(role, turn) AS first_role, max_by(role, turn) AS last_role, count(*) FILTER (WHERE role = before) AS repeats,
  count(*) FILTER (WHERE trim(text) = '') AS empty_turns, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(length(text)) AS chars FROM t GROUP BY 1)
SELECT first_role, last_role, count(*) AS conversations, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(repeats) AS BIGINT) AS adjacent_same_role, CAST(sum(empty_turns) AS BIGINT) AS empty_turns,
  CAST(sum(gaps) AS BIGINT) AS turn_gaps, CAST(sum(chars) AS BIGINT) AS chars, max(turns) AS longest FROM c GROUP BY 1, 2
"""
)
def conv_structure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    c = t.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role"), F.count_if(F.col("role") == F.col("before")).alias("repeats"),
        F.count_if(F.trim("text") == "").alias("empty_turns"), (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"), F.sum(F.length("text")).alias("chars"),
    )
    return c.groupBy("first_role", "last_role").agg(
        F.count(F.lit(1)).alias("conversations"), F.sum("turns").alias("turns"), F.sum("repeats").alias("adjacent_same_role"), F.sum("empty_turns").alias("empty_turns"), F.sum("gaps").alias("turn_gaps"), F.sum("chars").alias("chars"), F.max("turns").alias("longest")
    )


@query(
    """
WITH t AS (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE first IS NULL OR turn < first) AS opening_turns, CAST(coalesce(sum(length(text)) FILTER (WHERE first IS NULL OR turn < first), 0) AS BIGINT) AS opening_chars FROM t GROUP BY 1
"""
)
def conv_opening_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leading run before the first assistant turn."""
    c = table(spark, sf_dir, "conversations")
    run = F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    opens = F.col("run") == 0
    return c.withColumn("run", run).groupBy("conv_id").agg(F.count_if(opens).alias("opening_turns"), F.coalesce(F.sum(F.when(opens, F.length("text"))), F.lit(0)).cast("long").alias("opening_chars"))


@query(
    """
WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'system'),
v AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role <> CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END) AS wrong, min(CASE WHEN role <> CASE WHEN n % 2 = 1 THEN 'user' ELSE 'assistant' END THEN n END) AS first_wrong FROM t GROUP BY 1)
SELECT conv_id, turns, wrong, coalesce(first_wrong, 0) AS first_wrong, wrong = 0 AND turns % 2 = 0 AS holds FROM v
"""
)
def conv_turn_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and assistants alternate, users first, and the assistant has the last word."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("n", n)
    wrong = F.col("role") != F.when(F.col("n") % 2 == 1, "user").otherwise("assistant")
    v = t.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(wrong).alias("wrong"), F.coalesce(F.min(F.when(wrong, F.col("n"))), F.lit(0)).cast("long").alias("first_wrong"))
    return v.withColumn("holds", (F.col("wrong") == 0) & (F.col("turns") % 2 == 0))
