import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.functions import concepts as C
from quern.functions import text as X
from quern.operators import privacy


def one(spark, value, *columns, kind="s string"):
    return spark.createDataFrame([(value,)], kind).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_forms(spark):
    s = F.col("s")
    r = one(spark, "  Ｔest STRASSE—Straße\n\t2 ", X.word_form(s), X.dense_form(s), X.spaced_form(s), X.is_nfkc(s), X.slug(s))
    assert list(r) == ["test strasse strasse 2", "teststrasse—strasse2", "Test STRASSE—Straße 2", False, "est_strasse_stra_e_2"]
    assert list(one(spark, None, X.word_form(s), X.dense_form(s), X.spaced_form(s), X.is_nfkc(s), X.slug(s))) == [None, None, None, None, "unknown"]


def test_identities(spark):
    s = F.col("s")
    r = one(spark, "abc", X.short_id("slot:", s), X.edge_id(F.lit("n"), s, F.lit("p"), F.lit("o")), X.git_blob_sha1(s))
    assert r[0] == "slot:" + hashlib.sha256(b"abc").hexdigest()[:20]
    assert r[1] == hashlib.sha1(b"n|abc|p|o").hexdigest()[:16]
    assert r[2] == hashlib.sha1(b"blob 3\0abc").hexdigest()
    body = {"b": [" x  y "], "a": {"d": 1, "c": "é"}}
    r = one(spark, json.dumps(body), X.canonical_json(s), X.tidy_json(s))
    assert r[0] == '{"a":{"c":"é","d":1},"b":[" x  y "]}' and r[1] == '{"a":{"c":"é","d":1},"b":["x y"]}'


def test_failure_labels(spark):
    rows = spark.createDataFrame([(" stale (old)",), ("tool-failure: x",), ("Judge Drift[2]",), ("new thing",), (None,)], "s string")
    assert [r[0] for r in rows.select(X.failure_label(F.col("s"))).collect()] == ["STALE_KNOWLEDGE", "BAD_TOOL_CALL", "JUDGE_INCONSISTENCY", "NEW_THING", None]


def test_tokens(spark):
    s = F.col("s")
    r = one(spark, "The DOSE is 5mg with warfarin, dose!", X.words_a(s), X.content_words(s), X.words_c(s))
    assert r[0] == ["the", "dose", "is", "5mg", "with", "warfarin", "dose"]
    assert r[1] == ["dose", "5mg", "warfarin"] and r[2] == ["dose", "5mg", "warfarin", "dose"]
    r = one(spark, "abcde", X.char_ngrams(s), X.char_ngrams(F.lit("abc")), X.char_ngrams(F.lit("")), X.turn_ngrams(F.array(s, F.lit("ab"))))
    assert list(r) == [["abcd", "bcde"], ["abc"], [], ["abc", "bcd", "cde", "ab"]]
    assert one(spark, "肾功能 don't 药 x-ray", X.words_b(s))[0] == ["肾功", "功能", "药", "don't", "x-ray"]


def test_spans_and_masks(spark):
    s = F.col("s")
    text = "mail a.b@c.org or +86 139-1234-5678, id 110101199003078888, QQ号：123456 住址是北京路1号。"
    r = one(spark, text, privacy.cue_spans(s))
    assert [(x["kind"], text[x["start"] : x["end"]]) for x in r[0]] == [("email", "a.b@c.org"), ("mobile", "+86 139-1234-5678"), ("national_id", "110101199003078888"), ("contact_handle", "123456"), ("address", "北京路1号")]
    ids = ["110101199013078888", "110101199003078888", "110101179903078888", "110101199003070008", "110101199002300123"]
    got = spark.createDataFrame([(i,) for i in ids], "s string").select(privacy.plausible_id(s)).collect()
    assert [r[0] for r in got] == [False, True, False, False, False]
    m = spark.createDataFrame([("say “a 「b」 c” end",), ("open “x",), (None,)], "s string").withColumn("q", X.quoted_spans(s)).select(X.quotes_masked(s, F.col("q"))).collect()
    assert [r[0] for r in m] == ["say         ; end", "open   ", None]
    leaf = json.dumps({"a": {"b": ["too short", "This string has more than five words in it, surely"]}})
    assert [(x["path"], x["text"]) for x in one(spark, leaf, X.leaf_strings(s))[0]] == [("a.b[1]", "this string has more than five words in it surely")]


def test_negation_scope(spark):
    cases = [("this is not a rash", "rash", False), ("this is not rash", "rash", True), ("no, not looking for rash", "rash", True), ("not this. rash", "rash", False), ("rash is not needed", "rash", True), ("不要rash", "rash", True), ("not: rash", "rash", False), ("rash 除外", "rash", True), ("without any rash", "rash", False)]
    df = spark.createDataFrame([(t, t.index(w), t.index(w) + len(w), want) for t, w, want in cases], "s string, a int, b int, want boolean")
    assert [r["g"] == r["want"] for r in df.select(X.negated_at(F.col("s"), F.col("a"), F.col("b")).alias("g"), "want").collect()] == [True] * len(cases)
    assert [list(r[0]) if r[0] is not None else None for r in spark.createDataFrame([("aa aaa b",), ("x",), ("",), (None,)], "s string").select(X.phrase_places(F.col("s"), "aa")).collect()] == [[0, 3], [], [], None]


def test_redaction(spark):
    texts = spark.createDataFrame([(1, "call Ann and Bob"), (2, "Bob again"), (3, None), (4, "none")], "id int, text string")
    spans = spark.createDataFrame([(1, "name", 5, 8), (1, "name", 13, 16), (2, "name", 0, 3)], "id int, kind string, start int, end int")
    got = {r["id"]: r["text"] for r in privacy.redacted(texts, spans, "id").collect()}
    assert got == {1: "call [REDACTED_NAME_1] and [REDACTED_NAME_2]", 2: "[REDACTED_NAME_2] again", 3: None, 4: "none"}
    bad = spans.union(spark.createDataFrame([(1, "Name", 4, 6), (4, "name", 0, 9)], "id int, kind string, start int, end int"))
    assert sorted((r["id"], r["rule"]) for r in privacy.violations(texts, bad, "id").collect()) == [(1, "BAD_KIND"), (1, "OVERLAP"), (4, "OUT_OF_BOUNDS")]
    with pytest.raises(ValueError):
        privacy.redacted(texts, bad, "id")
    assert privacy.redacted(texts.limit(0), spans.limit(0), "id").count() == 0


def test_language_and_concepts(spark):
    rows = [("かな 漢字", "ja"), ("漢字", "zh"), ("한국 かな", "ko"), ("evidencia del protocolo", "es"), ("protocolo", "en"), ("a dog", "en"), (None, None)]
    got = spark.createDataFrame(rows, "s string, want string").select(C.language(F.col("s")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)
    s = F.col("s")
    r = one(spark, "the hypothesis level trial was unverified 12 3 x5", C.concepts(s), C.numbers(s), C.identifiers(F.lit("Ab-12, a-1 NCT-7x nct-7X x_ab-1")), C.roles(F.lit("ALT 40; halt; blood  sugar")))
    assert [list(x) for x in r] == [["unverified_source", "hypothesis_only"], ["12", "3"], ["ab-12", "nct-7x"], ["hepatic_enzyme", "glucose"]]


def test_similarity(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")), F.array().cast("array<string>")
    r = one(spark, "", X.dice(a, b), X.dice(none, none), X.dice(a, none), X.jaccard(a, b), X.jaccard(none, none), X.containment(a, b), X.containment(none, a), X.blended(a, b, a, a))
    assert list(r) == [0.5, 1.0, 0.0, 1 / 3, None, 0.5, 0.0, 0.71]


def test_negation_reads_from_the_last_mark_without_a_pattern(spark):
    import random
    import re

    rng = random.Random(7)
    marks = ["not ", "no ", "不要", "x", " ", "。", "!", ";", "\n", "\r\n", "\r", "\u2028", "é"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(9))) for _ in range(400)] + ["not\n", "not \r\n", "not\n\n", "not\u2028", "!\n"]
    rows = [(k, t + "pubmed", len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, t string, at int").withColumn("before", F.regexp_extract(F.substring("t", 1, F.col("at")), r"[^。！？!?;；\n]*$", 0))
    want = F.col("before").rlike(X.NEGATES_HAN) | F.col("before").rlike(X.NEGATES)
    got = df.select(X.negated_at(F.col("t"), F.col("at"), F.col("at") + 6).alias("got"), want.alias("want"), "t").collect()
    assert all(r["got"] == r["want"] for r in got) and {r["want"] for r in got} == {True, False}
    plan = df.select(X.negated_at(F.col("t"), F.col("at"), F.col("at") + 6))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("regexp_extract", plan)
