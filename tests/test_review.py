import json

from pyspark.sql import functions as F

from quern.operators import review


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_declared_changes(spark):
    j = json.dumps
    rows = [
        ("same", "invariant", j({"a": 1}), j({"a": 1}), [], ["/a"]), ("ok", "directional", j({"a": {"b/c": 1}, "k": [1, 2]}), j({"a": {"b/c": 2}, "k": [1, 2]}), ["/a/b~1c"], ["/k"]),
        ("hidden", "invariant", j({"a": 1, "b": 1}), j({"a": 2, "b": 1}), [], []), ("fact", "invariant", j({"a": 1}), j({"a": 2}), ["/a"], ["/a"]), ("list", "directional", j({"a": [1]}), j({"a": [1, 2]}), ["/a"], []),
        ("idle", "directional", j({"a": 1}), j({"a": 1}), ["/a"], []), ("none", "directional", j({}), j({}), [], []), ("null", "invariant", None, j({}), [], []), ("type", "invariant", j({"a": 1}), j({"a": True}), [], []),
    ]
    df = spark.createDataFrame(rows, "relation_id string, relation string, before string, after string, changed_fields array<string>, protected_facts array<string>")
    got = dict(rows_of(review.relation_audit(df), "relation_id", "status"))
    assert got == {"same": "HOLDS", "ok": "HOLDS", "hidden": "UNDECLARED_CHANGE", "fact": "FACT_CHANGED", "list": "HOLDS", "idle": "DECLARED_BUT_UNCHANGED", "none": "INSUFFICIENT", "null": "INSUFFICIENT", "type": "UNDECLARED_CHANGE"}


def test_reviewers_and_packets(spark):
    a = spark.createDataFrame([("1", "x", 1), ("2", "y", None)], "item string, f string, g int")
    b = spark.createDataFrame([("1", "x", 2), ("3", "z", 1)], "item string, f string, g int")
    assert rows_of(review.reviewer_fields(a, b, "item", ["f", "g"]), "field", "items", "decided", "equal", "agreement") == [("f", 3, 1, 1, 1.0), ("g", 3, 1, 0, 0.0)]
    items = spark.createDataFrame([(str(i),) for i in range(30)], "item string")
    one, two = (rows_of(review.blind_packet(x, "item", "seed", 3), "item", "part", "blind_id") for x in (items, items.orderBy(F.desc("item"))))
    assert one == two and len({r[2] for r in one}) == 30 and {r[1] for r in one} == {0, 1, 2}
    assert one != rows_of(review.blind_packet(items, "item", "other", 3), "item", "part", "blind_id")


def test_requested_slots(spark):
    slots = {"pain": ["疼痛"], "age": ["年龄", "多少岁"], "years": ["多少岁"], "date": ["日期"], "source": ["原文日期"]}
    texts = ["请问疼痛多久？不要告诉我年龄", "年龄多少？不必现在回复我", "你说“年龄多少？”疼痛多久", "原文日期是哪天？多少岁？", "年龄多少，疼痛多久？以上问题不用回答", "", None]
    got = {}
    for r in review.requested_slots(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), slots, "k").orderBy("k", "clause").collect():
        got.setdefault(r["k"], []).append((list(r["requested"]), r["reason"]))
    assert got == {
        0: [(["pain"], "direct_supported_request"), ([], "negated_request")], 1: [([], "cancelled_by_following_clause"), ([], "negated_request")], 2: [([], "no_direct_request"), (["pain"], "direct_supported_request")],
        3: [(["source"], "direct_supported_request"), ([], "unsupported_or_ambiguous_slot")], 4: [([], "cancelled_by_following_clause")] * 2 + [([], "negated_request")],
    }
    s = spark.createDataFrame([("c", ["a"], ["a"]), ("c", ["a", "b"], ["b", "z"])], "category string, expected array<string>, found array<string>")
    assert tuple(review.slot_scores(s).first()) == ("c", 2, 1, 1, 1, 0.5)


def test_alignment_and_source_audit(spark):
    t = spark.createDataFrame([(1, "hello world")], "id int, text string")
    sp = spark.createDataFrame([(1, 0, 4, "hello"), (1, 6, 10, "World"), (2, 0, 1, "x")], "id int, start int, end int, value string")
    assert rows_of(review.span_alignment(sp, t, "id"), "id", "value") == [(1, "World"), (2, "x")]
    turns = [("d", 0, "user", "hi", 1), ("d", 1, "user", "again", 1), ("d", 2, "user", " ", None), ("d", 3, "user", "so", 3), ("d", 4, "robot", "x", 4), ("e", 0, "user", "hi", 1), ("f", 0, "user", " hi ", 9)]
    got = {r["dialogue"]: r for r in review.source_audit(spark.createDataFrame(turns, "dialogue string, position int, role string, sentence string, turn_id int")).collect()}
    d = got["d"]
    assert (d["turns"], d["malformed"], d["blank"], d["without_id"], d["repeated_ids"], d["adjacent_same_role"], d["first_role"], d["last_role"]) == (5, 2, 1, 1, 1, 1, "user", "robot")
    assert got["e"]["signature"] == got["f"]["signature"] != d["signature"]
