import json
from hashlib import sha1, sha256

import pytest
from pyspark.sql import functions as F

from quern.operators import cues, entail, ledger, trust


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def digest(v):
    return sha256(json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_payload_digests_leave_provenance_out(spark):
    body = {"b": "é", "a": 1, "_training_export_context": {"x": 1}, "benchmark_provenance": {"stage": "S5", "materialized_payload_sha256": "zz"}}
    rows = spark.createDataFrame([(json.dumps(body),), ("[1]",), ("no json",), (None,)], "t string")
    want = digest({"b": "é", "a": 1, "benchmark_provenance": {"stage": "S5"}})
    assert [r[0] for r in rows.select(trust.payload_digest(F.col("t"))).collect()] == [want, None, None, None]
    core = rows.limit(1).select(trust.core_digest(F.col("t"), ("a", "c"))).first()[0]
    assert core == digest({"a": 1, "c": None})


def test_policy_and_authentication(spark):
    cases = spark.createDataFrame([("c1", "dev", "b1", "k"), ("c1", "heldout", "b2", "k"), ("ｃ", "odd", None, None), (None, "dev", "b1", "z")], "case_id string, split string, blob string, core string")
    sources = spark.createDataFrame([("p", "s1", "b9", "k")], "path string, case_id string, blob string, core string")
    got = rows_of(trust.policy_violations(cases, sources), "entity", "rule")
    assert got == sorted([("c1", "REPEATED_ID"), ("b1", "REPEATED_BLOB"), ("k", "CORE_IN_SEVERAL_SPLITS"), ("p", "SOURCE_DERIVED_FROM_BENCHMARK"), ("ｃ", "ID_NOT_CANONICAL"), ("ｃ", "UNKNOWN_SPLIT"), ("ｃ", "MISSING_BLOB"), (None, "MISSING_ID")], key=repr)
    assert trust.policy_violations(cases.limit(0), sources.limit(0)).count() == 0
    blob = sha1(b"blob 2\0{}").hexdigest()
    entries = spark.createDataFrame([("f/a", "f", blob), ("f/b", "f", blob), ("f/../c", "f", blob), ("g/a", "f", blob)], "path string, base string, blob string")
    files = spark.createDataFrame([("f/a", bytearray(b"{}")), ("f/b", bytearray(b"[]")), ("g/a", bytearray(b"{}"))], "path string, content binary")
    assert rows_of(trust.authentication(entries, files), "entity", "rule") == [("f/../c", "FILE_MISSING"), ("f/../c", "OUTSIDE_FOLDER"), ("f/b", "BLOB_MISMATCH"), ("g/a", "OUTSIDE_FOLDER")]


def test_materialised_cases_and_partition_decisions(spark):
    refs = spark.createDataFrame([("f", "c1", "dev", "base", "p1"), ("f", "c2", "heldout", "base", "p2")], "family_id string, case_id string, split string, variant_type string, path string")
    bodies = spark.createDataFrame([("p1", '{"b":1,"a":2}'), ("p2", "{}")], "path string, case_json string")
    made = trust.materialised(refs, bodies, {"suite_id": "s"}, ["dev"], ["heldout", "regression"])
    one = {r["case_id"]: r for r in made.collect()}
    assert one["c1"]["training_eligible"] and not one["c2"]["training_eligible"] and one["c1"]["payload_sha256"] == digest(json.loads(one["c1"]["body"]))
    with pytest.raises(ValueError):
        trust.materialised(refs, bodies, {}, ["dev", "heldout"], ["heldout", "regression"])
    plain = '{"x":1}'
    asked = [("c1", one["c1"]["body"], None), ("c1", "{}", None), ("c2", one["c2"]["body"], None), ("o1", plain, None), ("o1", "{}", None), ("o2", plain, None), ("o3", plain, "dev"), (None, None, None)]
    sources = spark.createDataFrame([("o1", digest({"x": 1}))], "case_id string, payload_sha256 string")
    got = rows_of(trust.partition_decisions(spark.createDataFrame(asked, "case_id string, payload string, declared_split string"), made, sources), "case_id", "eligible", "reason")
    assert got == sorted([("c1", True, None), ("c1", False, "PAYLOAD_DIVERGES_FROM_AUTHORITY"), ("c2", False, "SPLIT_IS_EVALUATION_ONLY"), ("o1", True, None), ("o1", False, "PAYLOAD_DIVERGES_FROM_SOURCE"), ("o2", False, "NO_AUTHORITY"), ("o3", False, "PARTITIONED_WITHOUT_AUTHORITY"), (None, False, "NO_AUTHORITY")], key=repr)
    assert rows_of(trust.materialisation_summary(made), "split", "cases", "eligible", "blocked", "families") == sorted([(None, 2, 1, 1, 1), ("dev", 1, 1, 0, 1), ("heldout", 1, 0, 1, 1)], key=repr)


def test_exports_are_gated(spark):
    rows = [("a", "sft", "approved", "x", None, None), ("b", "sft", "approved", "x", None, None), ("r", "sft", "approved", "x", None, None), ("a", "preference", "approved", None, "x", "y"), ("a", "preference", "approved", None, "x", "x"), ("a", "preference", "approved", "x", None, None), ("a", "sft", "approved", None, None, None), ("a", "sft", "draft", "x", None, None), ("a", None, "approved", "x", None, None), ("z", "sft", "approved", "x", None, None)]
    c = spark.createDataFrame(rows, "case_id string, kind string, review_status string, ideal string, chosen string, rejected string")
    gate = spark.createDataFrame([("a", "ALLOW"), ("b", "BLOCK"), ("r", "REVIEW")], "case_id string, decision string")
    got = rows_of(trust.export_manifest(trust.export_rows(c, gate)), "exported", "why", "n")
    assert got == sorted([("sft", None, 1), ("preference", None, 1), ("blocked", "LINEAGE_BLOCK", 1), ("blocked", "LINEAGE_REVIEW", 1), ("blocked", "MISSING_DIFFERENCE", 1), ("blocked", "MISSING_REJECTED", 1), ("blocked", "MISSING_IDEAL", 1), ("skipped", "NOT_APPROVED", 1), ("skipped", "NO_KIND", 1), ("blocked", "NO_DECISION", 1)], key=repr)
    assert rows_of(trust.unknown_cases(c, gate), "entity") == [("z",)]


STATE = "edge_id string, slot string, claim string, effective string, status string, superseded_by string, conflicts_with array<string>"
BROKEN = [
    ("DUPLICATE_CLAIM_DATE", [("a", "s", "c", "1", "SUPERSEDED", "b", []), ("b", "s", "c", "1", "ACTIVE", None, [])]),
    ("MULTI_DATE_CURRENT_FRONTIER", [("a", "s", "c", "1", "ACTIVE", None, []), ("b", "s", "d", "2", "CONTESTED", None, [])]),
    ("MULTI_ACTIVE_FRONTIER", [("a", "s", "c", "1", "ACTIVE", None, []), ("b", "s", "d", "1", "ACTIVE", None, [])]),
    ("ACTIVE_CONTESTED_COEXIST", [("a", "s", "c", "1", "ACTIVE", None, []), ("b", "s", "d", "1", "CONTESTED", None, [])]),
    ("SINGLETON_CONTESTED", [("b", "s", "d", "1", "CONTESTED", None, [])]),
    ("INCOMPLETE_CONTESTED_CLIQUE", [("a", "s", "c", "1", "CONTESTED", None, []), ("b", "s", "d", "1", "CONTESTED", None, [])]),
    ("DANGLING_CONFLICT_REF", [("a", "s", "c", "1", "ACTIVE", None, ["zz"])]),
    ("ASYMMETRIC_CONFLICT_REF", [("a", "s", "c", "1", "CONTESTED", None, ["b"]), ("b", "s", "d", "1", "CONTESTED", None, [])]),
    ("CROSS_SLOT_OR_DATE_CONFLICT", [("a", "s", "c", "1", "ACTIVE", None, ["b"]), ("b", "t", "d", "1", "ACTIVE", None, ["a"])]),
    ("MISSING_SUPERSEDED_BY", [("a", "s", "c", "1", "SUPERSEDED", None, [])]),
    ("CROSS_SLOT_SUPERSESSION", [("a", "s", "c", "1", "SUPERSEDED", "b", []), ("b", "t", "d", "1", "ACTIVE", None, [])]),
    ("BACKWARD_TIME_SUPERSESSION", [("a", "s", "c", "2", "SUPERSEDED", "b", []), ("b", "s", "d", "1", "ACTIVE", None, [])]),
    ("STALE_ACTIVE_PRESENT", [("a", "s", "c", "1", "ACTIVE", "b", [])]),
]


def test_every_invariant_can_break(spark):
    named = [(f"{k}{e}", f"{k}{s}", *x, f"{k}{by}" if by else None, [f"{k}{r}" for r in refs]) for k, (_, rows) in enumerate(BROKEN) for e, s, *x, by, refs in rows]
    got = dict(rows_of(ledger.invariants(spark.createDataFrame(named, STATE)), "rule", "violations"))
    assert set(got) == set(ledger.INVARIANTS) == {r for r, _ in BROKEN} and min(got.values()) >= 1
    for rule, rows in BROKEN[::4]:
        assert dict(rows_of(ledger.invariants(spark.createDataFrame(rows, STATE)), "rule", "violations"))[rule] >= 1
    assert {r["violations"] for r in ledger.invariants(spark.createDataFrame([], STATE)).collect()} == {0}


def test_lifecycle_of_late_and_contested_edges(spark):
    events = [("s", "a", "2024-01-02", "1", 1), ("s", "b", "2024-01-02", "2", 1), ("s", "c", "2024-01-01", "3", 1), ("s", "d", "2024-01-03", "4", 1), ("s", "d", "2024-01-03", "5", 2), ("s", "a", "2024-01-01", "6", 1)]
    e = spark.createDataFrame(events, "slot string, claim string, effective string, seq string, source int").withColumn("effective", F.to_date("effective"))
    s = ledger.lifecycle(ledger.actions(e))
    got = {(r["claim"], str(r["effective"])): r for r in s.collect()}
    a, b, c, d, late = (got[k] for k in (("a", "2024-01-02"), ("b", "2024-01-02"), ("c", "2024-01-01"), ("d", "2024-01-03"), ("a", "2024-01-01")))
    assert a["superseded_by"] == b["superseded_by"] == d["edge_id"] and d["superseded_by"] is None and d["status"] == "ACTIVE"
    assert a["conflicts_with"] == [b["edge_id"]] and c["conflicts_with"] == []
    assert c["superseded_by"] == min(a["edge_id"], b["edge_id"]) and late["superseded_by"] == d["edge_id"]
    assert sum(r["violations"] for r in ledger.invariants(s).collect()) == 0


def test_small_readers(spark):
    t = [("```json\n{\"a\": {\"b\": [1, \"x\"]}}\n```",), ("so {\"a\": 1} it is",), ("none",), (None,), ("{broken",)]
    j = spark.createDataFrame(t, "t string").withColumn("j", cues.fenced_json(F.col("t")))
    assert [r[0] for r in j.select(cues.json_at(F.col("j"), cues.pointer_path("/a/b/1"))).collect()] == ["x", None, None, None, None]
    assert [r["j"] is not None for r in j.collect()] == [True, True, False, False, False]
    notes = spark.createDataFrame([("a", "[[b]] and [[old|shown]] [[gone#x]] [[ b ]]"), ("b", "plain"), ("c", None)], "name string, body string")
    got = dict(rows_of(cues.links_repaired(notes, spark.createDataFrame([("old", "a")], "old string, new string")), "name", "body"))
    assert got == {"a": "[[b]] and [[a|shown]] gone [[b]]", "b": "plain", "c": None}
    s = spark.createDataFrame([("已上市",), ("phase II",), ("",), (None,)], "s string").select(cues.stage(F.col("s"))).collect()
    assert [r[0] for r in s] == ["MARKETED", "PHASE2", "UNKNOWN", "UNKNOWN"]
    rel = spark.createDataFrame([(1, "mail a@b.org", "x"), (2, "clean", " "), (3, None, "x"), (4, "token = abc", None)], "id int, t string, src string")
    assert rows_of(cues.release_violations(rel, "id", "t", ["src"]), "id", "rule") == [(1, "EMAIL"), (2, "MISSING_SRC"), (4, "MISSING_SRC"), (4, "SECRET")]


def test_verdicts_on_odd_rows(spark):
    kind = "case_id string, subject string, predicate string, object string, polarity string, population string, operator string, value double, low double, high double"
    p = lambda case, pred, pol="POSITIVE", op=None, v=None, lo=None, hi=None, pop=None: (case, "s", pred, "o", pol, pop, op, v, lo, hi)
    claims = [("1", *p("a", "DISCONTINUE", op="EQ", v=20.0)), ("2", *p("a", "DISCONTINUE", op="EQ", v=40.0)), ("3", *p("a", "DISCONTINUE", "NEGATIVE", op="EQ", v=40.0)), ("4", *p("a", "CONTRAINDICATED", op="EQ", v=20.0)), ("5", *p("b", "DISCONTINUE", op="EQ", v=20.0)), ("6", *p("a", "DISCONTINUE")), ("7", *p(None, "REPORTS")), ("8", *p("a", "DISCONTINUE", op="EQ", v=20.0, pop="child"))]
    evidence = [(*p("a", "DISCONTINUE", op="LT", v=30.0), "EXACT_DOMAIN"), (*p(None, "REPORTS", "NEGATIVE"), None)]
    c = spark.createDataFrame(claims, "claim_id string, " + kind)
    e = spark.createDataFrame(evidence, kind + ", semantics string")
    got = dict(rows_of(entail.verdicts(c.union(c), e.union(e)), "claim_id", "verdict"))
    assert got == {"1": "SUPPORTED", "2": "CONTRADICTED", "3": "SUPPORTED", "4": "CONTRADICTED", "5": "UNSUPPORTED", "6": "CONTRADICTED", "7": "CONTRADICTED", "8": "SUPPORTED"}
    assert set(dict(rows_of(entail.verdicts(c, e.limit(0)), "claim_id", "verdict")).values()) == {"UNSUPPORTED"} and entail.verdicts(c.limit(0), e).count() == 0
    r = entail.relations(spark.createDataFrame([("a",), ("z",)], "case_id string"), spark.createDataFrame([("a", "1", "SUPPORTED"), ("a", "2", "CONTRADICTED")], "case_id string, claim_id string, verdict string"))
    assert rows_of(r, "case_id", "relation") == [("a", "PARTIAL_SUPPORT"), ("z", "DOES_NOT_SUPPORT")]
