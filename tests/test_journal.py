"""Journals against a plain chain, controls against all pairs, and small operators mended with them."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import cues, diagnosis, extract, governance, journal, trust
from quern.operators import evaluation as ev
from quern.sources import sinks


def test_journal_is_a_chain_and_goes_on(spark):
    kind = "key string, seq int, payload string"
    rows = [("a", 2, "y"), ("a", 1, "x"), (None, 1, None), ("a", 3, "")]
    one = journal.appended(spark.createDataFrame(rows, kind))
    got = {(r["key"], r["number"]): r for r in one.collect()}
    last = ""
    for n, p in enumerate(["x", "y", ""], 1):
        assert got["a", n]["previous"] == last and got["a", n]["payload"] == p
        last = hashlib.sha256(f"{last}|{p}".encode()).hexdigest()
        assert got["a", n]["digest"] == last
    more = journal.appended(spark.createDataFrame([("a", 1, "z"), ("b", 1, "n")], kind), journal.heads(one))
    assert sorted((r["key"], r["number"]) for r in more.collect()) == [("a", 4), ("b", 1)]
    assert journal.faults(one.union(more), journal.heads(one.union(more))).count() == 0
    assert journal.appended(spark.createDataFrame([], kind)).count() == 0


def test_journal_faults(spark):
    log = journal.appended(spark.createDataFrame([(k, n, f"{k}{n}") for k in "abcdef" for n in range(1, 6)], "key string, seq int, payload string")).toPandas()
    known = spark.createDataFrame(log)
    heads = journal.heads(known)
    at = lambda k, n: (log.key == k) & (log.number == n)
    log.loc[at("a", 3), "payload"] = "rewritten"
    log = log[~at("b", 2)]
    three, four = at("c", 3), at("c", 4)
    log.loc[three, "number"], log.loc[four, "number"] = 4, 3
    log = log[~at("d", 5)]
    log.loc[at("e", 2), ["payload", "digest"]] = ["forged", hashlib.sha256((log.loc[at("e", 2), "previous"].iloc[0] + "|forged").encode()).hexdigest()]
    twice = log[at("f", 1)]
    damaged = spark.createDataFrame(log).union(spark.createDataFrame(twice))
    got = sorted(tuple(r) for r in journal.faults(damaged, heads).collect())
    assert got == [("a", 3, "CHANGED"), ("b", 3, "MISSING"), ("c", 3, "REORDERED"), ("c", 4, "REORDERED"), ("c", 5, "REORDERED"), ("d", 5, "TRUNCATED"), ("e", 3, "BROKEN_LINK"), ("f", 1, "REPEATED"), ("f", 1, "REPEATED")]


def test_replayed_states_differ(spark):
    kind = "key string, status string, value int"
    a, b = spark.createDataFrame([("x", "on", 1), ("y", "on", None), ("z", "on", 1)], kind), spark.createDataFrame([("x", "off", 1), ("y", "on", None), ("w", None, None)], kind)
    assert sorted((r["key"], r["column"]) for r in journal.differing(a, b, "key", ["status", "value"]).collect()) == [("w", "status"), ("w", "value"), ("x", "status"), ("z", "status"), ("z", "value")]


def test_controls_differ_in_one_factor(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice("pq"), rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"]), rng.randint(0, 1), rng.choice(["fail", "pass", None]), "C3", rng.choice(["black_box", "instrumented", "odd"])) for k in range(160)]
    names = ["run", "criterion", "f", "g", "h", "outcome", "module", "observability"]
    df = spark.createDataFrame(rows, "run int, criterion string, f string, g string, h int, outcome string, module string, observability string")
    got = {(r["run"], r["factor"]): r for r in diagnosis.controls(df, "run", ["criterion"], ["f", "g", "h"]).collect()}
    want: dict = {}
    for a in (dict(zip(names, r)) for r in rows if r[5] == "fail"):
        for b in (dict(zip(names, r)) for r in rows if r[5] == "pass" and r[1] == a["criterion"]):
            apart = [x for x in "fgh" if a[x] != b[x]]
            if len(apart) == 1:
                want.setdefault((a["run"], apart[0]), set()).add(b["run"])
    assert set(got) == set(want) and all(r["control"] in want[k] for k, r in got.items())
    found = diagnosis.hypotheses(df, "run", ["criterion"], ["f", "g", "h"]).collect()
    seen = {r[0]: r[7] for r in rows}
    assert {r["evidence_level"] for r in found if r["factor"]} == {"verified_under_test", "supported_hypothesis"}
    assert all(diagnosis.GRADES[seen[r["run"]]] == r["evidence_level"] for r in found if r["factor"])
    assert sum(r["evidence_level"] == diagnosis.OPEN for r in found) == 2 * sum(r[5] == "fail" for r in rows)


def test_merged_paths_are_nested(spark):
    m = spark.createDataFrame([({"a": "1", "b.c": "2", "b.d": "3", "e": "4"}, {"a.x": "5", "b": "6"}, ["e"])], "base map<string, string>, patch map<string, string>, drop array<string>")
    assert m.select(cues.merged(F.col("base"), F.col("patch"), F.col("drop")).alias("m")).first()["m"] == {"a.x": "5", "b": "6"}


def test_errors_in_json_values(spark):
    rows = [('["x", "y"]', 2), ('"one"', 1), ("plain text", 1), ('""', 0), ("[]", 0), ("null", 0), (None, 0), ('{"a": 1}', 0), (" ", 0)]
    got = [r["n"] for r in spark.createDataFrame(rows, "v string, n int").select(ev.errors_in(F.col("v")).alias("n")).collect()]
    assert got == [n for _, n in rows]


def test_dates_with_names_of_months(spark):
    e = spark.createDataFrame([("x", "Mar 05, 2024"), ("x", "Mar 5, 2023"), ("x", "2024-02"), ("x", "soon"), ("y", "2025")], "entity string, event_date string")
    got = governance.watch_events(e, spark.createDataFrame([("x",)], "entity string"), F.lit("2024-01-01").cast("timestamp"))
    assert {r["event_date"] for r in got.collect()} == {"Mar 05, 2024", "2024-02", "soon"}


def test_another_variable_between_guards_a_condition(spark):
    df = spark.createDataFrame([("egfr with age below 30",), ("egfr is below 30",)], "t string")
    assert [len(r["c"]) for r in df.select(extract.conditions(F.col("t"), "egfr", ("age",)).alias("c")).collect()] == [0, 1]


def test_one_digest_of_sorted_lines(spark):
    rows = [(f"p{k:04}", hashlib.sha256(str(k).encode()).hexdigest()) for k in range(900)]
    want = hashlib.sha256("\n".join(sorted(f"{h}  {p}" for p, h in rows)).encode()).hexdigest()
    assert tuple(trust.aggregate_digest(spark.createDataFrame(rows, "path string, sha256 string").repartition(9)).first()) == (900, want)
    assert tuple(trust.aggregate_digest(spark.createDataFrame([], "path string, sha256 string")).first()) == (0, hashlib.sha256(b"").hexdigest())


def test_reports_are_one_object(spark, tmp_path):
    a = spark.createDataFrame([(2, "x"), (1, None)], "n int, s string")
    sinks.create_report(spark, {"rows": a, "none": a.where("n > 5")}, str(tmp_path / "r"))
    (part,) = list((tmp_path / "r").glob("part-*"))
    assert json.loads(part.read_text()) == {"rows": [{"n": 1}, {"n": 2, "s": "x"}], "none": []}
    with pytest.raises(Exception):
        sinks.create_report(spark, {"rows": a}, str(tmp_path / "r"))
    with pytest.raises(sinks.ContractViolation):
        sinks.create_report(spark, {"rows": a}, str(tmp_path / "s"), most=1)
