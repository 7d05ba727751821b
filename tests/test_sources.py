import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources import readers, sinks


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"i": 1}\n\n{"i": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"i": 1}\nbroken\n')
    (tmp_path / "o.json").write_text('{\n "i": 7,\n "x": "y"}')
    schema = T.StructType([T.StructField("i", T.LongType())])
    assert sorted(r["i"] for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2]
    bad = readers.json_lines(spark, str(tmp_path / "b.jsonl"), schema, audit=True).cache().where("_corrupt_record is not null").collect()
    assert [r["_corrupt_record"] for r in bad] == ["broken"] and bad[0]["source_file"].endswith("b.jsonl")
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "b.jsonl"), schema).collect()
    assert readers.json_objects(spark, str(tmp_path / "o.json"), "i long, x string").first()["x"] == "y"


def test_snapshots_pins_and_families(spark, tmp_path):
    fam = tmp_path / "F1"
    (fam / "cases").mkdir(parents=True)
    (fam / "cases/a.json").write_text('{"b": 1}')
    manifest = {"family_id": "F1", "status": "draft", "cases": [{"case_id": "a", "variant_type": "base", "split": "dev", "path": "cases/a.json"}, {"case_id": "b", "variant_type": "x", "split": "dev", "path": "cases/none.json"}]}
    (fam / "manifest.json").write_text(json.dumps(manifest))
    files = readers.folder(spark, str(tmp_path))
    snap = readers.snapshots(files).withColumn("v", F.expr("variant_get(body, '$.b', 'int')")).first()
    assert snap["sha256"] == hashlib.sha256(b'{"b": 1}').hexdigest() and snap["v"] == 1
    both = readers.folder(spark, str(tmp_path), leave_out=None)
    cases = readers.family_cases(readers.snapshots(both).where("path like '%manifest.json'"), both)
    assert {r["case_id"]: r["case_json"] for r in cases.collect()} == {"a": '{"b": 1}', "b": None}
    pin = [(snap["path"], 8, snap["sha256"], "0" * 40), ("gone", 1, "", "")]
    got = {(r["path"][-6:], r["rule"]) for r in readers.pin_violations(files, spark.createDataFrame(pin, "path string, length long, sha256 string, git_sha1 string")).collect()}
    assert got == {("a.json", "GIT_SHA1"), ("gone", "MISSING")}


def test_notes(spark, tmp_path):
    (tmp_path / "A.md").write_text("---\ntype: drug\nname: A: x\n---\nintro [[B]] and [[sub/C|see]]\n# One\ntext\n## Two\nmore [[A]]\n")
    (tmp_path / "B.md").write_text("no front matter")
    (tmp_path / "reports").mkdir()
    (tmp_path / "reports/R.md").write_text("[[A]]")
    rows = readers.notes(spark, str(tmp_path))
    a = {r["name"]: r for r in rows.collect()}
    assert set(a) == {"A", "B"} and a["A"]["fields"] == {"type": "drug", "name": "A: x"} and a["A"]["links"] == ["B", "C", "A"]
    assert sorted(tuple(r) for r in readers.note_edges(rows).collect()) == [("A", "B"), ("B", "A")]
    parts = [(r["heading"], r["text"]) for r in readers.markdown_sections(rows.where("name = 'A'")).orderBy("number").collect()]
    assert parts == [(None, "intro [[B]] and [[sub/C|see]]"), ("One", "text"), ("Two", "more [[A]]")]


def test_event_log_and_xml(spark, tmp_path):
    log = [("r", 1, "session_meta", "m1"), ("r", 2, "token_count", "5"), ("r", 3, "token_count", "9"), ("q", 1, "other", "z")]
    got = {r["run_id"]: (r["meta"], r["tokens"], r["completion"], r["events"]) for r in readers.event_log(spark.createDataFrame(log, "run_id string, line_no int, type string, payload string")).collect()}
    assert got == {"r": ("m1", "9", None, 3), "q": (None, None, None, 1)}
    (tmp_path / "l.xml").write_text("<d><section><title>T</title><text>body</text></section></d>")
    assert tuple(readers.xml_sections(spark, str(tmp_path / "l.xml")).first()) == ("T", "body")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>")], "i int, s string")
    sinks.create_lines(df, str(tmp_path / "x"))
    with pytest.raises(Exception):
        sinks.create_lines(df, str(tmp_path / "x"))
    assert "&lt;b&gt;" in sinks.html_table(df, "t") and "<b>" not in sinks.html_table(df, "t")
    sinks.fail_closed(df.where("i > 1"))
    with pytest.raises(sinks.ContractViolation):
        sinks.fail_closed(df)


def test_training_rows_fail_closed(spark, tmp_path):
    kind = "case_id string, run_id string, model_id string, split string, kind string, review_status string, ideal_response string, chosen string, rejected string"
    runs = spark.createDataFrame([("c1", "m", "r1", "p1", 1), ("c2", "m", "r9", "p2", 2)], "case_id string, model_id string, run_id string, prompt string, seq int")
    good = [("c1", "r1", "m", "dev", "sft", "approved", "answer", None, None), ("c2", "lost", "m", "dev", "preference", "approved", None, "a", "b"), ("c3", "x", "m", "heldout", "sft", "draft", None, None, None)]
    got = sinks.training_rows(spark.createDataFrame(good, kind), runs, str(tmp_path / "s"), str(tmp_path / "p"))
    assert {r["kind"]: r["n"] for r in got.collect()} == {"sft": 1, "preference": 1, "skipped": 1}
    assert spark.read.json(str(tmp_path / "p")).first()["prompt"] == "p2"
    bad = [("c1", "r1", "m", "heldout", "sft", "approved", "answer", None, None)]
    with pytest.raises(sinks.ContractViolation):
        sinks.training_rows(spark.createDataFrame(bad, kind), runs, str(tmp_path / "s2"), str(tmp_path / "p2"))
    assert not (tmp_path / "s2").exists()
