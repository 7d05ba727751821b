import json

import pytest
from pyspark.sql import functions as F

from quern.operators import ledger
from quern.plans import text_plans
from quern.sources import readers, sinks


def test_relation_files_and_turns(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"entities": [{"name": "A", "type": "drug"}], "relations": [{"subject": "A", "predicate": "p", "object": "B"}]}))
    e, r = readers.relation_file(spark, str(tmp_path / "r.json"))
    assert tuple(e.first()) == ("A", "drug") and tuple(r.first()) == ("A", "p", "B")
    m = [("s", 1, "user", "q1", None), ("s", 2, "assistant", "call", "t1"), ("s", 3, "tool", "out", "t1"), ("s", 4, "user", "q2", None)]
    got = {x["user_turn"]: x for x in readers.session_turns(spark.createDataFrame(m, "session_id string, seq int, role string, content string, tool_call_id string")).collect()}
    assert got[1]["text"] == "q1" and got[1]["steps"][0]["content"] == "call" and got[1]["results"][0]["tool_call_id"] == "t1" and got[2]["steps"] == []


def test_reports_and_allow_lists(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, secret string")
    assert sinks.markdown_table(df, "T").splitlines()[-1] == "| a\\|b |  |"
    hidden = df.withColumn("secret", F.lit("SENTINEL"))
    assert sinks.visible(hidden, ["x"], "SENTINEL").columns == ["x"]
    with pytest.raises(sinks.ContractViolation):
        sinks.visible(hidden, ["x", "secret"], "SENTINEL")


def test_rollback_and_state_hash(spark):
    rows = [("s", "a", "2024-01-01", "001", 1, True), ("s", "b", "2024-01-02", "002", 2, True), ("s", "c", None, "003", 3, False)]
    df = spark.createDataFrame(rows, "slot string, claim string, effective string, seq string, source long, accepted boolean")
    back = ledger.without_last(df)
    assert [r["seq"] for r in back.orderBy("seq").collect()] == ["001", "003"]
    state = lambda d: ledger.state_hash(ledger.edges(ledger.actions(d.where("accepted")))).first()["state"]
    assert state(back) == state(df.limit(1)) != state(df) and state(df) == state(df.orderBy(F.desc("seq")))


def test_null_texts_keep_their_component(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, None), (3, "a b"), (4, "A  b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in text_plans.near_dup_components(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 3, 0)]
