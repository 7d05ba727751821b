"""SQLite tables, trees of sections, and the interfaces' requests and answers."""

import json
import sqlite3
from urllib.parse import urlencode

from pyspark.sql import functions as F

from quern.sources import interfaces, sqlite, trees


def _database(path):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, session_id TEXT, seq INT, role TEXT, content TEXT, tool_calls TEXT, tool_call_id TEXT, cost REAL)")
    calls = json.dumps([{"id": "t1", "function": {"name": "search", "arguments": "{}"}}, {"id": "t2", "name": "read", "arguments": "x"}])
    rows = [(1, "s", 1, "assistant", "early", calls, None, None), (2, "s", 2, "user", "q", None, None, 0.5), (7, "s", 3, "assistant", "a", calls, None, 1.5), (8, "s", 4, "tool", "old", None, "t1", None), (9, "s", 5, "tool", "found", None, "t1", None), (900, "r", 1, "user", "o'clock", "broken", None, None)]
    db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    db.execute("CREATE TABLE none (a INT)")
    db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
    db.execute("INSERT INTO keyed VALUES ('a', 1)")
    db.commit()
    db.close()


def test_sqlite_ranges_filters_and_tool_calls(spark, tmp_path):
    path = str(tmp_path / "s.db")
    _database(path)
    m = sqlite.table(spark, path, "messages", 3)
    assert m.rdd.getNumPartitions() == 3 and m.count() == 6 and dict(m.dtypes)["cost"] == "double"
    some = sqlite.table(spark, path, "messages", 3, [("id", ">=", 7), ("role", "in", ["tool", "assistant"]), ("tool_call_id", "not null"), ("content", "starts", "fo")])
    assert [r["id"] for r in some.collect()] == [9]
    assert sqlite.table(spark, path, "messages", where=[("content", "=", "o'clock"), ("role", "<>", "tool"), ("cost", "null")]).count() == 1
    # filters of one frame leave others of the same table alone
    assert m.where("id >= 7").count() == 4 and m.count() == 6 and m.where("role = 'tool'").union(m).count() == 8
    calls = sorted((r["user_turn"], r["name"], r["arguments"], r["result"]) for r in sqlite.tool_calls(m).collect() if r["user_turn"])
    assert calls == [(1, "read", "x", None), (1, "search", "{}", "found")]
    assert sqlite.table(spark, path, "none").count() == 0 and sqlite.table(spark, path, "keyed").first()["v"] == 1


XML = """<d xmlns="urn:x"><versionNumber value="7"/><section><title>One <b>bold</b></title><text>Top
text</text><section><title>Two</title><section><text>deep</text></section></section></section><section/><section><title>Last</title><text/></section></d>"""


def test_xml_trees_nest(spark):
    files = spark.createDataFrame([("a", XML.encode()), ("bad", b"<x><y></x>"), ("none", None), ("empty", b"")], "path string, content binary").withColumn("title", F.lit("extra"))
    t = trees.xml_tree(files)
    got = [tuple(r) for r in t.where("path = 'a'").orderBy("number").collect()]
    assert got == [("a", 1, 0, 1, "7", "one bold", "top text", None), ("a", 2, 1, 2, "7", "two", "", None), ("a", 3, 2, 3, "7", "", "deep", None), ("a", 5, 0, 1, "7", "last", "", None)]
    assert [r["path"] for r in t.where("error is not null").collect()] == ["bad"]
    assert {r["number"]: r["titles"] for r in trees.lineage(t).collect()}[3] == ["one bold", "two", ""]
    assert trees.xml_tree(files.limit(0)).count() == 0


MD = """intro
# A
text
## B
- **U1 depth**：2 = deep
- plain
### C
## D
```yaml
type: 'case'
tags:
- x
- y
note: a: b
```
# E"""


def test_markdown_trees(spark):
    notes = spark.createDataFrame([("n", MD), ("null", None), ("blank", " ")], "name string, body string")
    rows = {r["heading"]: r for r in trees.markdown_tree(notes).collect()}
    number = {h: r["number"] for h, r in rows.items()}
    assert {h: r["parent"] for h, r in rows.items()} == {None: None, "A": None, "B": number["A"], "C": number["B"], "D": number["A"], "E": None}
    b = notes.where("name = 'n'").select(trees.fenced_fields(F.col("body")).alias("f")).first()["f"]
    assert [tuple(x) for x in b] == [("type", "case", False), ("tags", "x", True), ("tags", "y", True), ("note", "a: b", False)]
    s = spark.createDataFrame([(rows["B"]["text"],)], "t string").select(trees.list_items(F.col("t")).alias("i"), trees.anchors(F.col("t")).alias("a")).first()
    assert s["i"] == ["**U1 depth**：2 = deep", "plain"] and [tuple(x) for x in s["a"]] == [("U1", "depth", "2 = deep")]


def test_requests(spark):
    def url(adapter, **query):
        return spark.createDataFrame([(query,)], "q map<string, string>").select(interfaces.request(adapter, F.col("q")).alias("u")).first()["u"]

    assert url("label", drug_name="a b*~/é") == "https://dailymed.nlm.nih.gov/dailymed/services/v2/spls.json?" + urlencode({"drug_name": "a b*~/é", "name_type": "both", "pagesize": 100, "page": 1})
    assert url("approvals", application_number="NDA1") == "https://api.fda.gov/drug/drugsfda.json?" + urlencode({"search": 'application_number:"NDA1"', "limit": 10})
    assert url("trial", nct_id="N 1") == "https://clinicaltrials.gov/api/v2/studies/N%201"
    assert url("literature", term="x", retmax="9").endswith("db=pubmed&term=x&retmode=json&retmax=9") and url("drug_name") is None


def test_answers(spark):
    bodies = [
        ("label", {"data": [{"title": "T", "setid": "s", "spl_version": 2, "published_date": "Mar 05, 2024"}, {"title": "T2", "setid": "s", "spl_version": 3, "published_date": "Mar 5, 2024"}, {"setid": "u", "published_date": "soon"}]}),
        ("label", {"data": []}), ("approvals", {"results": [{"application_number": "N1"}, {}]}), ("trial", {"protocolSection": {"identificationModule": {"nctId": "N", "briefTitle": "B"}}}), ("drug_name", {"idGroup": {"rxnormId": ["1", "2"]}}), ("drug_name", {"idGroup": None}),
        ("literature", {"esearchresult": {"idlist": ["9", "8"]}}), ("adverse_event", {"meta": {"results": {"total": 4}}}), ("adverse_event", [1]),
    ]
    rows = [(a, f"q{k}", 200, "now", json.dumps(b)) for k, (a, b) in enumerate(bodies)] + [("trial", "odd", 500, "now", "no json"), ("trial", "null", 404, "now", None)]
    rec = spark.createDataFrame(rows, "adapter string, query string, status int, fetched_at string, body string")
    found = interfaces.labels(rec).collect()
    assert [(r["query"], r["result_count"], r["setid"], str(r["published"])) for r in sorted(found, key=lambda r: (r["query"], r["place"] or 0))] == [("q0", 3, "s", "2024-03-05"), ("q0", 3, "s", "2024-03-05"), ("q0", 3, "u", "None"), ("q1", 0, None, "None")]
    assert {r["setid"]: r["title"] for r in interfaces.latest_labels(interfaces.labels(rec)).collect()} == {"s": "T2", "u": None}
    assert [r["application_number"] for r in interfaces.approvals(rec).collect()] == ["N1", None]
    assert {(r["query"], r["nct_id"], r["overall_status"]) for r in interfaces.trials(rec).collect()} == {("q3", "N", None), ("odd", None, None), ("null", None, None)}
    assert sorted(r["rxnorm_id"] for r in interfaces.drug_names(rec).collect()) == ["1", "2"]
    assert [(r["place"], r["pmid"]) for r in interfaces.literature(rec).collect()] == [(0, "9"), (1, "8")]
    assert {r["query"]: r["total"] for r in interfaces.adverse_events(rec).collect()} == {"q7": 4, "q8": None}
