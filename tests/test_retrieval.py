import datetime
import json
import math

from pyspark.sql import functions as F

from quern.operators import retrieval
from quern.sources import adapters
from quern.streaming import disclosure


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_bm25_over_the_eligible_only(spark):
    d = datetime.date
    rows = [("p1", "renal dose dose", None, None, ["all"]), ("p2", "renal dose", d(2020, 1, 1), d(2020, 12, 31), ["Adult"]), ("p3", "renal dose dose dose", d(2021, 1, 1), None, ["adult"]), ("p4", "renal", None, None, None), ("p5", "other text here", None, None, ["adult"])]
    p = spark.createDataFrame(rows, "id string, text string, valid_from date, valid_to date, population array<string>")
    q = spark.createDataFrame([("q", "Dose dose"), ("none", "absent"), ("empty", "")], "query_id string, query string")
    got = retrieval.rank_evidence(q, p, 3, F.lit("2020-12-31").cast("date"), F.lit(" Adult")).collect()
    n, average = 3, 8 / 3
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    want = {i: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / average)) for i, tf, size in (("p1", 2, 3), ("p2", 1, 2))}
    assert [(r["query_id"], r["rank"], r["id"]) for r in got] == [("q", 1, "p1"), ("q", 2, "p2")] and all(abs(r["score"] - want[r["id"]]) < 1e-9 for r in got)
    assert retrieval.rank_evidence(q, p, 0).count() == 0 and retrieval.rank_evidence(q, p.limit(0)).count() == 0
    assert {r["id"] for r in retrieval.rank_evidence(q, p, 9).collect()} == {"p1", "p2", "p3"}
    bad = spark.createDataFrame([("a", "x", d(2021, 1, 1), d(2020, 1, 1)), ("a", None, None, None), (None, "t", None, None)], "id string, text string, valid_from date, valid_to date")
    assert rows_of(retrieval.passage_violations(bad), "id", "rule") == sorted([("a", "REVERSED"), ("a", "NO_TEXT"), ("a", "REPEATED_ID"), (None, "NO_ID")], key=repr)


def test_sections_entities_evidence(spark):
    q = spark.createDataFrame([("q", ["Renal", "dose"])], "query_id string, words array<string>")
    s = spark.createDataFrame([("d", 1, "Renal dosing", "dose by weight"), ("d", 2, "Warnings", "renal dose"), ("d", 3, "Other", "nothing")], "doc_id string, position int, title string, text string")
    pref = spark.createDataFrame([("q", "warnings")], "query_id string, title string")
    assert rows_of(retrieval.rank_sections(q, s, pref), "rank", "title", "score") == [(1, "Warnings", 8), (2, "Renal dosing", 5)]
    e = spark.createDataFrame([("Alpha", "target"), ("Alpha Beta", "x"), ("Gamma", None)], "entity string, body string")
    qs = spark.createDataFrame([(1, "what is alpha beta?"), (2, "gamma"), (3, "nothing")], "question_id int, question string")
    assert rows_of(retrieval.find_entity(qs, e), "question_id", "entity", "score") == [(1, "Alpha Beta", 10), (2, "Gamma", 100), (3, None, None)]
    cases, bad = retrieval.inject_evidence(spark.createDataFrame([("c", ["p2", "p1", "p3"]), ("d", ["zz"]), ("e", [])], "case_id string, allowed array<string>"), spark.createDataFrame([("p1", "one"), ("p2", "two"), ("p3", "three")], "id string, text string"), 2)
    assert {r["case_id"]: r["evidence"] for r in cases.where("case_id <> 'd'").collect()} == {"c": ["two", "one"], "e": []} and rows_of(bad, "case_id", "missing") == [("d", "zz")]


def test_entity_overlap(spark):
    links = [("X", "t1"), ("X", "i1"), ("Y", "t1"), ("Y", "i1"), ("Y", "X"), ("Z", "t1")]
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "a string, b string")
    kinds = spark.createDataFrame([("t1", "target"), ("i1", "indication")], "node string, kind string")
    got = {r["entity"]: (r["shared"], r["score"], r["level"]) for r in retrieval.entity_overlap(edges, kinds, "X").collect()}
    assert got["Y"] == (2, round(0.3 / 1.5 + 0.25 / 1.5 + 0.1, 6), "note") and got["Z"] == (1, 0.2, "none")


def test_disclosure(spark):
    facts, events = {"pain": "it hurts", "age": "forty"}, [(2, "collapse", "I feel faint")]
    asked = [(1, ["pain"]), (2, ["age"]), (3, ["pain", "age"]), (4, ["pain"]), (5, ["x"]), (6, [])]
    df = spark.createDataFrame([("s", t, a, facts, events, 5) for t, a in asked] + [("e", 1, ["pain"], None, None, 0)], "session_id string, turn int, slots array<string>, facts map<string,string>, events array<struct<turn:int,name:string,text:string>>, budget int")
    got = rows_of(disclosure.play(df), "session_id", "turn", "kind", "item")
    assert got == sorted([("s", 1, "fact", "pain"), ("s", 2, "event", "collapse"), ("s", 3, "fact", "age"), ("s", 4, "repeat", "pain"), ("s", 5, "unmatched", None), ("s", 6, "ended", None), ("e", 1, "ended", None)], key=repr)


def test_recorded_answers(spark, tmp_path):
    rows = [{"adapter": "trial", "query": "q", "status": 200, "fetched_at": "2024-01-01", "body": {"b": 1, "a": 2}}, {"adapter": "label", "query": "q", "status": 404, "fetched_at": "2024-01-01", "body": None}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    adapters.register(spark)
    df = spark.read.format("recorded").option("paths", str(tmp_path / "r.jsonl"))
    assert rows_of(df.load(), "adapter", "status", "body") == [("label", 404, "null"), ("trial", 200, '{"a": 2, "b": 1}')]
    assert df.option("adapter", "trial").load().count() == 1


def test_shared_neighbours_are_counted_in_cells(spark, monkeypatch):
    import itertools
    import random
    from collections import Counter

    monkeypatch.setattr(retrieval, "COUNTED", 64)
    rng = random.Random(4)
    ids = [-300, -1, 0, 5, 255, 256, 300, 65535, 65536, 70000, 1 << 33]
    edges = sorted({(rng.choice(ids), rng.randrange(40)) for _ in range(300)})
    want = Counter(p for n in range(40) for p in itertools.combinations(sorted(s for s, m in edges if m == n), 2))
    e = spark.createDataFrame([*edges, (None, 1), (5, None), (256, None)], "s long, n long")
    assert {(r["a"], r["b"]): r["shared"] for r in retrieval.shared_neighbours(e).collect()} == want and len(want) > 40
    assert retrieval.shared_neighbours(e.limit(0)).count() == 0
    plan = retrieval.shared_neighbours(e)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_scores_of_pairs_are_not_shuffled(spark, tmp_path):
    """A document's words stay together: no exchange is by item and document, and texts are cut for the counts only once."""
    from quern.plans import text_plans

    spark.createDataFrame([(1, "Dose dose of the drug", "en"), (2, "the drug", "en"), (3, "", "en"), (4, None, "en"), (5, "drug drug", "de"), *[(k, f"word{k} dose other words", "en") for k in range(10, 3000)]], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "the dose"), (8, "drug"), (9, "absent")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = text_plans.bm25_topk(spark, str(tmp_path))
    assert rows_of(got, "item_id", "rank", "doc_id") == [(7, 1, 2), (7, 2, 1), (7, 3, 10), (8, 1, 2), (8, 2, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    keys = [line.split("hashpartitioning(")[1].split("),")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert keys and not any("item_id" in k and "doc_id" in k for k in keys)


def test_pairs_are_never_broadcast(spark, tmp_path):
    """However few pairs Spark expects of a small table, no join of the run collects them at the driver; suppliers without a row stay."""
    import itertools

    from quern.plans import data_plans

    met = [(s, p) for p in range(40) for s in range(60) if (s * 7 + p) % 3] + [(3, None), (None, 5), (99, 7)]
    nation = {s: s % 4 for s in range(60)} | {5: None}
    spark.createDataFrame(met + met[:50], "l_suppkey long, l_partkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(list(nation.items()), "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = data_plans.neighbor_overlap(spark, str(tmp_path))
    rows = {(r["a"], r["b"]): r for r in got.collect()}
    own = {s: {p for x, p in met if x == s} for s, _ in met}
    want = {}
    for a, b in itertools.combinations(sorted(s for s in own if s is not None), 2):
        if shared := len(own[a] & own[b] - {None}):
            score = round(0.75 * min(1, shared / 150) + (0.25 if None is not nation.get(a) == nation.get(b) else 0), 6)
            want[a, b] = (shared, len(own[a]) - shared, len(own[b]) - shared, score, "alert" if score >= 0.75 else "watch" if score >= 0.5 else "note")
    assert {k: tuple(r)[2:] for k, r in rows.items()} == want and len(want) > 1000 and any(99 in k for k in want)
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in final and "BuildLeft" not in final
