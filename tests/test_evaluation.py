from pyspark.sql import functions as F

from quern.operators import evaluation as ev
from quern.operators import governance as gov


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_routing_metrics(spark):
    gold = spark.createDataFrame([("1", "i", "a", ["a", "b"], True), ("2", "j", "c", ["c"], True), ("3", "k", "d", ["d"], False), ("4", "k", "d", ["d"], False)], "query_id string, intent string, primary string, acceptable array<string>, high_risk boolean")
    pred = spark.createDataFrame([("1", "i", ["b", "a"]), ("2", "x", ["z"]), ("3", "k", ["d"])], "query_id string, intent string, ranked array<string>")
    r = ev.routing_metrics(gold, pred).first().asDict()
    more = {"type_accuracy": None, "freshness_accuracy": None, "wrong_authority_rate": 0.5, "secondary_as_gold_rate": 0.0}
    assert r == more | {"queries": 4, "intent_accuracy": 0.5, "primary_at_1": 0.25, "acceptable_at_3": 0.5, "missing": 1, "primary_as_secondary": 1, "critical_miss_rate": 0.5}


def test_bags_count_repeats_and_nulls(spark):
    kind = "item string, s string, o string"
    gold = spark.createDataFrame([("1", "a", None), ("1", "a", None), ("1", "b", "x"), ("2", "a", "y")], kind)
    pred = spark.createDataFrame([("1", "a", None), ("1", "c", "x"), ("2", "a", "y"), ("2", "a", "y")], kind)
    assert tuple(ev.bag_counts(gold, pred, "item", ["s", "o"]).first()) == (2, 2, 2, 0.5, 0.5, 0.5)
    assert tuple(ev.bag_counts(gold.limit(0), pred.limit(0), "item", ["s", "o"]).first()) == (0, 0, 0, None, None, None)


def test_detection_and_tags(spark):
    rows = spark.createDataFrame([("t1", True, "BLOCK"), ("t1", True, "REVIEW"), ("t2", False, "BLOCK"), ("t2", False, "REVIEW"), ("t2", False, "ALLOW")], "t string, bad boolean, d string")
    r = ev.detection(rows, F.col("bad"), F.col("d")).first().asDict()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["precision"], r["recall"], r["clean_false_block"], r["clean_review"]) == (1, 1, 1, 2, 0.5, 0.5, 0.333333, 0.333333)
    assert ev.detection(rows, F.col("bad"), F.col("d"), ["t"]).count() == 2
    tags = spark.createDataFrame([(["x", "y"], True), (["x"], False)], "tags array<string>, ok boolean")
    assert rows_of(ev.by_tag(tags, "tags", F.col("ok")), "tag", "n", "accuracy") == [("x", 2, 0.5), ("y", 1, 1.0)]


def test_stages_sets_and_errors(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, False), (3, None, True)], "i int, a boolean, b boolean")
    assert rows_of(df.select("i", ev.first_failure([("a", F.col("a")), ("b", F.col("b"))]).alias("s")), "i", "s") == [(1, "passed"), (2, "b"), (3, "a")]
    x = spark.createDataFrame([("p",), ("q",)], "k string")
    assert rows_of(ev.set_differences(x, spark.createDataFrame([("q",), ("r",)], "k string"), "k"), "k", "side") == [("p", "missing"), ("r", "extra")]
    e = spark.createDataFrame([(["a", "b"],), (None,), ([],)], "e array<string>")
    assert e.agg(ev.error_count(F.col("e"))).first()[0] == 2
    av = spark.createDataFrame([(True, True), (True, False), (False, False)], "a boolean, r boolean")
    assert tuple(ev.availability(av, F.col("a"), F.col("r")).first())[:4] == (3, 0.666667, 0.5, 0.333333)


CRITERIA = "suite string, criterion_id string, kind string, critical boolean, required boolean"
OBSERVED = "session_id string, criterion_id string, outcome string, source string, evidence array<string>, reason string, applicability string"


def test_session_scores_keep_unknown(spark):
    criteria = spark.createDataFrame([("x", "c1", "clinical", True, True), ("x", "c2", "mechanical", False, False), ("x", "c3", "mechanical", False, True)], CRITERIA)
    sessions = spark.createDataFrame([(f"s{k}", "x", s) for k, s in enumerate(["completed", "completed", "target_error", "measurement_invalid", "completed"])], "session_id string, suite string, status string")
    seen = [
        ("s0", "c1", "pass", "human"), ("s0", "c2", "pass", "deterministic"), ("s0", "c3", "pass", "human"), ("s1", "c1", "pass", "deterministic"), ("s1", "c2", "fail", "human"),
        ("s2", "c3", "not_applicable", "human"), ("s3", "c1", "fail", "human"), ("s4", "c1", "fail", "human"), ("s4", "c3", "not_applicable", "human"),
    ]
    obs = spark.createDataFrame([(*r, ["t1"], "why", None) for r in seen], OBSERVED)
    assert ev.observation_violations(obs, criteria).count() == 0
    s = ev.session_scores(ev.criterion_results(obs, criteria, sessions))
    got = rows_of(s, "session_id", "pass", "fail", "unassessed", "not_applicable", "operational_unmet", "coverage", "critical_failure", "complete", "fully_passed")
    assert got == [
        ("s0", 3, 0, 0, 0, 0, 1.0, False, True, True), ("s1", 0, 1, 2, 0, 0, 0.333333, None, False, False),
        ("s2", 0, 2, 1, 0, 2, 0.0, None, False, False), ("s3", 0, 0, 3, 0, 0, 0.0, None, False, False), ("s4", 0, 1, 1, 1, 0, 0.5, True, False, False),
    ]
    r = ev.suite_summary(s).first()
    assert (r["sessions"], r["valid"], r["invalid"], r["target_errors"], r["complete"], r["fully_passed"], r["critical_failures"], r["critical_assessed"]) == (5, 4, 1, 1, 1, 1, 1, 2)
    assert (r["service_completion"], r["critical_failure_rate"], r["coverage"]) == (0.75, 0.5, round(5 / 11, 6))
    assert ev.suite_summary(s.limit(0)).first()["coverage"] is None


def test_a_legitimate_stop_leaves_a_criterion_inapplicable(spark):
    criteria = spark.createDataFrame([("x", "c1", "mechanical", True, True)], CRITERIA)
    sessions = spark.createDataFrame([("a", "x", "target_error"), ("b", "x", "target_error")], "session_id string, suite string, status string")
    obs = spark.createDataFrame([("a", "c1", "not_applicable", "human", [], "end", "legitimate_stop"), ("b", "c1", "not_applicable", "human", [], "end", None)], OBSERVED)
    assert rows_of(ev.criterion_results(obs, criteria, sessions), "session_id", "outcome", "operational_unmet") == [("a", "not_applicable", False), ("b", "fail", True)]


def test_observation_violations(spark):
    criteria = spark.createDataFrame([("x", "c1", "mechanical", True, True)], CRITERIA)
    rows = [("a", "c1", "pass", "human", [], None, None), ("a", "c1", "pass", "human", ["t"], None, None), ("b", "zz", "maybe", "robot", None, None, None), ("c", "c1", "not_applicable", "human", None, "", None)]
    got = rows_of(ev.observation_violations(spark.createDataFrame(rows, OBSERVED), criteria), "session_id", "rule")
    assert got == [("a", "NO_EVIDENCE"), ("a", "REPEATED"), ("b", "INVALID_OUTCOME"), ("b", "INVALID_SOURCE"), ("b", "UNKNOWN_CRITERION"), ("c", "NO_REASON")]
    runs = spark.createDataFrame([("c1", "m"), ("c1", None)], "config string, model string")
    assert rows_of(ev.comparison_violations(runs, ["config", "model"]), "rule", "values") == [("UNLIKE_MODEL", 2)]


def test_paired_deltas(spark):
    kind = "f string, r string, side string, v double"
    good = [("f1", "1", "a", 0.5), ("f1", "1", "b", 0.7), ("f1", "2", "a", 0.5), ("f1", "2", "b", 0.5), ("f2", "1", "a", 0.0), ("f2", "1", "b", 1.0), ("f2", "1", "other", 0.3)]
    delta, bad = ev.paired_deltas(spark.createDataFrame(good, kind), ["f", "r"], "f", "side", "v", "a", "b")
    assert [(r["f"], r["pairs"], round(r["delta"], 6)) for r in delta.orderBy("f").collect()] == [("f1", 2, 0.1), ("f2", 1, 1.0)] and bad.count() == 0
    wrong = [("f1", "1", "a", 0.5), ("f2", "1", "a", 0.5), ("f2", "1", "a", 0.6), ("f2", "1", "b", 1.5), ("f3", "1", "a", float("nan")), ("f3", "1", "b", 0.1)]
    assert rows_of(ev.paired_deltas(spark.createDataFrame(wrong, kind), ["f", "r"], "f", "side", "v", "a", "b")[1], "f", "rule") == [("f1", "UNMATCHED"), ("f2", "OUT_OF_RANGE"), ("f2", "REPEATED"), ("f3", "OUT_OF_RANGE")]


def test_dialogue_helpers(spark):
    t = "pair_id int, turn int, role string, content string"
    a = spark.createDataFrame([(1, 0, "u", "x"), (1, 1, "a", "y"), (2, 0, "u", "x")], t)
    b = spark.createDataFrame([(1, 0, "u", "x"), (1, 1, "a", "z"), (2, 0, "u", "x")], t)
    assert rows_of(ev.prefix_divergence(a, b), "pair_id", "first_difference") == [(1, 1), (2, None)]
    m = spark.createDataFrame([("s", 1, "system"), ("s", 2, "user"), ("s", 3, "tool"), ("s", 4, "user")], "session_id string, seq int, role string")
    assert rows_of(ev.turn_groups(m), "seq", "user_turn") == [(1, 0), (2, 1), (3, 1), (4, 2)]
    tr = spark.createDataFrame([("s", "transition", True, None), ("s", "transition", False, None), ("s", "event", None, False)], "session_id string, kind string, matched boolean, reached boolean")
    assert tuple(ev.harness_quality(tr).first()) == (2, 1, 0.5, 1, 1)


def test_truth_event_reasons(spark):
    names = ["subject_id", "predicate", "object_id", "effective_at", "source_id", "passage_id", "locator", "source_version", "retrieved_at", "s3_relation", "review_status", "source_scope"]
    ok = ["s", "p", "o", "2024-01-01", "a", "b", "c", "d", "e", "DIRECT_SUPPORT", "verified", None]

    def put(**kw):
        return tuple(kw.get(n, v) for n, v in zip(names, ok))

    rows = [put(), put(object_id=" "), put(effective_at="soon", locator=None), put(locator=None), put(s3_relation="PARTIAL"), put(review_status=None), put(source_scope="synthetic_controlled")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)).withColumns({"proposition": F.lit("p"), "provenance": F.lit("v")})
    bare = df.limit(1).withColumn("provenance", F.lit(None).cast("string")).union(df.limit(1).select(*names, F.lit(None).cast("string"), F.lit("v")))
    assert [r[0] for r in bare.select(gov.truth_event_reason("external")).collect()] == ["MISSING_PROVENANCE", "MISSING_PROPOSITION"]
    assert [r[0] for r in df.select(gov.truth_event_reason("external")).collect()] == [None, "MISSING_OBJECT_ID", "INVALID_EFFECTIVE_AT", "MISSING_PROVENANCE_LOCATOR", "S3_RELATION_NOT_DIRECT_SUPPORT", "SOURCE_NOT_VERIFIED", "SYNTHETIC_PARTITION_VIOLATION"]
    assert [r[0] for r in df.limit(1).select(gov.truth_event_reason("benchmark_synthetic")).collect()] == ["EXTERNAL_PARTITION_VIOLATION"]


def test_graph_merge(spark):
    nodes = spark.createDataFrame([("n1", "drug", "A", ["x"], ["s1"]), ("n1", "drug", "A", ["y", "x"], ["s2"]), ("n2", "test", "B", [], []), ("n2", "drug", "B", [], [])], "node_id string, node_type string, label string, contexts array<string>, sources array<string>")
    edges = spark.createDataFrame([("n1", "treats", "n9", ["x"], ["s1"]), ("n1", "treats", "n9", ["z"], ["s1"])], "subject_id string, predicate string, object_id string, contexts array<string>, sources array<string>")
    n, e, bad = gov.graph_merge(nodes, edges)
    assert rows_of(n.where("node_id = 'n1'"), "contexts", "sources") == [(["x", "y"], ["s1", "s2"])] and rows_of(e, "contexts") == [(["x", "z"],)]
    assert rows_of(bad, "entity", "rule") == [("n2", "TYPE_CONFLICT"), ("n9", "DANGLING_END")]


def test_family_and_source_contracts(spark):
    fam = spark.createDataFrame([("F1",), ("F2",)], "family_id string")
    cases = spark.createDataFrame([("F1", "a", "base", "dev", "{}"), ("F1", "a", "heldout", "dev", None)], "family_id string, case_id string, variant_type string, split string, case_json string")
    assert {r["rule"] for r in gov.family_violations(fam, cases).collect()} == {"FILE_MISSING", "SPLIT_MISMATCH", "REPEATED_CASE", "NO_CASES", "NO_HELDOUT"}
    got = gov.source_violations(spark.createDataFrame([("s1", "https://a.who.int/x"), ("s2", "https://evil.com")], "source_id string, url string"), spark.createDataFrame([("c", "s9", "p9")], "claim_id string, source_id string, passage_id string"), spark.createDataFrame([("p1", None)], "passage_id string, locator string"), ["who.int"])
    assert rows_of(got, "entity", "rule") == [("p1", "NO_LOCATOR"), ("p9", "UNKNOWN_PASSAGE"), ("s2", "HOST_NOT_ALLOWED"), ("s9", "UNKNOWN_SOURCE")]
    dup = spark.createDataFrame([("x", "dev", 1), ("x", "heldout", 1), ("y", "dev", 2)], "a string, split string, b int")
    assert gov.cross_split_duplicates(dup, gov.core_fingerprint(["b", "a"])).count() == 1


def test_releases_relations_vaults(spark):
    f = lambda rows: gov.release(spark.createDataFrame(rows, "status string")).first()["gate"]
    assert [f([]), f([("gold_approved",)]), f([("gold_approved",), (None,)])] == ["FAIL", "PASS", "FAIL"]
    g = gov.gates(spark.createDataFrame([("a", 0.9)], "name string, value double"), spark.createDataFrame([("a", 0.8, True), ("b", 0.1, True), ("c", 0.1, False)], "name string, least double, required boolean"))
    assert rows_of(g, "name", "status") == [("a", "PASS"), ("b", "FAIL"), ("c", "SKIP")]
    rel = "subject string, predicate string, object string"
    known = spark.createDataFrame([], rel)
    new = spark.createDataFrame([("x", "supplies", "y")], rel)
    once = gov.insert_relations(known, new, {"supplies": "supplied_by"})
    assert rows_of(once, "subject", "predicate", "object") == rows_of(gov.insert_relations(once, new, {"supplies": "supplied_by"}), "subject", "predicate", "object") == [("x", "supplies", "y"), ("y", "supplied_by", "x")]
    v = gov.merge_vaults(spark.createDataFrame([("a", "1"), ("b", "2")], "name string, content string"), spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "name string, content string"))
    assert rows_of(v, "name", "action", "target") == [("a", "identical", "a"), ("b", "conflict", "b-imported"), ("c", "copy", "c")]
    w = gov.watch_events(spark.createDataFrame([("e", "2024-05"), ("e", "2023"), ("e", "soon"), ("z", "2024-05-01")], "entity string, event_date string"), spark.createDataFrame([("e",)], "entity string"), F.lit("2024-01-01").cast("timestamp"))
    assert [r["event_date"] for r in w.collect()] == ["soon", "2024-05"]
    p = spark.createDataFrame([("a/b",), ("../x",), ("a/../../x",), ("/etc",), ("a/../b",)], "p string").select(gov.inside_folder(F.lit("base"), F.col("p")))
    assert [r[0] for r in p.collect()] == [True, False, False, False, True]
