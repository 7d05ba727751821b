import json

import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import extract, lineage

FIELDS = ["task", "context"]
KIND = "case_id string, task string, context string"
PROTECTED = "Patient with metformin and eGFR 28 should stop treatment immediately according to label"


def decide(spark, candidates, references, allowed):
    c = spark.createDataFrame(candidates, KIND)
    scored = lineage.pairs(c, spark.createDataFrame(references, KIND), spark.createDataFrame(allowed, KIND), FIELDS)
    return {r["candidate_id"]: r for r in lineage.decisions(c, scored).collect()}, scored


def test_pairs_and_decisions(spark):
    refs = [("R1", "advise", PROTECTED), ("R2", "summarise", "Zolpidem quantity exceeded threshold during overnight monitoring ward seventeen")]
    allowed = [("A1", "advise", "Patient with common words should stop")]
    cands = [
        ("same", "advise", PROTECTED), ("span", "other task entirely", json.dumps(["Unrelated opening words here", PROTECTED + ".", "Closing remark follows"])),
        ("clean", "advise", "Patient with common words should stop"), ("none", None, ""), ("one", "x", "the metformin tablet"),
    ]
    got, scored = decide(spark, cands, refs, allowed)
    assert got["same"]["decision"] == "BLOCK" and got["same"]["nearest_reference_id"] == "R1" and "EXACT_SEMANTIC_CORE" in got["same"]["reasons"] and got["same"]["risk"] == 1.0
    assert got["span"]["decision"] == "BLOCK" and "PROTECTED_EXCLUSIVE_SPAN_REUSE" in got["span"]["reasons"]
    assert got["clean"]["decision"] == got["none"]["decision"] == got["one"]["decision"] == "ALLOW" and got["clean"]["nearest_reference_id"] is None
    assert scored.where("candidate_id = 'clean'").count() == 0


def test_what_the_allowed_corpus_holds_is_no_evidence(spark):
    got, _ = decide(spark, [("c", "x", PROTECTED)], [("R", "y", PROTECTED)], [("A", "z", PROTECTED)])
    assert got["c"]["decision"] == "ALLOW"


def test_identifiers_across_languages_and_empty_tables(spark):
    got, _ = decide(spark, [("c", "研究 nct-12345 与 ab-9921 的结果", None)], [("R", "trial nct-12345 and ab-9921 outcome", None)], [])
    assert got["c"]["decision"] == "BLOCK" and "MULTILINGUAL_SEMANTIC_LINEAGE_REUSE" in got["c"]["reasons"] and got["c"]["risk"] >= 0.94
    known, _ = decide(spark, [("c", "研究 nct-12345 与 ab-9921 的结果", None)], [("R", "trial nct-12345 and ab-9921 outcome", None)], [("A", "nct-12345 ab-9921 trial outcome", None)])
    assert known["c"]["decision"] == "ALLOW"
    assert decide(spark, [], [("R", "a", "b")], [])[0] == {} and decide(spark, [("c", "a", "b")], [], [])[0]["c"]["decision"] == "ALLOW"


def test_concepts_scripts_and_measurements(spark):
    kind = "case_id string, task string, context string, labs string"
    protected = [("R", "Unverified source, missing audit, causal uncertainty, protocol deviation, efficacy and confounding with 12 and 30", None, "ALT 40"), ("L", "Alpha zolpidem quantity surpasses overnight", None, "ALT 40")]
    cands = [
        ("zh", "未经核实 缺失 审计 因果 不确定 方案偏离 临床疗效 混杂 12 30", None, None), ("ko", "미확인 누락 판정 인과 불확실 교란", None, None), ("few", "未经核实 缺失 审计", None, None),
        ("typed", "Alpha zolpidem quantity surpasses overnight it", None, "glucose 5"), ("dense", "Alpha zolpidem quantity surpasses overnight it", None, "ALT 7"),
    ]
    c, r = spark.createDataFrame(cands, kind), spark.createDataFrame(protected, kind)
    scored = lineage.pairs(c, r, spark.createDataFrame([("A", "nothing here", None, None)], kind), ["task", "context"], labs="labs")
    got = {x["candidate_id"]: x for x in lineage.decisions(c, scored).collect()}
    assert got["zh"]["reasons"] == ["MULTILINGUAL_SEMANTIC_LINEAGE_REUSE"] and got["ko"]["reasons"] == ["SCRIPT_SEMANTIC_LINEAGE_REUSE"] and got["ko"]["script_references"] == ["R"]
    assert got["few"]["decision"] == "ALLOW" and got["dense"]["decision"] == "BLOCK"
    pair = {x["candidate_id"]: x for x in scored.where("reference_id = 'L'").collect()}
    assert pair["dense"]["near_fields"] or pair["typed"]["decision"] in ("ALLOW", "BLOCK")


def test_mosaic(spark):
    scored = spark.createDataFrame(
        [("c", "R1", 0.6, 9, 0.7, "REVIEW"), ("c", "R2", 0.55, 8, 0.65, "REVIEW"), ("d", "R1", 0.6, 9, 0.7, "REVIEW"), ("d", "R2", 0.5, 9, 0.7, "REVIEW")],
        "candidate_id string, reference_id string, record_similarity double, n_anchors int, risk double, decision string",
    ).withColumns({"reasons": F.array().cast("array<string>"), "typed_clean": F.lit(False), "script_match": F.lit(False)})
    got = {r["candidate_id"]: r for r in lineage.decisions(spark.createDataFrame([("c",), ("d",), ("e",)], "case_id string"), scored).collect()}
    assert (got["c"]["decision"], got["c"]["risk"], got["c"]["reasons"]) == ("BLOCK", 0.96, ["MULTI_PROTECTED_REFERENCE_MOSAIC"])
    assert got["d"]["decision"] == "REVIEW" and got["e"]["decision"] == "ALLOW"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_mentions_windows_and_carry(spark):
    text = "Start drug now. Do not stop drug. stop it"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    s = extract.sentences(df, "id")
    assert [text[r["start"] : r["end"]] == r["sentence"] for r in s.collect()] == [True] * 3
    m = extract.mentions(df, ["id"], "text", {"start": r"\bstart\b", "stop": r"\bstop\b", "stop_drug": r"\bstop drug\b"})
    assert rows_of(m, "kind", "start", "negated") == [("start", 0, False), ("stop", 23, True), ("stop", 34, False), ("stop_drug", 23, True)]
    kept = extract.longest_only(m, ["id"])
    assert rows_of(kept, "kind", "start", "ambiguous") == [("start", 0, False), ("stop", 34, False), ("stop_drug", 23, False)]
    assert rows_of(extract.owned_windows(kept, ["id"]), "start", "own_from", "own_to") == [(0, 0, 14), (23, 14, 33), (34, 33, None)]
    c = spark.createDataFrame([(1, 16, 18, "early"), (1, 36, 40, "late")], "id int, start int, end int, kind string")
    assert rows_of(extract.nearest(kept, c, ["id"], 10), "kind", "start", "condition") == [("start", 0, None), ("stop", 34, "late"), ("stop_drug", 23, "late")]
    rows = spark.createDataFrame([(1, 0, "adult"), (1, 1, None), (1, 2, None)], "id int, n int, p string")
    assert rows_of(extract.carried(rows, "id", "n", "p"), "n", "p") == [(0, "adult"), (1, "adult"), (2, None)]
    cl = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "c", "x"), (2, "d", "y"), (2, "e", None)], "s int, c string, v string")
    assert rows_of(extract.inherited_if_unique(cl, ["s"], "v"), "c", "v") == sorted([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y"), ("e", None)], key=repr)


def test_overrides_and_guards(spark):
    f = spark.createDataFrame([(1, "stop", "old"), (1, "start", "old")], "id int, event string, src string")
    n = spark.createDataFrame([(1, "stop", "new")], "id int, event string, src string")
    assert rows_of(extract.overriding(n, f, ["id", "event"]), "event", "src") == [("start", "old"), ("stop", "new")]
    g = spark.createDataFrame([(1, True), (1, False), (2, None), (2, False)], "id int, bad boolean")
    assert rows_of(extract.abstaining(g, "id", F.col("bad")), "id") == [(2,), (2,)]


def test_routing_with_negation(spark):
    texts = spark.createDataFrame([("1", "renal dose please"), ("2", "not renal, dose"), ("3", "hello")], "q string, t string")
    pos = extract.features(texts, "q", "t", {"renal": ["renal"], "dose": ["dose"]})
    got = extract.routed(texts, "q", pos, [("renal_dose", 2.0, ["renal", "dose"], [], []), ("dosing", 1.0, ["dose"], [], ["renal"])], "other")
    assert rows_of(got, "q", "intent", "score") == sorted([("1", "renal_dose", 2.02), ("2", "dosing", 1.01), ("3", "other", 0.0)], key=repr)
    src = extract.ranked_sources(got, "q", spark.createDataFrame([("renal_dose", ["label", "guide", "trial", "x"])], "intent string, ranked array<string>"), spark.createDataFrame([("1", "guide")], "q string, source string"))
    assert rows_of(src.where("q = '1'"), "sources") == [(["label", "trial", "x"],)] and rows_of(src.where("q = '3'"), "sources") == [([],)]


def test_verdicts_and_conditions(spark):
    rows = [
        ("metformin lowers glucose level", "Metformin lowers the glucose level", "DIRECT_SUPPORT"), ("this proves causality", "reports cannot establish a causal link", "CONTRADICTS"), ("contraindicated below 30", "contraindicated below 45", "CONTRADICTS"),
        ("it proves efficacy", "registered trial", "DOES_NOT_SUPPORT"), ("alpha beta gamma delta", "alpha beta", "PARTIAL_SUPPORT"), ("alpha beta", "gamma", "DOES_NOT_SUPPORT"), ("the of", "gamma", "DOES_NOT_SUPPORT"), (None, "x", None),
    ]
    got = spark.createDataFrame(rows, "c string, e string, w string").select(extract.lexical_verdict(F.col("c"), F.col("e"))["relation"].alias("g"), "w")
    assert [r["g"] for r in got.collect()] == [r[2] for r in rows]
    t = spark.createDataFrame([("if eGFR between 30 and 45, reduce; eGFR below 30 stop; eGFR is 50",), (None,)], "t string").select(extract.conditions(F.col("t"), "egfr").alias("c")).collect()
    assert [(x["operator"], x["value"], x["low"], x["high"]) for x in t[0]["c"]] == [("RANGE", None, 30.0, 45.0), ("LT", 30.0, None, None), ("EQ", 50.0, None, None)] and t[1]["c"] is None


def test_what_python_turns_out_at_once_is_bounded():
    sizes = [3, None, 9, 1, 1, 1, 20]
    got = list(lineage._pieces(([0] * n if n is not None else None for n in sizes), len, 10, pa.list_(pa.int64())))
    assert [x for piece in got for x in piece.to_pylist()] == [[0] * n if n is not None else None for n in sizes]
    assert [len(piece) for piece in got] == [3, 4] and not list(lineage._pieces(iter(()), len, 10, pa.int64()))
    # pairs of one batch: names of a cell's references, then candidates that meet all of them
    refs, cands = [f"r{k}" for k in range(500)], [f"c{k}" for k in range(300)]
    sets = pa.array([[k % 7, 7] for k in range(800)], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 800, pa.int32()), pa.array(refs + cands), sets, sets, pa.array([None] * 500 + [refs] * 300, pa.list_(pa.string()))], names=["cell", "item", "words", "grams", "others"])
    out = list(lineage._intersections(iter([batch])))
    assert sum(b.num_rows for b in out) == 150_000 and max(b.num_rows for b in out) <= lineage.PAIRS
    assert {tuple(r.values()) for r in pa.Table.from_batches(out).slice(0, 8).to_pylist()} >= {("c0", "r0", 1, 1, 4, 4), ("c0", "r3", 2, 2, 4, 4)}
