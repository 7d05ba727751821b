"""Propositions, ladders, frames and facts: cases of each rule, a plain version of the bound frames, odd inputs."""

import re

import pytest
from pyspark.sql import functions as F

from quern.functions.automaton import Cues
from quern.operators import propositions as P
from quern.operators import typed_frames as T
from quern.operators import verifiers as V
from quern.operators import visible_facts
from quern.plans.typed_frame_plans import STATEMENTS
from quern.streaming import facts

CASES = "id int, evidence string, claim string"
RENAL = "The drug is contraindicated in patients with an eGFR below 30; initiation is not recommended for eGFR 30 to 45 whereas reassess benefit and risk for patients already taking it if eGFR falls below 45."


def decided(df):
    return {r["id"]: (r["relation"], r["cue"]) for r in df.collect()}


def test_cues_are_found_everywhere(spark):
    cues = Cues(["he", "she", "hers", "she"])
    df = spark.createDataFrame([("ushers",), ("",), (None,)], "t string").select(cues.spans(F.col("t")).alias("s"), cues.found(F.col("t")).alias("f"))
    rows = df.collect()
    assert {(cues.cues[x["cue"]], x["start"], x["end"]) for x in rows[0]["s"]} == {("he", 2, 4), ("she", 1, 4), ("hers", 2, 6)}
    assert rows[0]["f"] == [0, 1, 2] and rows[1]["f"] == [] and rows[2]["f"] is None


def test_rules_that_a_text_meets(spark):
    rules = [("a", [["x", "y"], ["z"]], []), ("a", [["x"]], []), ("b", [["x"]], ["y"]), ("c", [["zz"]], [])]
    cues = Cues(["x", "y", "z", "zz"])
    rows = [("x z",), ("x",), ("x y",), ("zz y",), ("q",), ("",), (None,)]
    got = [r["h"] for r in spark.createDataFrame(rows, "t string").select(cues.holding(F.col("t"), rules).alias("h")).collect()]
    assert got == [[0, 2], [1, 2], [1], [0, 3], [], [], None]


def test_words_of_a_pattern_without_it_say_nothing(spark):
    told = P.parsed(spark.createDataFrame([(1, "It is current; it supersedes all; the version is recruiting; guideline X9 remains the current one.")], "id int, text string"), "id")
    got = sorted((r["clause"], r["predicate"], r["subject"]) for r in told.collect())
    assert got == [(2, "HAS_STATUS", "study"), (3, "IS_CURRENT", "guideline x9")]


def test_a_passage_is_parsed_once(spark, monkeypatch):
    from quern.plans import verify_plans

    sizes, parsed = [], P.parsed
    monkeypatch.setattr(P, "parsed", lambda texts, *a: sizes.append(texts.count()) or parsed(texts, *a))
    questions = verify_plans.joint_pipeline(spark, "/root/testdata/sf0.001").count()
    assert questions == 1000 and sum(sizes) < questions / 2


def test_propositions(spark):
    rows = [(1, RENAL), (2, "Version 2 supersedes version 1, and the drug must stop; the drug must stop."), (3, None), (4, " "), (5, "Guideline B continues to recommend option X-1."), (6, "It does not state that it is contraindicated.")]
    got = P.parsed(spark.createDataFrame(rows, "id int, text string").withColumn("subject", F.lit("extra")), "id").collect()
    by = lambda i: sorted((r["clause"], r["predicate"], r["polarity"], r["population"], [tuple(c) for c in r["conditions"]]) for r in got if r["id"] == i)
    assert by(1) == [
        (0, "CONTRAINDICATED", "POSITIVE", "existing_user", [("LT", 30, None, None)]), (1, "INITIATION_NOT_RECOMMENDED", "POSITIVE", "new_or_initiating_user", [("RANGE", None, 30, 45)]), (2, "REASSESS_BENEFIT_RISK", "POSITIVE", "existing_user", [("LT", 45, None, None)]),
    ]
    # equal propositions count once, by their first clause
    assert [(c, p) for c, p, *_ in by(2)] == [(0, "IS_CURRENT"), (0, "IS_CURRENT"), (0, "SUPERSEDES"), (1, "DISCONTINUE")]
    assert {r["object"] for r in got if r["id"] == 5} == {"x-1"} and by(6) == [(0, "PROVIDES_ABSOLUTE_PROHIBITION", "NEGATIVE", None, [])] and not by(3) + by(4)
    assert P.parsed(spark.createDataFrame([], "id int, text string"), "id").count() == 0


def test_atomic_ladder(spark):
    cases = [
        (1, RENAL, "The drug is contraindicated at eGFR 20.", "DIRECT_SUPPORT", "atomic_numeric_support"), (2, RENAL, "Stop the drug at eGFR 20.", "CONTRADICTS", "atomic_numeric_action_conflict"), (3, RENAL, "Stop the drug at eGFR 90.", "DOES_NOT_SUPPORT", "no_evidence_rule_for_claimed_action"),
        (4, "Must stop if eGFR is below 25.", "Must stop if eGFR is below 30.", "PARTIAL_SUPPORT", "claimed_region_partially_supported"), (5, RENAL, "The drug is contraindicated at eGFR below 45.", "CONTRADICTS", "claimed_region_contains_action_conflict"),
        (6, "Version 2 supersedes version 1.", "Version 1 is current.", "CONTRADICTS", "explicit_negative_polarity"), (7, "Version 2 supersedes version 1.", "Version 2 is current.", "DIRECT_SUPPORT", "current_entity_supported"),
        (8, "There is no efficacy result.", "It demonstrates clinical benefit.", "DOES_NOT_SUPPORT", "explicit_absence_or_limitation"), (9, "The lesion is indeterminate.", "The lesion is malignant.", "DOES_NOT_SUPPORT", "indeterminate_not_malignant"),
        (10, "A cyp3a substrate.", "A pharmacokinetic interaction.", "DIRECT_SUPPORT", "bounded_pk_mechanism_supported"), (11, None, None, "DOES_NOT_SUPPORT", "conservative_atomic_default"),
    ]
    got = decided(P.verdicts(spark.createDataFrame([c[:3] for c in cases], CASES), "id"))
    assert got == {c[0]: c[3:] for c in cases}


def test_ladders_of_labels_and_frames(spark):
    cases = [
        (1, "Reports cannot by themselves establish a causal link.", "This proves causality, it proves that.", "causality_level_conflict", "causal_polarity_conflict"), (2, "", "", "insufficient_semantic_match", "very_high_frame_overlap"), (3, None, None, "insufficient_semantic_match", "very_high_frame_overlap"),
        (4, "The registry has no efficacy result.", "It proves efficacy.", "registration_to_efficacy_escalation", "registry_without_efficacy_result"), (5, "Discontinue below 30.", "Discontinue at eGFR 20.", "threshold_rule_application", "shared_bounded_modality:DISCONTINUE"),
        (6, "Initiation: eGFR 30 to 45.", "Starting at eGFR 40.", "range_rule_application", "partial_frame_overlap"), (7, "alpha beta gamma delta", "alpha beta gamma", "very_high_literal_entailment", "very_high_frame_overlap"),
    ]
    df = spark.createDataFrame([c[:3] for c in cases], CASES).withColumn("cue", F.lit("extra")).drop("cue")
    assert {i: c for i, (_, c) in decided(V.semantic(df)).items()} == {c[0]: c[3] for c in cases}
    got = {i: c for i, (_, c) in decided(V.framed(df)).items()}
    assert {k: got[k] for k in (1, 4, 5)} == {1: cases[0][4], 4: cases[3][4], 5: cases[4][4]}
    assert V.framed(df.limit(0)).count() == V.semantic(df.limit(0)).count() == 0


def test_domain_frames(spark):
    rows = [(1, "Biomarker X is not associated with outcome Y."), (2, "Do not stop it; it is contraindicated below eGFR 30."), (3, None), (4, ""), (1, "Biomarker X is not associated with outcome Y.")]
    got = sorted((r["id"], r["domain"], r["subject"], r["polarity"], r["operator"], r["value"]) for r in T.detect(spark.createDataFrame(rows, "id int, text string").withColumn("event", F.lit("x")).drop("event"), "id").collect())
    assert got == [(1, "biomarker", "biomarker_x", "NEGATIVE", None, None)] * 2 + [(2, "management", "drug_use", "NEGATIVE", None, None), (2, "management", "drug_use", "POSITIVE", "LT", 30.0)]


def _plain_frames(text):
    """Events with the conditions they are bound to, by comparing every event with every condition."""
    t = re.sub(r"\s+", " ", text.lower().replace("–", "-").replace("—", "-")).strip()
    find = lambda p: [(m.start(), m.end(), m) for m in re.finditer(p, t)]
    ends = sorted((a, b, n) for n, p in T.SPAN_ENDS for a, b, _ in find(p))
    marks = sorted({(a, b, k, n) for k, table in (("event", T.EVENTS.items()), ("end", T.SPAN_ENDS)) for n, p in table for a, b, _ in find(p)})
    conds, seen = [], set()
    for op, p in T.CONDITIONS:
        for a, b, m in find(p):
            if (a, b) not in seen:
                seen.add((a, b))
                n = [float(x) for x in m.groups()]
                conds.append((a, b, (op, None, min(n), max(n)) if op == "RANGE" else (op, n[0], None, None)))
    conds.sort(key=lambda c: c[:2])
    every = sorted([*marks, *[(a, b, "condition", c[0]) for a, b, c in conds], *[(a, b, "variable", n) for n, p in (("renal", T.RENAL), ("other", T.OTHER)) for a, b, _ in find(p)], *[(a, b, "back", "back") for a, b, _ in find(T.BACK)]])

    def places(at):
        before = [x for x in every if x < at]
        s = sum(x[2] == "end" and x[3] == "sentence" for x in before)
        c = s + sum(x[2] == "end" and x[3] == "clause" for x in before)
        return (s, c, c + sum(x[2] == "end" and x[3] == "coordination" for x in before))

    where = {x: places(x) for x in every if x[2] != "end"}
    own = {(a, b, "condition", c[0]): c for a, b, c in conds}
    single = bool(re.search(T.SAME_VALUE, t))
    out = []
    for e in (x for x in where if x[2] == "event"):
        bound, how = None, "none"
        for level, name in ((2, "coordination"), (1, "clause"), (0, "sentence")):
            here = [x for x in own if where[x][level] == where[e][level]]
            if here:
                before = max((x for x in here if x[:2] < e[:2]), default=None)
                after = min((x for x in here if x[:2] > e[:2]), default=None)
                best = min([x for x in (before, after) if x], key=lambda x: (abs(x[0] - e[0]), x[0]), default=None)
                if best:
                    bound, how = own[best], name
                    break
        if bound is None and any(x[2] == "back" and where[x][0] == where[e][0] for x in where):
            past = [x for x in own if x[0] < e[0]]
            if past:
                bound, how = own[max(past)], "reference"
        around = t[max(0, e[0] - 80) : e[0] + 90]
        denied = any(n == e[3] and re.search(p, around) for n, p in T.DENIED)
        veto = None
        if how in ("clause", "sentence", "reference"):
            last = max((x for x in where if x[2] == "variable" and x[0] < e[0]), default=None)
            if single and bound[0] == "RANGE":
                veto = "reference_shape"
            elif last and last[3] == "other" and e[0] - last[0] <= T.REACH:
                veto = "local_variable"
        bound = (None,) * 4 if veto or bound is None else bound
        out.append((e[3], e[0], "NEGATIVE" if denied else "POSITIVE", *bound, how, veto))
    return sorted(out, key=repr)


def test_bound_frames_match_a_plain_version(spark):
    import random

    rng = random.Random(4)
    texts = [". ".join(rng.choice(STATEMENTS + ["Then, and at the same eGFR, stop", "Same value: discontinue", "Potassium or age matter; withdraw", "Between 20 and 40 it is contraindicated"]) for _ in range(rng.randint(1, 9))) + "." for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "x" * 300_000 + " discontinue")]
    got: dict = {}
    for r in T.vetoed(spark.createDataFrame(rows, "id int, text string"), "id").collect():
        got.setdefault(r["id"], []).append((r["event"], r["start"], r["polarity"], r["operator"], r["value"], r["low"], r["high"], r["bound"], r["veto"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, []), key=repr) == _plain_frames(t), t
    assert set(got) & {100, 101} == set() and len(got[102]) == 1


def test_numbers_that_no_int_holds_are_numbers(spark):
    rows = [(1, "Reassess benefit below 45.", "Patients must discontinue below 45 and under 13812345678."), (2, "Contraindicated below 30.", "Contraindicated below " + "9" * 60), (3, "Contraindicated under 0" + "0" * 40 + "30", "Contraindicated below 30")]
    got = {r["id"]: r["cue"] for r in V.semantic(spark.createDataFrame(rows, CASES)).collect()}
    assert got == {1: "insufficient_semantic_match", 2: "threshold_action_mismatch", 3: "same_management_modality"}


def test_frames_shuffle_marks_and_not_texts(spark):
    rows = [(k, "It is contraindicated below eGFR 30; discontinue it. " * 40 + "w" * 20_000) for k in range(20)]
    frames = T.vetoed(spark.createDataFrame(rows, "id int, text string"), "id")
    plan = frames._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, "marks are dealt out once"
    assert not re.search(r"Window \[[^\n]*__t#", plan) and "unboundedfollowing" not in plan.lower(), "texts or quadratic frames in a sweep"
    assert frames.count() == 20 * 80


def test_visible_facts(spark):
    turns = [(1, 1, "没有发热。有发热，对吗？"), (1, 2, "发烧。"), (1, 3, "更正一下，没有发热，服药时间是昨天。"), (1, 4, "是否发热不清楚。"), (1, 5, "发烧，没有发烧；今天天气好"), (2, 1, "妈妈是否服药不清楚"), (2, 2, "妈妈已经服药"), (2, 3, None), (2, 4, ""), (3, 1, "我是替爸爸问的")]
    told, unread = visible_facts.observations(spark.createDataFrame(turns, "c int, turn int, text string").withColumn("s", F.lit("extra")), "c", "turn")
    got = facts.observed(told.select(F.concat_ws("|", "c", "fact").alias("key"), F.col("turn").alias("seq"), "value", "status", "corrected", F.concat(F.lit("u"), "turn").alias("turn_id")))
    state = {r["key"]: (r["status"], r["value"], r["turn_id"], r["alternatives"], [x["rule"] for x in r["refused"]]) for r in got.collect()}
    assert state == {"1|fever": ("confirmed", "false", "u3", [], ["UNCERTAIN_RETRACTION"]), "1|medication_time": ("confirmed", "昨天", "u3", [], []), "2|mother.medication_taken": ("confirmed", "true", "u2", [], []), "3|patient_subject": ("confirmed", "father", "u1", [], [])}
    assert sorted((r["turn"], r["reason"]) for r in unread.where("c = 1").collect()) == [(1, "question_not_declaration"), (5, "outside_supported_rules"), (5, "within_turn_conflict")]


@pytest.mark.parametrize("kind", ["conflict"])
def test_a_bare_change_is_a_conflict(spark, kind):
    rows = [("k", 1, "a", "confirmed", False, "u1"), ("k", 2, "b", "confirmed", False, "u2"), ("k", 3, "a", "confirmed", True, "u3")]
    got = facts.observed(spark.createDataFrame(rows[:2], "key string, seq int, value string, status string, corrected boolean, turn_id string")).first()
    assert (got["status"], got["alternatives"]) == (kind, ["a", "b"])
    assert facts.observed(spark.createDataFrame(rows, "key string, seq int, value string, status string, corrected boolean, turn_id string")).first()["status"] == "confirmed"


def test_frames_ask_for_cues_by_bits(spark):
    """Which cues a text holds is one number, not an array that each of some hundred rules compares anew; and patterns keep what they found."""
    cues = Cues(["ab", "b", "cd"])
    df = spark.createDataFrame([("abx",), ("cd",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(cues.bits(F.col("t"), [("b", "cd"), ("ab",), ("cd",)])).collect()] == [3, 5, 0, None]
    cases = spark.createDataFrame([(1, "Guideline B explicitly supersedes guideline X.", "Guideline X remains the current guideline."), (2, "Guideline B supersedes guideline X.", "Guideline B is the current one."), (3, "An association between alpha and beta.", "It establishes that alpha caused beta.")], CASES).drop("cue")
    got = V.framed(cases)
    assert {r["id"]: r["cue"] for r in got.collect()} == {1: "superseded_document_asserted_current", 2: "newer_document_asserted_current", 3: "causal_escalation_without_support"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("arrays_overlap") < 10


def test_rules_are_tried_where_their_words_are(spark, monkeypatch):
    """A text without any rule's words is not searched by the rules' patterns; each rule finds nothing without its words."""
    frames, tried = T.detector(), []
    eval_ = frames.func().eval
    cells = {n: c.cell_contents for n, c in zip(eval_.__func__.__code__.co_freevars, eval_.__func__.__closure__)}

    class Spy:
        def __init__(self, p):
            self.p = p

        def search(self, scope):
            tried.append(self.p.pattern)
            return self.p.search(scope)

    for rules in cells["table"].values():
        rules[:] = [(r, [[Spy(p) for p in n] for n in needs], [Spy(p) for p in unless]) for r, needs, unless in rules]
    assert list(frames.func().eval("invented prose, nothing else; and more of it")) == [] and not tried
    for text in filter(None, STATEMENTS):
        text = " ".join(text.lower().split())
        tried.clear()
        got = list(frames.func().eval(text))
        plain = list(T.detector([T.replace(r, words=()) for r in T.DOMAIN_RULES]).func().eval(text))
        assert got == plain
