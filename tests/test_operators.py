import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import components, core, entail, ledger, stats
from quern.streaming import facts
from quern.streaming import ledger as stream


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_picks_and_tops(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 1, 1), (None, 9, 0)], "k string, id int, v int")
    assert rows_of(core.pick(df, ["k"], [F.desc("v"), F.col("id")]), "k", "id") == [("a", 1), ("b", 1), (None, 9)]
    assert rows_of(core.top(df, ["k"], [F.desc("v"), F.col("id")], 2), "k", "rank", "id") == sorted([("a", 1, 1), ("a", 2, 2), ("b", 1, 1), (None, 1, 9)], key=repr)
    assert core.top(df, ["k"], [F.desc("v")], 0).count() == 0


def test_fallback_join(spark):
    left = spark.createDataFrame([(1, "r1", "c", "m"), (2, "rx", "c", "m"), (3, None, "d", "m")], "i int, run string, c string, m string")
    right = spark.createDataFrame([("r1", "c", "m", "old", 1), ("r1", "c", "m", "new", 2), ("r2", "c", "m", "last", 3)], "r string, rc string, rm string, v string, seq int")
    assert rows_of(core.fallback_join(left, right, ("run", "r"), (["c", "m"], ["rc", "rm"]), "v", "seq"), "i", "v", "matched_by") == [(1, "new", "first"), (2, "last", "second"), (3, None, None)]


def test_first_match_by_rank(spark):
    ranked = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"]), (3, [])], "i int, ids array<string>")
    docs = spark.createDataFrame([("c", "C"), ("b", "B")], "id string, doc string")
    assert rows_of(core.first_match(ranked, "ids", docs, "id", "doc"), "i", "match_rank", "match_id", "match") == [(1, 2, "b", "B"), (2, None, None, None), (3, None, None, None)]


def test_points_in_intervals(spark):
    rng = random.Random(4)
    points = [(i, rng.choice("ab"), rng.uniform(-20, 20)) for i in range(60)] + [(99, "a", 5.0)]
    spans = [(i, rng.choice("ab"), *sorted((rng.uniform(-20, 20), rng.uniform(-20, 20)))) for i in range(20)] + [(99, "a", 5.0, 5.0)]
    got = core.points_in_intervals(spark.createDataFrame(points, "p int, k string, v double"), spark.createDataFrame(spans, "i int, k string, lo double, hi double"), ["k"], "v", "lo", "hi", 3.0)
    assert rows_of(got, "p", "i") == sorted(((p, i) for p, k, v in points for i, j, lo, hi in spans if k == j and lo <= v <= hi), key=repr)


def test_both_ways_and_predicates(spark):
    e = spark.createDataFrame([("x", "y", "OWNS"), ("y", "z", "NEAR")], "a string, b string, l string")
    assert rows_of(core.both_ways(e, "a", "b", "l", {"OWNS": "OWNED_BY"}), "a", "b", "l") == [("x", "y", "OWNS"), ("y", "x", "OWNED_BY"), ("y", "z", "NEAR"), ("z", "y", "NEAR")]
    d = spark.createDataFrame([(1, "2020-01-01", "2020-02-01", ["all"]), (2, None, "2019-01-01", ["x"]), (3, None, None, None)], "i int, a string, b string, s array<string>").withColumns({"a": F.col("a").cast("date"), "b": F.col("b").cast("date")})
    at = F.lit("2020-02-01").cast("date")
    assert [r["i"] for r in d.where(core.valid_at(at, F.col("a"), F.col("b"))).orderBy("i").collect()] == [1, 3]
    assert d.where(core.valid_at(F.lit(None).cast("date"), F.col("a"), F.col("b"))).count() == 3
    assert [r["i"] for r in d.where(core.in_scope(F.lit("x"), F.col("s"))).orderBy("i").collect()] == [1, 2]
    assert d.where(core.in_scope(F.lit(None).cast("string"), F.col("s"))).count() == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_pairs_are_exact(spark, seed):
    rng = random.Random(seed)
    base = [rng.sample(range(60), rng.randint(1, 20)) for _ in range(8)]
    sets = []
    for i in range(80):
        s = set(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            s ^= {rng.randrange(60)}
        sets.append((i, sorted(s)))
    want = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 5 * len(set(x) & set(y)) >= 4 * len(set(x) | set(y))]
    got = core.similar_pairs(spark.createDataFrame([*sets, (500, []), (501, None)], "i int, s array<int>"), "i", "s", 0.8, 4, 5)
    assert rows_of(got, "a", "b") == sorted(want, key=repr) and want


def test_dense_similar_pairs_are_exact(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(core, "BLOCK", 16)  # many blocks, some too far apart in size to meet
    common = rng.sample(range(-(10**18), 10**18), 90)
    sets = [(i, rng.sample(common, rng.choice([3, 8, 20, 40, 80]))) for i in range(60)]
    sets += [(100 + i, s[: max(1, len(s) * 3 // 4)]) for i, s in sets[:30]] + [(200 + i, s[::-1]) for i, s in sets[:6]]
    want = [(a, b, round(len(set(x) & set(y)) / len(set(x) | set(y)), 6)) for (a, x), (b, y) in combinations(sets, 2) if 2 * len(set(x) & set(y)) >= len(set(x) | set(y))]
    df = spark.createDataFrame([*sets, (500, []), (501, None)], "i int, s array<bigint>")
    assert rows_of(core.similar_pairs_dense(df, "i", "s", 1, 2), "a", "b", "similarity") == sorted(want, key=repr) and want
    assert core.similar_pairs_dense(df.limit(0), "i", "s", 1, 2).count() == 0


def test_similar_pairs_deal_out_shared_tokens_only(spark, monkeypatch):
    """A token of one set meets nothing: it is not among the counts, nor in a prefix; sets without candidates don't travel."""
    held = {}
    keep = core.stored
    monkeypatch.setattr(core, "stored", lambda df, path: held.setdefault(path.split("quern-")[-1].rsplit("-", 1)[0], keep(df, path)))
    sets = [(i, [1000 * i + k for k in range(10)]) for i in range(30)] + [(50, [1, 2, 3, 4, 5, 6, 7, 8, 9])]
    got = core.similar_pairs(spark.createDataFrame(sets, "i long, s array<long>"), "i", "s", 0.8, 4, 5)
    assert rows_of(got, "a", "b") == [(0, 50)]
    assert held["counts"].count() == 9 and {r["id"] for r in held["prefixes"].collect()} == {0, 50}
    assert held["wanted"].count() == 2


def test_pairs_of_user_texts_are_not_all_written(spark, tmp_path):
    """Texts out of few trigrams share prefix tokens nearly all; their pairs must not be shuffled."""
    rng = random.Random(2)
    parts = ["th", "er", "in", "on", "re", "an", "ti", "es"]
    rows = [(k, 0, "user", "".join(rng.choices(parts, k=60))) for k in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from quern.plans import text_plans

    pairs = text_plans.conv_user_similarity(spark, str(tmp_path))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan, "pairs are counted after they were shuffled"


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    got = dict(rows_of(components.components(spark.createDataFrame(links, "a long, b long")), "node", "label"))
    assert got == {**{i: 0 for i in range(41)}, **{x: 100 for x in range(100, 160)}}


def _replay(events):
    """The ledger's rules one event at a time."""
    slots, out = {}, []
    for slot, claim, day, seq, _ in sorted(events, key=lambda e: e[3]):
        edges = slots.setdefault(slot, set())
        newest, peers = max((d for d, _ in edges), default=None), sum(d == day for d, _ in edges)
        if (day, claim) in edges:
            done = ("MERGED_IDEMPOTENT", False)
        elif newest is None or day > newest:
            done = ("INSERTED_ACTIVE" if newest is None else "SUPERSEDED_PRIOR", True)
        else:
            done = ("INSERTED_HISTORICAL", False) if day < newest else ("CONTRADICTION_RECORDED", peers == 1)
        edges.add((day, claim))
        out.append((seq, *done))
    return sorted(out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xy"), st.sampled_from("abc"), st.sampled_from(["2024-01-01", "2024-01-02", "2024-01-03"])), max_size=14), st.randoms())
def test_closed_form_ledger_equals_replay(spark, rows, rng):
    order = list(range(len(rows)))
    rng.shuffle(order)
    events = [(s, c, d, f"{k:03}", k) for k, (s, c, d) in zip(order, rows)]
    df = spark.createDataFrame(events, "slot string, claim string, effective string, seq string, source long")
    acted = ledger.actions(df)
    assert rows_of(acted, "seq", "action", "active_truth_changed") == _replay(events)
    for r in ledger.edges(acted).collect():
        newest = max(d for s, _, d, _, _ in events if s == r["slot"])
        rivals = {c for s, c, d, _, _ in events if s == r["slot"] and d == r["effective"]}
        assert r["status"] == ("SUPERSEDED" if r["effective"] < newest else "ACTIVE" if len(rivals) == 1 else "CONTESTED")


def test_streaming_ledger_over_several_files(spark, tmp_path):
    rng = random.Random(9)
    events = [("s" + rng.choice("123"), rng.choice("abc"), f"2024-01-0{rng.randint(1, 4)}", f"{k:03}", k) for k in range(60)]
    schema = "slot string, claim string, effective string, seq string, source long"
    for k in range(0, 60, 20):
        spark.createDataFrame(events[k : k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = stream.actions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)  # starts anew from its checkpoint each time
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "seq", "action", "active_truth_changed") == _replay(events)


def test_fact_fold(spark):
    up = lambda k, n, v, s, sup=None, turn=None: (k, n, v, s, sup, turn or f"t{n}")
    rows = [
        up("k", 1, "a", "confirmed"), up("k", 2, "b", "confirmed"), up("k", 3, "b", "confirmed", "t1"), up("k", 4, "c", "confirmed", "t1"), up("k", 5, "b", "confirmed", None, "t3"), up("k", 6, None, "unknown", "t3"),
        up("j", 1, None, "unknown"), up("j", 2, "x", "unknown"), up("j", 3, None, "confirmed"), up("i", 1, "x", "confirmed"), up("i", 2, "y", "conflict"), up("i", 3, "x", "conflict"), up("i", 4, "z", "conflict", "t3"),
        up(None, 1, "n", "confirmed"), up("h", 1, "n", "odd"), up("h", 2, "n", "confirmed", "t9"),
    ]
    kind = "key string, seq int, value string, status string, supersedes string, turn_id string"
    got = {r["key"]: r for r in facts.fold(spark.createDataFrame(rows, kind)).collect()}
    told = lambda r: (r["status"], r["value"], r["turn_id"], list(r["alternatives"]), list(r["history"]), [x["rule"] for x in r["refused"]])
    assert told(got["k"]) == ("unknown", None, "t6", [], ["t1", "t3", "t6"], ["CHANGED_WITHOUT_SUPERSEDES", "STALE_SUPERSEDES", "REPEATED_TURN"])
    assert told(got["j"]) == ("unknown", None, "t1", [], ["t1"], ["UNKNOWN_WITH_VALUE", "MISSING_VALUE"])
    assert told(got["i"]) == ("conflict", "z", "t4", ["z"], ["t1", "t2", "t3", "t4"], [])
    assert told(got[None]) == (None, None, None, [], [], ["MISSING_KEY"]) and told(got["h"])[5] == ["INVALID_STATUS", "STALE_SUPERSEDES"]
    assert facts.fold(spark.createDataFrame([], kind)).count() == 0


def test_entailment_intervals(spark):
    kinds = [("EQ", 5.0, None, None), ("LT", 5.0, None, None), ("LTE", 5.0, None, None), ("GT", 5.0, None, None), ("GTE", 5.0, None, None), ("RANGE", None, 3.0, 5.0), (None, None, None, None)]
    df = spark.createDataFrame(kinds, "o string, v double, l double, h double").select("o", entail.bounds(F.col("o"), F.col("v"), F.col("l"), F.col("h")).alias("b"))
    got = {r["o"]: [r[f"h{k}"] for k in range(3)] for r in df.select("o", *[entail.holds(F.col("b"), F.lit(float(x))).alias(f"h{k}") for k, x in enumerate((4, 5, 6))]).collect()}
    assert got == {"EQ": [False, True, False], "LT": [True, False, False], "LTE": [True, True, False], "GT": [False, False, True], "GTE": [False, True, True], "RANGE": [True, True, False], None: [True, True, True]}
    pairs = df.alias("i").crossJoin(df.alias("e")).select(F.col("i.o").alias("i"), F.col("e.o").alias("e"), entail.subset(F.col("i.b"), F.col("e.b")).alias("s"))
    inside = {(r["i"], r["e"]) for r in pairs.collect() if r["s"]}
    assert {("EQ", "RANGE"), ("LT", "LTE"), ("RANGE", "LTE"), ("GT", "GTE"), ("GT", None)} <= inside and not {("LTE", "LT"), ("RANGE", "LT"), ("EQ", "GT"), (None, "GT")} & inside
    v = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (1, 0, 2), (2, 1, 3), (0, 1, 2), (0, 0, 2)], "s int, c int, n int").select(entail.relation(F.col("s"), F.col("c"), F.col("n")))
    assert [r[0] for r in v.collect()] == ["DOES_NOT_SUPPORT", "DIRECT_SUPPORT", "PARTIAL_SUPPORT", "PARTIAL_SUPPORT", "CONTRADICTS", "DOES_NOT_SUPPORT"]
    c = spark.createDataFrame([(None, None), (None, "p"), ("p", None), ("p", "p"), ("p", "q")], "e string, c string").select(entail.covers(F.col("e"), F.col("c")))
    assert [r[0] for r in c.collect()] == [True, True, False, True, False]


def test_agreement(spark):
    k = lambda rows: tuple(stats.weighted_kappa(spark.createDataFrame(rows, "a int, b int"), "a", "b").first())
    assert k([(0, 0), (1, 1), (2, 2), (2, 1), (None, 1), (1, None)]) == (4, 0.125, 0.4375, 0.714286, 0.75)
    assert k([(1, 1), (1, 1)]) == (2, 0.0, 0.0, None, 1.0)
    assert k([]) == (0, None, None, None, None)
    assert stats.bootstrap_interval([0.5], 1) is None
    low, high = stats.bootstrap_interval([0.1, 0.2, 0.4, 0.9], 7)
    assert 0.1 <= low < 0.4 < high <= 0.9 and (low, high) == stats.bootstrap_interval([0.1, 0.2, 0.4, 0.9], 7)


def test_tri_state_and_ranks(spark):
    df = spark.createDataFrame([("t", True), ("t", None), ("u", None), ("u", False), ("f", False)], "k string, b boolean")
    assert dict(rows_of(df.groupBy("k").agg(stats.tri_state(F.col("b")).alias("s")), "k", "s")) == {"t": True, "u": None, "f": False}
    v = spark.createDataFrame([([3.0, 1.0, 2.0],), ([7.0],)], "v array<double>").select(stats.nth_rank(F.col("v"), 0.95), stats.nth_rank(F.col("v"), 0.5))
    assert [tuple(r) for r in v.collect()] == [(3.0, 2.0), (7.0, 7.0)]
