from quern.operators import core, frames


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_segments_and_bound_conditions(spark):
    texts = spark.createDataFrame([(1, "Stop A if low; start B, but not now"), (2, None), (3, ""), (4, " ; ")], "id int, text string")
    parts = frames.segments(texts, "id")
    assert rows_of(parts, "id", "segment", "start", "end") == [(1, "not now", 28, 35), (1, "start b", 15, 22), (1, "stop a if low", 0, 13)]
    events = spark.createDataFrame([(1, "stop", 0, None), (1, "start", 15, "leaked"), (1, "late", 28, None)], "id int, kind string, start int, condition string")
    conds = spark.createDataFrame([(1, 7, "low"), (1, 12, "far")], "id int, start int, condition string")
    assert rows_of(frames.bound_in_segment(events, conds, parts, "id"), "kind", "condition", "rebind") == sorted([("stop", "low", "nearest"), ("start", None, "dropped"), ("late", None, "kept")], key=repr)
    assert frames.segments(texts.limit(0), "id").count() == 0


def test_compiled_frames_keep_the_first(spark):
    f = spark.createDataFrame([("t", 2, "stop", "d", "o", None, None), ("t", 1, "halt", "d", "o", None, None), ("t", 3, "odd", "d", "o", None, None)], "text_id string, pos int, event string, subject string, object string, population string, condition string")
    r = spark.createDataFrame([("stop", "DISCONTINUE", "POSITIVE"), ("halt", "DISCONTINUE", "POSITIVE")], "event string, predicate string, polarity string")
    assert rows_of(frames.compile_frames(f, r), "predicate", "pos") == [("DISCONTINUE", 1)]


def test_registry_faults_and_abstention(spark):
    kind = "text_id string, subject string, predicate string, object string, polarity string, confidence double, variable string, operator string, value double, low double, high double"
    ok = ("d", "stops", "o", "positive", 0.5, None, None, None, None, None)
    rows = [("a", *ok), ("b", "d", "soft", "o", "odd", 0.5, None, None, None, None, None), ("c", "", "nope", None, None, None, "x", "RANGE", None, 1.0, None)]
    accepted, texts = frames.registry_faults(spark.createDataFrame(rows, kind), spark.createDataFrame([("STOPS", True), ("SOFT", False)], "predicate string, critical boolean"), ["egfr"])
    assert rows_of(accepted, "text_id", "predicate") == [("a", "STOPS")] and rows_of(texts, "text_id", "unresolved", "abstain") == [("a", 0, False), ("b", 1, False), ("c", 1, True)]


def test_probed_regions(spark):
    kind = "predicate string, population string, operator string, value double, low double, high double"
    claims = [("c", str(k), "STOP", None, "RANGE", None, lo, hi) for k, (lo, hi) in enumerate([(10.0, 20.0), (15.0, 35.0), (40.0, 45.0)])] + [("c", "lt", "STOP", None, "LT", 20.0, None, None), ("z", "none", "STOP", None, "LT", 20.0, None, None)]
    evidence = [("c", "STOP", None, "LT", 30.0, None, None), ("c", "OTHER", None, "GTE", 44.0, None, None)]
    got = frames.probed(spark.createDataFrame(claims, "case_id string, claim_id string, " + kind), spark.createDataFrame(evidence, "case_id string, " + kind))
    assert rows_of(got, "claim_id", "verdict") == sorted([("0", "SUPPORTED"), ("1", "UNSUPPORTED"), ("2", "CONTRADICTED"), ("lt", "SUPPORTED"), ("none", "UNSUPPORTED")], key=repr)


def test_numbers_follow_the_order_over_all_partitions(spark):
    df = spark.createDataFrame([(k % 3, 1000 - k) for k in range(200)], "g int, o int").repartition(7)
    got = {(r["g"], r["o"]): r["n"] for r in core.numbered(df, ["g"], "o", "n").collect()}
    for g in range(3):
        own = sorted(o for x, o in got if x == g)
        assert [got[g, o] for o in own] == list(range(1, len(own) + 1))
    assert core.numbered(df.limit(0), ["g"], "o", "n").count() == 0


def _most_rows(df):
    """The most rows that a node of the executed plan put out."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        m = node.metrics().get("numOutputRows")
        most = max(most, m.get().value() if m.isDefined() else 0)
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_bound_conditions_make_no_pairs(spark):
    """Events and conditions of one long segment meet by places; and texts with equal ids keep segments that overlap."""
    events = spark.createDataFrame([(1, f"e{k % 3}", 10 * k, "all") for k in range(200)], "id int, kind string, start int, condition string")
    conds = spark.createDataFrame([(1, 10 * k + (4 if k % 2 else 6), f"c{k}") for k in range(200)], "id int, start int, condition string")
    parts = spark.createDataFrame([(1, 0, 1990), (1, 1990, 2000)], "id int, start int, end int")
    got = frames.bound_in_segment(events, conds, parts, "id")
    assert _most_rows(got) <= 2000

    def plain(es, cs, ps):
        for _, kind, at, inherited in es:
            for s, e in {(p[1], p[2]) for p in ps if p[1] <= at < p[2]}:
                near = min(((abs(c - at), c, w) for _, c, w in cs if s <= c < e), default=None)
                yield (kind, at, near[2], "nearest") if near else (kind, at, None, "dropped") if inherited and s > 0 else (kind, at, inherited, "kept")

    rows = [[tuple(r) for r in d.collect()] for d in (events, conds, parts)]
    assert rows_of(got, "kind", "start", "condition", "rebind") == sorted(plain(*rows), key=repr)
    twice = parts.union(spark.createDataFrame([(1, 500, 1200), (1, 700, 705), (1, 706, 709)], "id int, start int, end int"))
    rows[2] = [tuple(r) for r in twice.collect()]
    assert rows_of(frames.bound_in_segment(events, conds, twice, "id"), "kind", "start", "condition", "rebind") == sorted(plain(*rows), key=repr)
