import math
from collections import Counter

from pyspark.sql import functions as F

from quern.operators import comparators as cmp
from quern.operators import lineage


def _vector(text, idf):
    w = [x for x in text.split() if len(x) >= 2]
    halves = {"word": Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]), "char": Counter(g for x in text.split() for n in (3, 4, 5) for g in (f" {x} "[i : i + n] for i in range(len(x) + 3 - n)))}
    if idf is None:
        return halves
    out = {}
    for h, c in halves.items():
        v = {t: (1 + math.log(n)) * idf[h][t] for t, n in c.items() if t in idf[h]}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        out |= {(h, t): x / norm for t, x in v.items()}
    return out


def test_tfidf(spark):
    refs, allowed, cands = [("r1", "renal dose of drug"), ("r2", "liver drug test")], [("a1", "drug is common")], [("c1", "renal dose drug"), ("c2", "zz yy")]
    kind = "case_id string, text string"
    texts = [t for _, t in refs + allowed]
    idf = {h: {t: math.log((1 + 3) / (1 + n)) + 1 for t, n in Counter(t for x in texts for t in set(_vector(x, None)[h])).items()} for h in ("word", "char")}
    got = {(r["candidate"], r["reference"]): r["score"] for r in cmp.tfidf_scores(*(spark.createDataFrame(x, kind) for x in (cands, refs, allowed))).collect()}
    for c, ct in cands:
        for r, rt in refs:
            a, b = _vector(ct, idf), _vector(rt, idf)
            want = sum(x * b.get(t, 0) for t, x in a.items()) / 2
            assert abs(got.get((c, r), 0) - want) < 1e-9


def test_threshold(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.5, 1), (0.2, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert tuple(round(x, 4) for x in cmp.choose_threshold(df, "s", "y", 0.0).first()) == (0.9, 0.3333, 0.0)
    assert tuple(round(x, 4) for x in cmp.choose_threshold(df, "s", "y", 0.5).first()) == (0.5, 1.0, 0.5)
    assert cmp.choose_threshold(df.where("y = 0"), "s", "y", 0.0).first()["threshold"] == 1.000001


def test_variants_are_caught_and_learned(spark):
    base = [("P1", "Decide whether zolpidem quantity surpasses threshold overnight, then answer plainly", "Monitoring ward seventeen recorded lorazepam interaction during overnight observation window")]
    base.append(("P2", "State if tacrolimus trough warrants adjustment today, then give reasons", "Transplant clinic eleven measured elevated creatinine alongside voriconazole therapy since monday"))
    p = spark.createDataFrame(base, "case_id string, task string, context string")
    v = cmp.variants(p.withColumn("filler", F.lit("Completely ordinary remark about weather in spring")), "task", "context", "filler")
    assert v.count() == 12 and {r["variant"] for r in v.collect()} == set(cmp.VARIANTS)
    clean = spark.createDataFrame([(f"n{k}", f"Ordinary question number {k} about weather", "Completely ordinary remark, zolpidem tacrolimus") for k in range(8)], "case_id string, task string, context string")
    allowed = spark.createDataFrame([("a", "Ordinary question about weather", "Completely ordinary remark in spring then answer")], "case_id string, task string, context string")
    cands = v.select("case_id", "task", "context").union(clean)
    scored = lineage.pairs(cands, p, allowed, ["task", "context"]).cache()
    got = {r["candidate_id"]: r["decision"] for r in lineage.decisions(cands, scored).collect()}
    assert all(got[f"{i}-{k}"] == "BLOCK" for i in ("P1", "P2") for k in ("presentation_only", "single_evidence_field")) and all(got[f"n{k}"] == "ALLOW" for k in range(8))
    f = cmp.pair_features(scored).withColumn("y", F.when(F.startswith("candidate_id", F.lit("P")), 1.0).otherwise(0.0))
    out = cmp.grouped_scores(f.withColumn("g", F.col("candidate_id")), "y", "g", 2)
    assert out.count() == f.count() and out.where("probability between 0 and 1").count() == f.count()


def test_edit_blend(spark):
    r = spark.createDataFrame([("a b c", "a b c"), ("abc", "xyz"), (None, "a")], "a string, b string").select(cmp.edit_blend(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in r] == [1.0, 0.0, None]
