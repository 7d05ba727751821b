"""Manifest, mixing and whitening against plain versions, and their defined odd cases."""

import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import merkle, mixing, queries, whitening

from . import brute

ROWS = "doc_id long, source string, lang string, n_chars long, text string"


# ---- 11 Merkle manifest


def plain_tree(leaves):
    """Root, and the siblings' digests of each leaf from below."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[k : k + merkle.ARITY] for k in range(0, len(level), merkle.ARITY)]
        for leaf, k in enumerate(at):
            proofs[leaf] += [h for j, h in enumerate(runs[k // merkle.ARITY]) if j != k % merkle.ARITY]
        level, at = [sha256("".join(r).encode()).hexdigest() for r in runs], [k // merkle.ARITY for k in at]
    return level[0], proofs


def plain_manifest(rows):
    def leaf(r):
        return sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r).encode()).hexdigest()

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {x: plain_tree([t[2] for t in sorted(trees[x], key=lambda t: t[:3])]) for x in langs}
    root, over = plain_tree([built[x][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for (_, _, h, r), proof in zip(sorted(trees[x], key=lambda t: t[:3]), built[x][1]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            out.append((r[0], h, built[x][0], root, sha256("".join(proof + over[k]).encode()).hexdigest(), not tampered))
    return sorted(out, key=repr)


def got_manifest(spark, rows, **how):
    docs = spark.createDataFrame(rows, ROWS).withColumn("root", F.lit("extra")).withColumn("part", F.lit(1))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    m = merkle.manifest(docs, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, tampered, **how)
    return m, sorted(((r["place"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["verified"]) for r in m.proofs.collect()), key=repr)


@pytest.mark.parametrize("most", [1 << 16, 5])
def test_manifest_matches_a_plain_tree(spark, most):
    rows = [(i, f"s{i % 3}", ["en", "de", None, "é", "x"][i % 11 % 5], None if i % 13 == 0 else i, None if i % 17 == 0 else "wörd " * (i % 5)) for i in range(333)]
    rows += [(7, "s", "en", 1, "same")] * 40 + [(None, None, None, None, None)] * 2 + [(900, "", "solo", 2**62, "x" * 500_000)]
    m, got = got_manifest(spark, rows, most=most)
    assert got == plain_manifest(rows)
    sizes = {r["key"]: r["n_rows"] for r in m.trees.collect()}
    assert sizes["solo"] == 1 and sum(sizes.values()) == len(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "t")], [(1, "s", "en", 1, "t"), (2, "s", "de", 1, "t")]])
def test_small_manifests(spark, rows):
    _, got = got_manifest(spark, rows)
    assert got == (plain_manifest(rows) if rows else [])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.lists(st.integers(0, 3), min_size=70, max_size=70))
def test_forests_are_a_commutative_monoid(n, owner):
    leaves = [merkle.hashed(str(i)) for i in range(n)]
    parts = [{0: {i: leaves[i] for i in range(n) if owner[i] == k}} for k in range(4)]
    a, b, c, d = parts
    one = merkle.merge(merkle.merge(a, b, n), merkle.merge(c, d, n), n)
    two = merkle.merge(d, merkle.merge(merkle.merge(c, a, n), b, n), n)
    root = next(iter(x for x in one.values() if x))
    assert {k: v for k, v in one.items() if v} == {k: v for k, v in two.items() if v}
    assert root == {0: plain_tree(leaves)[0]} and merkle.merge(one, {}, n) == one


# ---- 12 mixing


def plain_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: mixing.WEIGHTS[k % 3] for k, x in enumerate(names)}
    full, left = {}, dict(sizes)
    while True:
        rest = share * sum(sizes.values()) - sum(full.values())
        total = sum(weight[x] for x in left if sizes[x])
        now = {x: rest * weight[x] / total if sizes[x] else 0.0 for x in left} if total else {}
        over = [x for x in now if now[x] > most * sizes[x]]
        if not over:
            return full | now
        for x in over:
            full[x] = most * sizes[x]
            del left[x]


def mixed_rows(n=700):
    rng = np.random.default_rng(5)
    size = lambda i: int(rng.integers(1, 30)) if i % 29 else 2500
    rows = [(i, None if i % 9 == 0 else f"s{min(i % 9, 4)}", "w " * size(i)) for i in range(n)]
    return rows + [(None, "s1", "a b c"), (3, "s1", None), (4, "s2", " \t"), (5, "empty", ""), *[(6, "s3", "same words here")] * 50]


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("extra"))
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got["taken"] == got["copies"] * got["size"]).all() and got["copies"].isin([0, 1, 2]).all()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(brute.words(t))
    want = plain_targets(sizes)
    for s, own in got.groupby(got["source"].fillna("~"), dropna=False):
        s = None if s == "~" else s
        assert own["source_size"].iloc[0] == sizes[s] == own["size"].sum()
        assert own["target"].iloc[0] == pytest.approx(want[s])
        assert abs(own["taken"].sum() - want[s]) <= 40, s
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_mix_of_many_blocks_and_of_nothing(spark):
    rows = [(i, "a" if i % 3 else "b", "w " * (1 + i % 7)) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    for _, own in got.groupby("source"):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 7
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_pivot_keeps_words_and_chances():
    sizes = [9, 7, 7, 4, 3, 1, 1]
    masses = [s * 0.3 for s in sizes]
    counts = np.zeros(len(sizes))
    for seed in range(4000):
        draws = np.random.default_rng(seed).random(len(sizes) + 1)
        copies, left, mass = mixing.pivot(sizes, masses, draws)
        assert sum(c * s for c, s in zip(copies, sizes)) + mass == pytest.approx(sum(masses))
        counts += copies
        if left is not None:
            assert copies[left] == 0
            counts[left] += draws[-1] * sizes[left] < mass
    assert np.abs(counts / 4000 - 0.3).max() < 0.03


# ---- 13 whitening


def plain_whitening(vectors, d):
    real = [(i, [0.0 if c is None else c for c in v] + [0.0] * (d - len(v))) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in real])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, c = np.linalg.eigh(((n * fit - s) / n).T @ ((n * fit - s) / n) / n)
    return [i for i, _ in real], n, s, x, e[::-1], c[:, ::-1]


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(9)
    spread = np.array([9, 7, 5, 4, 3, 2.5, 2, 1.5, 1.2, 1.1, 1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15])
    rows = [(i, (rng.standard_normal(22) * spread).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 700)] + [(None, rows[1][1]), (701, [1.0, 2.0]), (702, None), (703, [float("nan")] * 22), (704, [None, *[1.0] * 21]), (705, []), (706, [float("inf")] * 22)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("extra")).repartition(5)
    got = whitening.whiten(docs).toPandas()
    ids, n, s, x, e, c = plain_whitening(rows, 22)
    assert len(got) == 16 * len(ids) and (got["n"] == n).all() and got["identity_error"].iloc[0] < 1e-9
    want = ((n * x - s) / n @ c[:, :16]) / np.sqrt(e[:16])
    first = {i: k for k, i in reversed(list(enumerate(ids)))}
    sign = np.zeros(16)
    for r in got.itertuples():
        k, j = first[None if np.isnan(r.vec_id) else int(r.vec_id)], r.component - 1
        sign[j] = sign[j] or np.sign(r.whitened * want[k, j])
        assert r.whitened * sign[j] == pytest.approx(want[k, j], abs=1e-8)
        assert r.deviation == int(((n * x[k] - s) ** 2).sum()) and r.explained == pytest.approx(e[j] / e.sum(), rel=1e-9)


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], kind)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [2.5, 1.0]), (3, [2.5, 1.0])], kind)).collect()
    assert len(two) == 3 and {round(abs(r["whitened"]), 12) for r in two} == {1.0} and all(r["explained"] == pytest.approx(1.0) for r in two)


def test_lobpcg_iterates_where_the_block_is_small():
    """300 dimensions, so that the three blocks together are far from the whole space."""
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((300, 300)))
    values = np.sort(np.random.default_rng(2).random(300))[::-1] ** 3 * 50
    a = (q * values) @ q.T
    e, x, passes = whitening.lobpcg(lambda b: a @ b, 300, 8)
    assert np.allclose(e, values[:8], rtol=1e-12) and passes > 5
    assert np.abs(np.abs(np.sum(x * q[:, :8], axis=0)) - 1).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: a @ b, 300, 8, most_passes=3)


def test_queries_are_registered():
    assert {"op11_merkle_manifest", "op12_pivotal_mixing", "op13_lobpcg_whitening"} <= set(queries.QUERIES)
