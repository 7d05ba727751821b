"""Small fixtures against plain versions, and the defined odd cases."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontam, licenses, linededup, minhash, packing, preference, queries, topk, toxicity, urlfilter, warc
from quern.llm import textkernel as K
from quern.operators import components

from . import brute

DOCS = "doc_id long, text string"


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---- text kernel


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉß \t\n\x0b.", max_size=40)), max_size=8))
def test_words_match_the_pattern(texts):
    seen = {}
    for w in K.words(pa.array(texts, pa.string())):
        for r in range(w.lo, w.hi):
            got = w.hashes[w.ptr[r - w.lo] : w.ptr[r - w.lo + 1]].tolist()
            want = brute.words(texts[r])
            assert len(got) == len(want)
            for a, b in zip(got, want):
                assert seen.setdefault(b, a) == a
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_hashed_in_pieces():
    text = "word " * 600_000 + "x" * 3_000_000 + " word"
    (w,) = K.words(pa.array([text]))
    assert len(w.hashes) == 600_002 and len(set(w.hashes.tolist())) == 2


# ---- 1 WARC


def test_archive_round_trip(spark):
    big, url = "é" * 80, "http://a.example.com/x?y=1"
    rows = [(3, url, big), (1, "https://B.example.org/p#f", big), (2, url, "tiny"), (4, None, "tiny"), (5, "no scheme", None), (6, "http://x/\r\n%41", ""), (None, url, big), (7, url, "z" * 99), (8, url, "z" * 99), (9, "http://u v.net/" + "k" * 3000, "z" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("extra"))
    folder, parts = warc.archive(pages)
    keys = pages.select(warc.key_of(F.col("url"), F.col("page_id")).alias("key"))
    got = {r["page_id"]: r for r in warc.fetch(warc.lookup(keys, parts, folder), folder, True).collect()}
    assert len(got) == len(rows)
    for i, u, h in rows:
        r, body = got[i], (h or "").encode()
        assert (r["url"], r["payload_bytes"]) == (u, len(body))
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if i in (3, None) else ("response", None))
        assert bytes(r["payload"]) == (b"" if r["record_type"] == "revisit" else body)
    assert max(len(r["key"]) for r in keys.collect()) > 3000  # keys of long urls are whole
    missing = spark.createDataFrame([("com,nowhere) 1",), (None,)], "key string")
    assert warc.lookup(missing, parts, folder).count() == 0
    empty, none = warc.archive(pages.limit(0))
    assert none == [] and warc.fetch(warc.lookup(keys, none, empty), empty).count() == 0


def test_revisits_name_the_record_they_refer_to():
    page = warc.parse(warc.record(1, "http://a/", b"x" * 100, warc.sha256(b"x" * 100).hexdigest(), None, 100))
    again = warc.parse(warc.record(2, "http://b/", b"", page["payload_digest"], 1, 100))
    assert (again["record_type"], again["refers_to"], again["refers_to_id"]) == ("revisit", 1, page["record_id"])
    assert again["record_id"] != page["record_id"]
    assert warc.record(1, None, b"", "d", None, 0) == warc.record(1, None, b"", "d", None, 0)  # a second attempt gives the same


# ---- 2 toxicity


def plain_score(model, text):
    """Noisy-or with a leak, sentence by sentence and word by word."""
    clean = 1 - (1 - np.exp(-model.leak))
    for sentence in re.split(r"[\n\r!.?]", text or ""):
        found = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", sentence)
        if not found:
            continue
        z = model.bias
        for word in found:
            (_, feature, _, _) = next(iter(toxicity.bags(pa.array([word]))))
            z += sum(model.weights[k] for k in feature[:, 0])
        clean *= 1 - 1 / (1 + np.exp(-z))
    return 1 - clean


def test_scores_are_the_noisy_or_of_sentences():
    rng = np.random.default_rng(7)
    model = toxicity.Model(rng.normal(0, 0.6, 1 << toxicity.BITS), -1.5, 0.02)
    texts = ["One two. Three, four! five", "", None, "ÄÖ ß-x\nnext line? . . end", "a " * 50 + ".", "A a. a A", "long " * 3000 + "! tail"]
    assert np.allclose(model.score(pa.array(texts)), [plain_score(model, t) for t in texts])


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    doc, s, f = np.array([0, 0, 1, 2, 2, 2]), np.array([0, 0, 1, 2, 3, 4, 5, 5]), np.array([0, 1, 2, 3, 0, 1, 2, 3])
    y, theta = np.array([1.0, 0.0, 1.0, 0.0]), np.append(rng.normal(0, 1, 4), [-0.7, -1.2])
    _, g = toxicity.loss_and_gradient(theta, f, s, doc, y, 0.3)
    for k in range(len(theta)):
        step = np.zeros(len(theta))
        step[k] = 1e-6
        up, down = (toxicity.loss_and_gradient(theta + d, f, s, doc, y, 0.3)[0] for d in (step, -step))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-6


def test_the_training_sample_is_bounded_by_bytes(spark):
    rows = [(i, "bad word " * 10 if i % 2 else "fine text " * 10) for i in range(200)] + [(1000, "x" * 100_000)]
    docs = spark.createDataFrame(rows + rows[:20], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    real, toxicity.fit = toxicity.fit, lambda texts, y: seen.append(texts.to_pylist())
    try:
        toxicity.train(docs, labels, max_train_bytes=2000)
        toxicity.train(docs, labels, max_train=7)
        toxicity.train(docs.limit(0), labels)
    finally:
        toxicity.fit = real
    assert 1800 < sum(map(len, seen[0])) <= 2000 and len(seen[1]) == 7 and seen[2] == []



def test_noisy_or_learns_and_locates(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choices(vocabulary, k=6)) for _ in range(rng.randint(2, 12))]
        toxic = i % 5 == 0
        if toxic:
            sentences[rng.randrange(len(sentences))] += " vileword" + rng.choice(["", "s", "ed"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    docs += [(600, None), (601, ""), (602, "Vileword. fine words here")]
    frame = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash"))
    model = toxicity.train(frame, spark.createDataFrame(labels + [(0, None), (999, 1), (None, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(frame, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.97
    assert got[600]["predicted"] == got[601]["predicted"] == 0 and got[602]["predicted"] == 1
    spans = {r["doc_id"]: r["sentences"] for r in toxicity.locate(frame.where("doc_id >= 600"), model).collect()}
    assert [(s["start"], s["end"]) for s in spans[602]] == [(0, 8)] and spans[600] == []


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    for labels in ([], [(1, 0), (2, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r["score"] < 1e-6 for r in toxicity.score(docs, model).collect()] == [True, True]


# ---- 3 line dedup


def test_windows_remove_later_occurrences(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n\nb \nc\ny"), (3, "a\nb"), (4, None), (5, ""), (None, "q\nb\nc\nd"), (7, "l\nl\nl\nl\nl"), (8, "a\nb\nc\nd"), (8, "a\nb\nc\nd")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("removed_lines", F.lit("clash"))
    got = rows_of(linededup.dedup(docs), "doc_id", "text", "n_lines", "removed_lines")
    want = [(1, "a\nb\nc\nd", 4, 0), (2, "x\n\ny", 5, 3), (3, "a\nb", 2, 0), (4, None, 0, 0), (5, "", 0, 0), (None, "q", 4, 3), (7, "l", 5, 4), (8, "", 4, 4), (8, "", 4, 4)]
    assert got == sorted(want, key=repr)
    assert linededup.dedup(docs.limit(0)).count() == 0


def plain_passages(rows, words):
    """(doc_id, words that stay) by comparing every run."""
    first, out = {}, []
    for name, text in sorted(rows):
        w = text.lower().split()
        stay = [True] * len(w)
        for k in range(len(w) - words + 1):
            d, at = first.setdefault(tuple(w[k : k + words]), (name, k))
            if d != name or k - at >= words:
                stay[k : k + words] = [False] * words
        out.append((name, [x for x, s in zip(w, stay) if s]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("aAb") + rng.choice(["\n", " ", "  "]) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    got = [(r["doc_id"], r["text"].lower().split()) for r in linededup.passages(spark.createDataFrame(rows, DOCS).repartition(3), words=8, seed=3).orderBy("doc_id").collect()]
    assert got == plain_passages(rows, 8) and got != [(i, t.lower().split()) for i, t in rows]


def test_pipeline_drops_long_passages_inside_lines(spark, tmp_path):
    bench = str(tmp_path)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")
    p = " ".join(f"p{i}" for i in range(51))
    rows = [(1, f"one two {p} three"), (2, f"four\nfive {p} six\nseven"), (3, p), (4, None), (None, f"{p} end"), (5, f"short {p[:-4]}"), (6, f"up\n{p.upper()}\ndown")]
    docs = spark.createDataFrame(rows, DOCS)
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        if name in ("line dedup", "benchmark decontamination"):
            got = stage(spark, got, bench)
    want = [rows[0], (2, "four\nfive six\nseven"), (4, None), (None, "end"), rows[5], (6, "up\ndown")]
    assert rows_of(got, *docs.columns) == sorted(want, key=repr)
    assert linededup.passages(docs.limit(0)).count() == 0


# ---- 4 near-duplicates


def _corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(500)]
    bases = [rng.choices(vocabulary, k=rng.randint(1, 60)) for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((rng.randrange(10**6), " ".join(w)))
    return rows + [(5, None), (6, ""), (7, " \n"), (8, "One"), (9, "one"), (None, "one"), (None, "alone here"), (4, "one"), (4, "one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "SALT_ROWS", 4)
    rows = _corpus(seed, 250)
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)).withColumn("row", F.lit(2))
    want = brute.near_groups(rows)
    expected = sorted(((i, len(brute.shingles(t, 4)), want[k], i == want[k]) for k, (i, t) in enumerate(rows)), key=repr)
    assert rows_of(minhash.groups(docs, words=4), "doc_id", "n_shingles", "component_id", "kept") == expected


def test_links_at_just_the_threshold_are_found(spark):
    """9 of 10 words shingles of 4 in a chain: each pair has similarity of exactly 0.8, and groups only hold by the chain."""
    rows = []
    for g in range(60):
        w = [f"g{g}w{k}" for k in range(12)]  # 9 shingles; a new last word keeps 8 of 10
        rows += [(10 * g, " ".join(w)), (10 * g + 1, " ".join([*w[:-1], "other"]))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.groups(spark.createDataFrame(rows, DOCS), words=4).collect()}
    assert all(got[10 * g + 1] == 10 * g for g in range(60))


def test_near_duplicates_of_an_empty_table(spark):
    assert minhash.groups(spark.createDataFrame([], DOCS)).count() == 0


def test_signature_is_unbiased():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], rng.integers(0, 1 << 63, 100).astype(np.uint64)))
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 300 / 500) < 0.15


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_connected_components(spark, links):
    got = dict(rows_of(components.components(spark.createDataFrame([*links, (None, 1)], "a long, b long")), "node", "label"))
    near = {x: {x} for l in links for x in l}
    for a, b in links * 40:
        near[a] = near[b] = near[a] | near[b]
    for a, b in links:
        for x in near[a]:
            near[x] = near[a]
    assert got == {x: min(s) for x, s in near.items() if len(s) > 1}


# ---- 5 preference formatting


def test_prompt_is_the_common_prefix(spark):
    kind = "pair_id long, turn int, role string, text string"
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "same"), (3, 0, "user", "only"), (4, None, "user", None), (None, 0, "user", "x"), (5, 0, "user", None), (5, 1, "assistant", "a")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (2, 0, "user", "same"), (4, None, "user", ""), (5, 0, "user", None), (5, 1, "assistant", "a"), (5, 2, "user", "more")]
    got = rows_of(preference.format_pairs(preference.sides(spark.createDataFrame(chosen, kind).withColumn("split", F.lit(1)), spark.createDataFrame(rejected, kind))), "pair_id", "part", "turn", "rendered", "learn_from", "learn_to")
    r = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    h = len("<|im_start|>assistant\n")
    want = [
        (1, "prompt", 0, r("user", "q"), 0, 0), (1, "chosen", 1, r("assistant", "good"), h, h + 15), (1, "rejected", 1, r("assistant", "bad"), h, h + 14),
        (2, "prompt", 0, r("user", "same"), 0, 0), (3, "chosen", 0, r("user", "only"), 0, 0), (4, "chosen", None, r("user", ""), 0, 0), (4, "rejected", None, r("user", ""), 0, 0),
        (5, "prompt", 0, r("user", ""), 0, 0), (5, "prompt", 1, r("assistant", "a"), 0, 0), (5, "rejected", 2, r("user", "more"), 0, 0),
    ]
    assert got == sorted(want, key=repr)
    empty = spark.createDataFrame([], kind)
    assert preference.format_pairs(preference.sides(empty, empty)).count() == 0


def test_pairs_branch_early_or_late(spark):
    kind = "conv_id long, turn int, role string, text string"
    talk = lambda i, n: [(i, t, "assistant" if t % 2 else "user", f"{'q' if t % 2 == 0 else 'a'}{i}.{t}") for t in range(n)]
    rows = [*talk(1, 6), *talk(2, 4), *talk(3, 7), (3, 3, "user", "again"), (5, 0, "user", "alone"), (None, 0, "user", "x"), (6, 1, "assistant", "no neighbour"), (2, 2, None, None), (4, 1, "assistant", "z" * 100_000)]
    sides = preference.with_foreign_reply(spark.createDataFrame(rows, kind).withColumn("side", F.lit("clash")))
    got = preference.format_pairs(sides).collect()
    part = lambda i, p: sorted((r["turn"], r["rendered"].split("\n", 1)[1][:-11]) for r in got if (r["pair_id"], r["part"]) == (i, p))
    assert {r["pair_id"] for r in got} == {2, 3, 4}
    assert part(2, "chosen") == [(3, "a2.3")] and part(2, "rejected") == [(3, "a1.5")] and len(part(2, "prompt")) == 4
    assert part(3, "prompt") == [(0, "q3.0")] and part(3, "chosen")[0] == (1, "a3.1") and part(3, "rejected")[0] == (1, "a2.1")
    assert part(3, "chosen")[1:] == part(3, "rejected")[1:] == [(2, "q3.2"), (3, "a3.3"), (3, "again"), (4, "q3.4"), (5, "a3.5")]
    assert part(4, "chosen") == [(1, "z" * 100_000)] and part(4, "rejected") == [(1, "a3.5")]
    assert preference.with_foreign_reply(spark.createDataFrame([], kind)).count() == 0


# ---- 6 licences


def test_licence_lines(spark):
    rows = [(1, "intro\nReleased under the MIT license!\nmore"), (2, "All rights reserved"), (3, None), (4, ""), (5, "all rights all rights reserved"), (6, "released under the"), (2, "All rights reserved"), (None, "ALL RIGHTS RESERVED.\n")]
    got = rows_of(licenses.scan(spark.createDataFrame(rows, DOCS).withColumn("gram", F.lit(0))), "doc_id", "line", "license", "dice")
    assert got == sorted([(1, 0, "MIT", 0.8), (1, 2, "MIT", 1.0), (2, 1, "all-rights-reserved", 1.0), (2, 1, "all-rights-reserved", 1.0), (5, 1, "all-rights-reserved", 1.0), (None, 0, "all-rights-reserved", 1.0), (None, 1, "all-rights-reserved", 1.0)], key=repr)
    for size in range(1, 40):
        low, high = licenses.bounds(size, 0.8)
        assert all((2 * min(n, size) / (n + size) >= 0.8) == (low <= n <= high) for n in range(1, 100))


def test_licences_inside_texts(spark):
    w = licenses.TEMPLATES["MIT-notice"].split()
    filler = ["filler text of other words"] * 20
    wrapped = "\n".join([*filler, *["# " + " ".join(w[k : k + 7]) for k in range(0, len(w), 7)], "#", *filler])
    full = "/*\n" + "\n".join(" * " + x for x in re.findall(r".{1,60}(?: |$)", licenses.TEMPLATES["MIT-text"])) + "\n */\nint main() {}\n" + "code(); " * 300
    rows = [
        (1, wrapped), (2, "We did a lot of work here and there. All rights reserved. Released under the MIT License. This is some more text."),
        (3, "Mit grows. Released under the MIT License. Nothing under the mit sun."), (4, None), (5, ""), (6, full), (6, full), (7, "word " * 50_000 + "all rights\nreserved " * 2), (8, "of the and the " * 400),
    ]
    docs = spark.createDataFrame(rows, DOCS).withColumn("line", F.lit("clash"))
    got = rows_of(licenses.scan(docs), "doc_id", "kind", "line", "license", "dice")
    want = [(1, "run", 21, "MIT-notice", 1.0), (2, "run", 1, "MIT", 1.0), (2, "run", 1, "all-rights-reserved", 1.0), (3, "run", 1, "MIT", 1.0), (6, "run", 2, "MIT-notice", 1.0), (6, "run", 2, "MIT-text", 1.0)]
    want += [want[-2], want[-1], (7, "run", 1, "all-rights-reserved", 1.0), (7, "run", 2, "all-rights-reserved", 1.0)]
    assert got == sorted(want, key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0


def plain_runs(text, template):
    """Dice of every run of the template's size that begins with one of its bigrams: {place: dice}"""
    grams = lambda t: [f"{a} {b}" for w in [re.findall(r"[^\W_]+", t.lower())] for a, b in zip(w, w[1:])]
    g, t = grams(text), grams(template)
    bag = {x: t.count(x) for x in t}
    runs = {p: g[p : p + len(t)] for p in range(len(g)) if g[p] in bag}
    return {p: 2 * sum(min(r.count(x), n) for x, n in bag.items()) / (len(r) + len(t)) for p, r in runs.items()}


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    template = "a b a b c d a b e"
    rows = [(i, " ".join(rng.choice(["a b", "c d", "a", "b", "e", "a b a b c d a b e", "z"]) + rng.choice(["", "", "\n"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    got = rows_of(licenses.scan(spark.createDataFrame(rows, DOCS), {"T": template}).where("kind = 'run'"), "doc_id", "dice")
    least = []
    for i, t in rows:
        good = {p: d for p, d in plain_runs(t, template).items() if d >= 0.8}
        lines = [len(re.findall(r"\w+", x)) - 1 for x in t.split("\n")]
        starts = [k for k, n in enumerate(lines) for _ in range(n + 1)]
        alone = {k for k, x in enumerate(t.split("\n")) if lines[k] > 0 and 2 * sum(min(x.split().__len__() and [f"{a} {b}" for a, b in zip(x.split(), x.split()[1:])].count(g), n) for g, n in {"a b": 3, "b a": 1, "b c": 1, "c d": 1, "d a": 1, "b e": 1}.items()) / (lines[k] + 8) >= 0.8}
        place, last = [], None
        for p in sorted(good):
            if last is None or 2 * (p - last) > 8:
                place.append([])
            place[-1].append(p)
            last = p
        for group in place:
            best = max(group, key=lambda p: (good[p], -p))
            if starts[best] not in alone:
                least.append((i, good[best]))
    assert got == sorted(least, key=repr) and got


# ---- 7 top-k


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(1, 7), st.integers(0, 10**6), st.sampled_from([1, 3, 400, 2**40]))
def test_threshold_algorithm_is_exact(n, d, k, seed, scale):
    rng = np.random.default_rng(seed)
    ids, v = rng.permutation(n), rng.integers(-scale, scale + 1, (n, d)).astype(float)
    q, names = np.concatenate((v[:3], rng.integers(-scale, scale + 1, (2, d)))).astype(float), np.concatenate((ids[:3], [100, 101]))
    got = topk.Lists(ids, v).best(q, names, k, step=2)
    for row, name, found in zip(q, names, got):
        every = sorted((-sum(int(a) * int(b) for a, b in zip(row, x)), int(i)) for i, x in zip(ids, v) if i != name)
        assert found == [(-s, i) for s, i in every[:k]]


def test_threshold_algorithm_stops_early():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.standard_normal((20_000, 3)))
    lists = topk.Lists(np.arange(20_000), v)
    lists.best(v[:1], np.array([0]), 5)
    assert lists.reads < 10_000


def test_search_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 9.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [0.5]), (8, []), (1, [0.5, 0.5]), (None, [1.0, 1.0]), (50, [-0.001, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("asks", F.lit("clash"))
    got = rows_of(topk.search(frame, F.col("vec_id") % 50 == 0, 4), "query_id", "rank", "vec_id", "score")
    assert [r for r in got if r[0] == 0] == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 2, 32768), (0, 4, 7, 32768)]
    assert [r for r in got if r[0] == 50] == [(50, 1, 8, 0), (50, 2, 1, -128), (50, 3, 1, -128), (50, 4, 2, -128)]
    assert topk.search(frame.limit(0), F.col("vec_id") == 0).count() == 0


# ---- 8 urls


def test_rules_and_propagation(spark):
    def page(url, *links):
        return url, "".join(f'<a href="{x}">' for x in links)

    pages = [
        page("http://A.example.net/en/x"), page("http://example.net/fr/"), page("https://a.net?x=/"), page("http://x.org/fr/y", "http://friend.com/"), page("http://notnet/"),
        page(None), page("nothing"), page("http://friend.com/", "http://spam.net/", "/local"), page("http://linker.com/a", "//SPAM.net/q", "http://other.io"), page("http://other.io/"), page("http://spam.net/"),
    ]
    frame = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)] + [(99, "http://x.com/", None)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(frame).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/fr/", "net/", "block")
    assert got[2] == ("a.net", "", None, "allow")
    assert got[3] == ("x.org", "/fr/y", "org/fr/", "allow")
    assert got[4] == ("notnet", "/", None, "allow")
    assert got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == (None, "allow") and got[8][2:] == (None, "block") and got[9][3] == "allow" and got[99][3] == "allow"
    assert urlfilter.judge(frame.limit(0)).count() == 0


def test_distrust_settles_on_long_chains(spark):
    hosts = [f"c{k}.com" for k in range(11)]
    links = {"c0.com": ["s1.net", "s2.net", "s3.net"]} | {hosts[k]: [hosts[k - 1]] for k in range(1, 11)}
    rows = [(i, f"http://{h}/", "".join(f'<a href="http://{x}/">' for x in links.get(h, []))) for i, h in enumerate([*hosts, "s1.net", "s2.net", "s3.net"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["verdict"] for r in urlfilter.judge(pages).collect()} == {"block"}
    with pytest.raises(RuntimeError):
        urlfilter.judge(pages, limit=5)


def plain_walk(links, start, rounds=400):
    """Power iteration: mass that reaches a host without links stays out."""
    hosts = sorted({x for l in links for x in l[:2]} | set(start))
    out = {h: sum(n for a, _, n in links if a == h) for h in hosts}
    base = {h: 0.15 * start.get(h, 0.0) for h in hosts}
    now = dict(base)
    for _ in range(rounds):
        new = dict(base)
        for a, b, n in links:
            new[b] += 0.85 * now[a] * n / out[a]
        now = new
    return now


@pytest.mark.parametrize("seed", range(3))
def test_propagation_is_the_power_iteration(spark, seed):
    rng = random.Random(seed)
    links = sorted({(f"h{rng.randrange(9)}", f"h{rng.randrange(12)}"): rng.randint(1, 4) for _ in range(25)}.items())
    links = [(a, b, n) for (a, b), n in links if a != b]  # hosts 9 to 11 have no links; the rest has cycles
    seeds = [("h0", 1.0, 0.0), ("h1", 1.0, 0.0), ("h2", 0.0, 1.0), ("h10", 0.0, 1.0), ("lonely", 1.0, 1.0)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urlfilter.propagate(spark.createDataFrame(links, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trusted double, blocked double")).collect()}
    trust = plain_walk(links, {h: t for h, t, _ in seeds if t})
    distrust = plain_walk([(b, a, n) for a, b, n in links], {h: b for h, _, b in seeds if b})
    for h in set(trust) | set(distrust):
        assert np.allclose(got.get(h, (0.0, 0.0)), (trust.get(h, 0.0), distrust.get(h, 0.0)), atol=1e-5)


def test_equal_rules_go_to_the_first_by_name(spark):
    pages = spark.createDataFrame([(1, "http://a.b.c/", "x"), (1, "http://a.b.c/", "x"), (2, "http://b.c/" + "p" * 50_000, None)], "page_id long, url string, html string")
    got = rows_of(urlfilter.judge(pages, [("block", "b.c", "/"), ("allow", "a.b.c", ""), ("allow", "c", "/p")]), "page_id", "rule", "verdict")
    assert got == [(1, "a.b.c", "allow"), (1, "a.b.c", "allow"), (2, "b.c/", "block")]


# ---- 9 decontamination


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=24), st.integers(1, 4))
def test_tiles_are_valid_and_cover_like_the_plain_version(p, t, least):
    a, b = K.mix(np.array(p, np.uint64) + np.uint64(9)), K.mix(np.array(t, np.uint64) + np.uint64(9))
    got = decontam.tiles(a, b, least)
    seen_p, seen_t = [], []
    for i, j, n in got:
        assert p[i : i + n] == t[j : j + n] and n >= min(least, max(len(p), 1))
        seen_p += range(i, i + n)
        seen_t += range(j, j + n)
    assert len(set(seen_p)) == len(seen_p) and len(set(seen_t)) == len(seen_t)
    want = brute.tiling(p, t, min(least, max(len(p), 1)))
    assert bool(got) == bool(want) and (not got or got[0][2] == want[0][2]) and len(seen_p) == sum(n for _, _, n in want)


def test_reordered_passages_are_found(spark):
    w = [f"t{k}" for k in range(40)]
    item, other = " ".join(w), " ".join(f"u{k}" for k in range(10))
    rows = [(1, " ".join(["x"] * 5 + w[20:] + ["y"] * 3 + w[:20])), (2, " ".join(w[:30])), (3, item.upper()), (4, None), (5, ""), (6, "nothing in common"), (3, item.upper()), (7, "a b"), (8, " ".join(w[:32] + ["q"]))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("hits", F.lit("clash")).withColumn("coverage", F.lit("clash"))
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, ""), (14, "a b"), (None, item)], "item_id long, text string")
    got = rows_of(decontam.decide(docs, bench), "doc_id", "item_id", "covered_words", "coverage", "contaminated")
    want = [(1, 10, 40, 1.0, True), (2, 10, 30, 0.75, False), (3, 10, 40, 1.0, True), (3, 10, 40, 1.0, True), (4, None, 0, 0.0, False), (5, None, 0, 0.0, False), (6, None, 0, 0.0, False), (7, 14, 2, 1.0, True), (8, 10, 32, 0.8, True)]
    assert got == sorted(want, key=repr)
    parts = decontam.decide(docs, bench, chunk_bytes=40)  # a benchmark of several chunks
    assert rows_of(parts, "doc_id", "item_id", "covered_words", "coverage", "contaminated") == got
    assert not decontam.decide(docs, bench.limit(0)).where("contaminated").count() and decontam.decide(docs.limit(0), bench).count() == 0


def test_shared_openings_cost_no_tiling_of_all_items(spark, monkeypatch):
    """Of many items with one opening phrase, few are tiled, and the result is that of tiling them all."""
    rng = random.Random(4)
    opening = [f"o{k}" for k in range(9)]
    items = [(i, " ".join(opening + [f"x{rng.randrange(60)}" for _ in range(rng.choice([11, 11, 20]))])) for i in rng.sample(range(1000), 120)] + [(None, " ".join(opening))]
    rows = [(1, " ".join(opening)), (2, " ".join(opening + ["q"] + [f"x{k}" for k in range(60)])), (3, items[7][1] + " tail"), (4, "o0 o1 o2 o3 o4"), (5, None), (6, "u " * 20_000 + items[3][1])]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "item_id", "covered_words", "contaminated")
    got = rows_of(decontam.decide(docs, bench), *names)
    all_hits = {r["doc_id"]: r["hits"] for r in decontam.hits(docs, bench).collect()}
    best = {d: min(((-h["covered"] / h["words"], h["item_id"] is None, h["item_id"] or 0, h["covered"]) for h in hits), default=None) for d, hits in all_hits.items()}
    assert got == sorted(((d, None if not b or b[1] else b[2], b[3] if b else 0, bool(b) and -b[0] >= 0.8) for d, b in best.items()), key=repr)
    few = {r["doc_id"]: len(r["hits"]) for r in decontam.hits(docs, bench, at_least=0.8).collect()}
    assert few[4] == 1 and few[3] < 10 and len(all_hits[4]) == 121


# ---- 10 packing


@pytest.mark.parametrize("seed", range(25))
def test_packing_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 10, 64, 100])
    items = [(i, rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, 1, 2, *range(10, 40)]), rng.randint(0, capacity * 2)) for i in range(rng.randint(0, 200))]
    assert packing.pack(items, capacity) == brute.best_fit(items, capacity)


def test_packing_keeps_every_word(spark):
    rows = [(i, "w " * (i * 37 % 300), "hot" if i % 3 else None, i) for i in range(100)] + [(7, None, "s", 0), (None, "a b", None, 0), (7, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = packing.packed(docs, capacity=128, shard=40)
    total = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert total == {**{i: (i * 37 % 300) for i in range(100)}, None: 2}
    assert got.groupBy("bin_id").agg(F.sum("n_words").alias("n")).agg(F.max("n")).first()[0] <= 128
    assert got.join(docs.select("doc_id", "source"), "doc_id").where("source = 'hot' and doc_id <> 7").groupBy("bin_id").count().agg(F.max("count")).first()[0] == 1
    assert packing.packed(docs.limit(0)).count() == 0


def test_op10_keeps_near_copies_apart(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    edited = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words), "a"), (2, edited, "b"), (None, " ".join(["new", *words[1:]]), "c"), (None, edited, "d"), (5, "", "e"), (6, None, "f"), (7, "quite different", "g")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_conflict_packing(spark, str(tmp_path)).collect()
    assert sum(r["n_words"] for r in got) == 242 and len(got) == 7
    assert len({r["bin_id"] for r in got if r["n_words"] == 60}) == 4
    assert len({r["bin_id"] for r in got}) == 4
