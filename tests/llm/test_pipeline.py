"""The five stages on odd rows, and the pipeline against plain versions of its stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from . import brute

KIND = "doc_id long, text string, lang string, source string, n_chars long, d string, k int, n int, words int, component_id string"
STAGES = dict(corpus_pipeline.STAGES)
FILTERS = list(STAGES)[:-1]


def row(i, text, source="s", lang="en"):
    return (i, text, lang, source, None if text is None else len(text), "d", 1, 2, 3, "c")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """labels and benchmark: vileword is toxic, and one item of 20 words."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def taught(n=300):
    rng = random.Random(1)
    return [row(i, ". ".join(" ".join(rng.choices([f"w{k}" for k in range(300)], k=9)) + (" vileword" if i % 3 == 0 and s == 1 else "") for s in range(4))) for i in range(n)]


def got_of(spark, tables, name, rows):
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    out = STAGES[name](spark, docs, tables)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_the_stages_are_five():
    assert list(STAGES) == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]


@pytest.mark.parametrize("name", FILTERS)
def test_rows_without_words_and_repeated_rows(spark, tables, name):
    """Null and empty texts and ids, rows that repeat, and columns named like a stage's own."""
    rows = [row(None, None), row(None, ""), row(None, None), row(4, None), row(4, ""), row(4, " \n\t"), row(5, ""), row(5, "", source="other"), row(6, "only one"), row(None, "some text here"), row(7, "x")]
    assert got_of(spark, tables, name, rows) == sorted(rows, key=repr)


@pytest.mark.parametrize("name", FILTERS)
def test_empty_tables(spark, tables, name):
    assert got_of(spark, tables, name, []) == []


@pytest.mark.parametrize("name", FILTERS)
def test_a_very_long_text_stays_whole(spark, tables, name):
    rng = random.Random(2)
    rows = [row(1, " ".join(f"l{rng.randrange(10**9)}" for _ in range(120_000))), row(2, "short")]
    assert got_of(spark, tables, name, rows) == sorted(rows, key=repr)


def test_toxic_documents_go(spark, tables):
    rows = [*taught(), row(900, "Good start. What a vileword! End."), row(900, "Good start. What a vileword! End."), row(901, "Good start. End."), row(None, "vileword")]
    got = got_of(spark, tables, "toxicity", rows)
    assert not [r for r in got if r[0] in (900, None)] and [r for r in got if r[0] == 901]
    assert len([r for r in got if (r[0] or 0) < 300 and r[0] % 3]) == 200


def test_lines_go_with_their_characters(spark, tables):
    rows = [row(1, "a\nb\nc\nd"), row(2, "x\na\nb\nc"), row(3, "a\nb\nc"), row(None, "a\nb\nc\nz"), row(2, "x\na\nb\nc")]
    assert got_of(spark, tables, "line dedup", rows) == sorted([row(1, "a\nb\nc\nd"), row(2, "x"), row(2, "x"), row(None, "z")], key=repr)


def test_one_row_of_each_group_stays(spark, tables):
    t = [f"t{k}" for k in range(40)]
    base, near, far = " ".join(t), " ".join([*t[:-1], "new"]), " ".join(reversed(t))
    rows = [row(9, base), row(3, near, source="b"), row(3, near, source="a"), row(3, base), row(3, far), row(None, base), row(None, far), row(5, "lone"), row(5, "lone"), row(None, "null id alone"), row(None, "null id alone")]
    got = got_of(spark, tables, "MinHash near-dedup", rows)
    assert len([r for r in got if r[1] in (base, near)]) == 1 and {r[0] for r in got if r[1] in (base, near)} == {3}
    assert [r for r in got if r[1] == far] == [row(3, far)]
    assert [r for r in got if r[1] == "lone"] == [row(5, "lone")] and [r for r in got if r[1] == "null id alone"] == [row(None, "null id alone")]
    assert got_of(spark, tables, "MinHash near-dedup", rows[::-1]) == got


def test_of_equal_rows_the_least_by_the_other_columns_stays(spark, tables):
    rows = [row(1, "same text", source=s, lang=g) for s in "cab" for g in ("fr", "de")]
    assert got_of(spark, tables, "MinHash near-dedup", rows) == [row(1, "same text", source="a", lang="de")]


def test_groups_match_brute_force(spark, tables):
    rng = random.Random(8)
    bases = [rng.choices([f"v{k}" for k in range(400)], k=rng.randint(1, 50)) for _ in range(9)]
    texts = []
    for i in range(120):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(["v1", "v2", f"n{i}"])
        texts.append((i, " ".join(w)))
    found = brute.near_groups(texts, 5)
    want = sorted({found[k] for k in range(len(texts))})
    assert sorted(r[0] for r in got_of(spark, tables, "MinHash near-dedup", [row(i, t) for i, t in texts])) == want


def test_contaminated_documents_and_passages_go(spark, tables):
    item = [f"item{k}" for k in range(20)]
    p = " ".join(f"p{k}" for k in range(60))
    rows = [row(1, "start " + " ".join(item[10:] + ["mid"] + item[:10])), row(2, " ".join(item[:15])), row(3, f"a {p} b"), row(4, f"c {p} d"), row(4, f"c {p} d"), row(None, p)]
    got = got_of(spark, tables, "benchmark decontamination", rows)
    assert got == sorted([row(2, " ".join(item[:15])), row(3, f"a {p} b"), row(4, "c d"), row(4, "c d")], key=repr)


def test_packing_takes_every_row(spark, tables):
    rows = [row(i, "w " * (i % 50), source=f"s{i % 7}") for i in range(60)] + [row(None, None), row(None, "", source=None), row(1, "w", source="s1"), row(99, "w " * 5000)]
    got = STAGES["best-fit packing"](spark, spark.createDataFrame(rows, KIND), tables).collect()
    assert sum(r["n_words"] for r in got) == sum(len((r[1] or "").split()) for r in rows)
    assert len([r for r in got if r["doc_id"] == 99]) == 3 and len([r for r in got if r["doc_id"] is None]) == 2
    assert STAGES["best-fit packing"](spark, spark.createDataFrame([], KIND), tables).count() == 0


def test_run_writes_each_stage(spark, tables):
    rows = [*taught(60), row(500, "one two three four five six"), row(501, "one two three four five six")]
    spark.createDataFrame(rows, KIND).write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    packed = corpus_pipeline.run(spark, tables)
    assert packed.where("doc_id = 500").count() == 1 and packed.where("doc_id = 501").count() == 0
    assert packed.groupBy("bin_id").agg(F.sum("n_words").alias("n")).where(F.col("n") > 2048).count() == 0
