"""Hot keys are split: the executed plans say so, with thresholds lowered to the size of a test."""

import pytest
from pyspark.sql import functions as F

from quern.functions import scratch
from quern.llm import linededup, minhash, warc
from quern.operators import components

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def plans(spark, monkeypatch):
    """Texts of the plans that wrote tables, as they were run."""
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    seen = []

    def stored(df, path):
        # a copy of what stored() does, on a frame whose plan can be read afterwards
        rows = df.collect()
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    for module in (scratch, linededup.common, components):
        monkeypatch.setattr(module, "stored", stored)
    yield seen
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed(texts):
    return [t for t in texts if "skew=true" in t]


def test_a_window_that_many_documents_share_is_split(spark, plans):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb\nc\n"), F.sha2(F.col("id").cast("string"), 256)).alias("text")).repartition(8)
    df = linededup.dedup(docs)
    assert sum(r["removed_lines"] for r in df.collect()) == 3 * 5999
    plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert skewed(plans)


def test_a_giant_component_is_split(spark, plans):
    links = spark.range(1, 20_000).select(F.lit(0).alias("a"), F.col("id").alias("b")).repartition(8)
    got = components.components(links)
    assert got.count() == 20_000 and got.where("label <> 0").isEmpty()
    assert skewed(plans)


def test_a_full_bucket_is_split(spark, plans):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty w"), F.col("id")).alias("text")).repartition(8)
    assert minhash.groups(docs).select("component_id").distinct().count() == 1
    assert skewed(plans)


def test_a_page_that_many_captures_hold_is_decided_on_digests(spark, plans):
    pages = spark.range(8000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.example/"), F.col("id")).alias("url"), F.lit("same payload " * 20).alias("html")).repartition(8)
    folder = scratch.scratch(spark, "warc-test")
    assert warc.write(pages, folder).count() == 8000
    assert skewed(plans)
    # no join by digest alone carries a payload
    for text in plans:
        for line in text.split("\n"):
            if "SortMergeJoin" in line and "digest" in line and "page_id" not in line:
                assert "payload" not in line
