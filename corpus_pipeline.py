"""The corpus pipeline: toxic documents go, repeated lines go, near-duplicates leave one of each group,
contaminated documents go with the repeated passages of the rest, and what remains is packed into sequences.

Every stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of docs.  run() writes
each stage's result as Parquet in the shared folder and reads it again for the next.

Defined cases, for every stage: a null or empty text, or one of white space only, has no words: it is never
toxic, repeated, a duplicate or contaminated, and every such row stays; null ids are kept apart by their texts;
texts of any length count whole; extra columns, also those named like a stage's own, pass through all stages but
the last, which ignores them; an empty table gives an empty result.  What ties and repeated rows mean is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import common, decontam, linededup, minhash, packing, toxicity

#: Toxicity, tiling and packing have no form in SQL.
ORACLE_SQL = None


def _with_text(docs: DataFrame, clean: DataFrame, changed: Column) -> DataFrame:
    """The columns of docs out of clean (d: the old row, t: the text now); n_chars follows the text."""
    keep = {"text": F.col("t")}
    if "n_chars" in docs.columns:
        keep["n_chars"] = F.when(changed, F.length("t")).otherwise(F.col("d.n_chars"))
    return clean.select(*[keep.get(c, F.col(f"d.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents scored 0.7 or more by a model of the labels that may teach.  Repeated rows score alike."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct("*").alias("d"), F.col("text").alias("t")), model, text="t")
    return scored.where("predicted = 0").select("d.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cleans texts of repeated three-line windows; a document that loses all of its lines goes.

    The first occurrence, by doc_id (nulls last), text and place, stays; rows equal in id and text are one document and lose the same lines.
    """
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").alias("i"), F.col("text").alias("t"))
    clean = linededup.dedup(rows, doc_id="i", text="t").where("removed_lines = 0 or n_lines > removed_lines")
    return _with_text(docs, clean, F.col("removed_lines") > 0)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of five-word shingle sets at similarity 0.8 or more.

    It is the row of the group's least doc_id; of several texts under that id, the one with the least hash; of rows that
    are equal in id and text, the least in the order of the other columns (written as JSON).  Rows without words stay all.
    """
    name = lambda i, fp: F.concat(F.coalesce(i.cast("string"), F.lit("-")), F.lit(":"), F.hex(fp))
    best = minhash.groups(docs).where("group is not null and kept").groupBy("group").agg(F.min("row").alias("row"))
    best = best.select(name(F.col("row.id"), F.col("row.fp")).alias("best"))
    key = common.row_key(F.col("doc_id").cast("long"), F.col("text"))
    others = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]))
    rows = docs.select(F.struct("*").alias("d"), key.alias("row"), F.coalesce(F.rlike("text", F.lit(packing.WORD)), F.lit(False)).alias("words"), others.alias("o"))
    # rows without words have keys of their own, so they are spread and never compared
    rows = rows.select("d", "o", "words", F.when(F.col("words"), name(F.col("row.id"), F.col("row.fp"))).otherwise(F.concat(F.lit("w"), F.monotonically_increasing_id())).alias("k"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o"))).where("n = 1")
    return first.join(best, F.col("k") == F.col("best"), "left").where("best is not null or not words").select("d.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose tiles cover 0.8 or more of a benchmark item, then cuts repeated runs of 51 words out of the rest.

    The runs go only now, so that a part of an item is never cut from under the tiling, nor a near copy changed before
    it is known as one, and the occurrence that stays is in a document that stays.  A document all of whose words were
    in such runs goes.  Rows that repeat are decided alike.
    """
    judged = decontam.decide(docs.select(F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t")), common.table(spark, sf_dir, "benchmark"), text="t")
    bad = judged.where("contaminated").select(F.col("i").alias("bad"), F.xxhash64("t").alias("bad_text")).distinct()
    bad = common.stored(bad, common.scratch(spark, "contaminated"))  # keys only, of a size that Spark then knows
    rows = docs.select(F.struct("*").alias("d"), F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"))
    fair = rows.join(bad, F.col("i").eqNullSafe(F.col("bad")) & (F.xxhash64("t") == F.col("bad_text")), "left_anti")
    return _with_text(docs, linededup.passages(fair, doc_id="i", text="t").where("not emptied"), F.col("removed_words") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their bins.  Every row is packed, repeated ones each; ties go by doc_id, piece, source, cluster."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    path = common.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), f"{path}/{k}")
    return docs
