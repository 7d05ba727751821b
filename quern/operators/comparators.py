"""Comparators for lineage: TF-IDF cosines, a learned pair model, edit blends, thresholds, and variants to test with.

Defined cases: null scores or labels count in neither class; equal scores share a threshold; a corpus of one record has no other to
compare with; rows that repeat count each; empty tables give no pairs, and a threshold above all scores; extra columns are ignored.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.scratch import scratch, stored

PAIR_FEATURES = ("record_similarity", "max_field", "near_fields", "max_span", "span_norm", "anchor_norm", "has_reason")
VARIANTS = ("presentation_only", "prompt_paraphrase", "single_evidence_field", "evidence_graph_composition", "prompt_span_reuse", "distributed_fragment_reuse")


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, half, term, tf): word 1- and 2-grams, and 3- to 5-grams within blank-padded words."""
    w = df.select(key, X.words_a(F.col(text)).alias("w")).select(key, F.filter("w", lambda x: F.length(x) >= 2).alias("w"), F.col("w").alias("all"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    words = w.select(key, F.lit("word").alias("half"), F.explode(F.when(F.size("w") >= 2, F.concat("w", pairs)).otherwise(F.col("w"))).alias("term"))
    padded = w.select(key, F.explode("all").alias("x")).select(key, F.concat(F.lit(" "), "x", F.lit(" ")).alias("x"))
    grams = [F.when(F.length("x") >= n, _grams(F.col("x"), n)).otherwise(F.array().cast("array<string>")) for n in (3, 4, 5)]
    chars = padded.select(key, F.lit("char").alias("half"), F.explode(F.concat(*grams)).alias("term"))
    return words.union(chars).groupBy(key, "half", "term").agg(F.count(F.lit(1)).alias("tf"))


def _grams(c: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))


def tfidf_scores(candidates: DataFrame, references: DataFrame, allowed: DataFrame, key: str = "case_id", text: str = "text") -> DataFrame:
    """candidate, reference, score: the mean of the two halves' cosines; idf (smooth) is of references and allowed records.

    Pairs meet through shared terms and are summed, so texts never meet each other whole.
    """
    fit = _terms(references.select(key, text).union(allowed.select(key, text)), key, text)
    n = references.count() + allowed.count()
    idf = fit.groupBy("half", "term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1)

    def weighted(df: DataFrame, name: str) -> DataFrame:
        t = _terms(df, key, text).join(idf, ["half", "term"]).withColumn("v", (1 + F.ln("tf")) * F.col("idf"))
        norm = t.groupBy(key, "half").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        return t.join(norm, [key, "half"]).select(F.col(key).alias(name), "half", "term", (F.col("v") / F.col("norm")).alias(f"{name}_v"))

    j = weighted(candidates, "candidate").join(weighted(references, "reference"), ["half", "term"])
    return j.groupBy("candidate", "reference").agg((F.sum(F.col("candidate_v") * F.col("reference_v")) / 2).alias("score"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """Scored pairs of lineage.pairs() with the learned model's features."""
    cap = lambda c: F.least(F.lit(8), F.col(c)) / 8.0
    return pairs.withColumns({"span_norm": cap("spans"), "near_fields": F.size("near_fields").cast("double"), "anchor_norm": cap("n_anchors"), "has_reason": F.when(F.size("reasons") > 0, 1.0).otherwise(0.0)})


def grouped_scores(features: DataFrame, label: str, group: str, folds: int = 5) -> DataFrame:
    """Out-of-fold probabilities of a logistic pair model; a group is never in the fold that scores it."""
    known = stored(features.withColumn("__f", F.pmod(F.xxhash64(group), F.lit(folds))), scratch(features.sparkSession, "pairs"))  # each fit reads it many times
    rows = VectorAssembler(inputCols=list(PAIR_FEATURES), outputCol="__x").transform(known)
    out = None
    for k in range(folds):
        model = LogisticRegression(featuresCol="__x", labelCol=label, probabilityCol="__p", regParam=0.01).fit(rows.where(F.col("__f") != k))
        one = model.transform(rows.where(F.col("__f") == k)).withColumn("probability", vector_to_array("__p")[1]).drop("__x", "__p", "__f", "rawPrediction", "prediction")
        out = one if out is None else out.union(one)
    return out


def choose_threshold(scored: DataFrame, score: str, label: str, most_false: float) -> DataFrame:
    """threshold, recall, false_rate: most recall, then fewest false alarms, then the highest score, within the cap.

    Equal scores are counted before the cumulative sums; no threshold within the cap gives one above all scores.
    """
    g = scored.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    w, every = Window.partitionBy(F.lit(0)).orderBy(F.desc("s")), Window.partitionBy(F.lit(0))
    share = lambda c: F.sum(c).over(w) / F.greatest(F.lit(1), F.sum(c).over(every))
    r = g.select(F.round("s", 6).alias("threshold"), share("p").alias("recall"), share("n").alias("false_rate"))
    none = scored.sparkSession.createDataFrame([(1.000001, 0.0, 0.0)], r.schema)
    best = F.max(F.struct("recall", (-F.col("false_rate")).alias("f"), "threshold")).alias("b")
    return r.where(F.col("false_rate") <= most_false).union(none).agg(best).select("b.threshold", "b.recall", (-F.col("b.f")).alias("false_rate"))


def edit_blend(a: Column, b: Column) -> Column:
    """0.55 Jaccard of words plus 0.45 of the matching-blocks ratio; a comparator, row by row in Python."""

    @F.arrow_udf("double")
    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else SequenceMatcher(None, p, q, autojunk=False).ratio() for p, q in zip(x.to_pylist(), y.to_pylist())], pa.float64())

    words = lambda c: F.array_distinct(X.words_a(c))
    return 0.55 * F.coalesce(X.jaccard(words(a), words(b)), F.lit(0.0)) + 0.45 * ratio(a, b)


def variants(protected: DataFrame, prompt: str, evidence: str, filler: str) -> DataFrame:
    """Test records made from protected ones, one for each way of reuse: case_id, source_id, variant, and the two fields.

    `filler` is a column of unrelated text for the parts that aren't reused.
    """
    words = lambda c: F.split(F.col(c), " ")
    half = lambda c: F.array_join(F.slice(words(c), 1, F.greatest(F.lit(1), F.floor(F.size(words(c)) / 2).cast("int"))), " ")
    odd = lambda c: F.array_join(F.filter(words(c), lambda x, i: i % 4 < 2), " ")
    made = {
        "presentation_only": (F.concat(F.lit("Task: "), prompt), F.col(evidence)), "prompt_paraphrase": (F.array_join(F.reverse(F.split(F.col(prompt), r"(?<=[.;,]) ")), " "), F.col(evidence)), "single_evidence_field": (F.col(filler), F.col(evidence)),
        "evidence_graph_composition": (F.col(filler), F.concat_ws(". ", half(evidence), filler)), "prompt_span_reuse": (F.concat_ws(". ", filler, half(prompt)), F.col(filler)), "distributed_fragment_reuse": (F.concat_ws(" ", odd(prompt), filler), odd(evidence)),
    }
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), a.alias(prompt), b.alias(evidence)) for v, (a, b) in made.items()])
    x = protected.select(F.col("case_id").alias("source_id"), F.explode(rows).alias("x")).select("source_id", "x.*")
    return x.withColumn("case_id", F.concat_ws("-", "source_id", "variant"))
