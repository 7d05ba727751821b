"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is logistic in its words and their first HEADS
bytes (for inflected forms); a document is toxic if
any sentence is, so sentence scores meet in a noisy-or with a leak, 1 - (1 - leak) * prod(1 - p), and
only document labels train the weights.  The same scores then point at the offending sentences.

Labels are learnt from a bounded sample of labelled documents: those that may train are taken in the order of a hash
of their id, whole, until max_train documents or max_train_bytes of text are reached (both parameters; texts of any length
take part alike; a text over the whole bound can't; rows equal in id and text teach once).  Scoring reads every document whole, in one map without a shuffle.  The model is a table of 2**BITS weights, of fixed size.

Defined cases: a null or empty text scores the leak; a null id may train, but no label names it; labels that are null, or of no document, teach
nothing; a document with several labels is toxic if one says so; without a positive or a negative label
the scores are 0; repeated rows score alike; an empty table gives an empty result; extra columns stay,
those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K

BITS = 20
MAX_TRAIN = 6000
MAX_TRAIN_BYTES = 24 << 20
THRESHOLD = 0.7
LOCATE = 0.5
MIN_DOCS = 4
FLOOR = -9.0
HEADS = (4, 5, 6, 7)
_SALT = K.seeds(len(HEADS), 91)[:, None]
_ENDS = np.zeros(256, bool)
_ENDS[[10, 13, 33, 46, 63]] = True


def may_train(doc_id: Column) -> Column:
    """The fold that may teach: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(True))


def bags(texts: pa.Array) -> Iterator[tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of each slice with their features (a row for the words, and for each head), sentence numbers
    (rising over the slice) and sentences' documents."""
    for w in K.words(texts, K.NOT_ALNUM):
        ends = np.flatnonzero(_ENDS[w.data])
        doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.ptr))
        part = np.searchsorted(ends, w.start)
        new = np.ones(len(w.start), bool)
        new[1:] = (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])
        kinds = np.concatenate((w.hashes[None, :], w.heads(HEADS) * _SALT))
        yield w, (kinds >> np.uint64(64 - BITS)).astype(np.int32), np.cumsum(new) - 1, doc[new]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    leak: float

    def sentences(self, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """-log(1 - p) of each sentence."""
        z = np.bincount(sentence, self.weights[feature].sum(axis=0), n) + self.bias
        return np.logaddexp(0, z)

    def evidence(self, texts: pa.Array) -> Iterator[tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]]:
        for w, feature, sentence, doc in bags(texts):
            yield w, self.sentences(feature, sentence, len(doc)), sentence, doc

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for w, a, _, doc in self.evidence(texts):
            out[w.lo : w.hi] = np.bincount(doc, a, w.hi - w.lo)
        return 1 - np.exp(-(out + self.leak))

    def offending(self, texts: pa.Array, at_least: float) -> list[list[dict]]:
        """Byte spans of the sentences' words with their scores."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        for w, a, sentence, doc in self.evidence(texts):
            p = 1 - np.exp(-a)
            first = np.searchsorted(sentence, np.arange(len(doc)))
            last = np.searchsorted(sentence, np.arange(len(doc)), "right") - 1
            for k in np.flatnonzero(p >= at_least):
                base = w.offsets[doc[k]]
                out[w.lo + doc[k]].append({"start": int(w.start[first[k]] - base), "end": int(w.end[last[k]] - base), "score": float(p[k])})
        return out


def loss_and_gradient(theta: np.ndarray, f: np.ndarray, s: np.ndarray, doc: np.ndarray, y: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Mean log loss of the noisy-or over documents with a quadratic penalty, and its gradient.

    theta holds the features' weights, the sentences' bias and the leak's logarithm; f and s are features and their
    sentences, doc the sentences' documents, y the documents' labels.
    """
    x = np.bincount(s, theta[:-2][f], len(doc)) + theta[-2]
    leak = np.exp(theta[-1])
    a = np.clip(np.bincount(doc, np.logaddexp(0, x), len(y)) + leak, 1e-9, 500)  # -log of the share that is clean
    penalty = 5 * l2 / len(y)
    loss = np.where(y == 1, -np.log(-np.expm1(-a)), a).mean() + penalty * (theta[:-2] ** 2).sum()
    da = np.where(y == 1, -1 / np.expm1(a), 1.0) / len(y)
    dx = da[doc] / (1 + np.exp(-np.clip(x, -500, 500)))
    return loss, np.concatenate((np.bincount(f, dx[s], len(theta) - 2) + 2 * penalty * theta[:-2], [dx.sum(), da.sum() * leak]))


def fit(texts: pa.Array, labels: np.ndarray, rounds: int = 150, rate: float = 0.25, l2: float = 2e-3) -> Model:
    """Noisy-or over sentences, fitted by Adam on the words that documents of the two labels use unlike."""
    none = Model(np.zeros(1 << BITS), -50.0, 0.0)
    y = labels.astype(float)
    if not len(y) or y.min() == y.max():
        return none
    seen, pos = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for w, f, s, d in bags(texts):
        pair = np.unique((d + w.lo)[s] * (1 << BITS) + f)  # a document lies in one slice
        used, own = pair % (1 << BITS), y[pair >> BITS]
        seen += np.bincount(used, minlength=1 << BITS)
        pos += np.bincount(used, own, 1 << BITS)
    rate1, rate0 = (pos + 0.5) / (y.sum() + 1), (seen - pos + 0.5) / (len(y) - y.sum() + 1)
    z = np.log(rate1 / rate0) / np.sqrt(1 / (pos + 0.5) + 1 / (seen - pos + 0.5))
    chosen = np.flatnonzero((seen >= MIN_DOCS) & (np.abs(z) >= 2.5))
    index = np.full(1 << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    parts, sentence, doc, sents = [], [], [], 0
    for w, f, s, d in bags(texts):  # once more, keeping the chosen features only
        kept = index[f]
        row, word = np.nonzero(kept >= 0)
        parts.append(kept[row, word])
        sentence.append((s[word] + sents).astype(np.int32))
        doc.append((d + w.lo).astype(np.int32))
        sents += len(d)
    f, s, doc = np.concatenate(parts), np.concatenate(sentence), np.concatenate(doc)
    theta = np.zeros(len(chosen) + 2)
    theta[-2], theta[-1] = FLOOR, -4.0  # bias; log of the leak
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        _, g = loss_and_gradient(theta, f, s, doc, y, l2)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9) * (1 - k / (rounds + 1))
        theta[-2] = min(theta[-2], FLOOR)
        theta[-1] = min(theta[-1], -2.0)
    weights = np.zeros(1 << BITS)
    weights[chosen] = theta[:-2]
    return Model(weights, float(theta[-2]), float(np.exp(theta[-1])))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", trains=may_train, max_train: int = MAX_TRAIN, max_train_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """The model of a bounded sample of labelled documents: the first by hash of id, of text and length, within both bounds."""
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(trains(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    drawn = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(max_train))
    own = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("t")).where("t is not null").join(drawn, "id")
    order = [F.xxhash64("id"), F.col("id"), F.col("th")]
    sized = own.groupBy("id", F.xxhash64("t").alias("th")).agg(F.max(F.octet_length("t")).cast("long").alias("size")).where(F.col("size") <= max_train_bytes)
    # at most max_train rows of numbers; what they add up to is known before any text moves
    first = sized.orderBy(*order).limit(max_train).withColumn("sum", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    taken = F.broadcast(first.where(F.col("sum") <= max_train_bytes).select("id", "th"))
    rows = own.withColumn("th", F.xxhash64("t")).join(taken, ["id", "th"]).groupBy("id", "th").agg(F.first("y").alias("y"), F.first("t").alias("t"))
    rows = rows.orderBy(*order).select("y", "t").toArrow()
    if not len(rows):
        return fit(pa.array([], pa.string()), np.zeros(0))
    return fit(rows["t"].combine_chunks() if rows["t"].num_chunks != 1 else rows["t"].chunk(0), rows["y"].to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    spark = docs.sparkSession
    own = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(own.value.score(texts))

    return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def locate(docs: DataFrame, model: Model, text: str = "text", at_least: float = LOCATE) -> DataFrame:
    """docs with sentences: spans in the UTF-8 text (of their words, end exclusive) and scores, where these reach at_least."""
    own = docs.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<start: int, end: int, score: double>>"

    @F.arrow_udf(kind)
    def located(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(own.value.offending(texts, at_least), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))

    return docs.withColumn("sentences", located(F.col(text)))
