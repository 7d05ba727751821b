"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds `capacity` words.  It never holds two pieces of one source, nor two of one cluster of
duplicates.  Documents longer than a bin are cut into full bins and a rest; no word is lost.  Pieces go
in falling order of size into the tightest bin that has room and no conflict: the search starts at the
least residual that suffices and goes on to its successors until a compatible bin is found.

Bins are ordered by residual in a segment tree whose nodes carry the intersection (AND) of their bins'
source and cluster bitmaps.  A subtree whose intersection holds one of the piece's bits has no compatible
bin and is skipped, so a source with a third of all rows doesn't make the search linear.

Documents are dealt by hash into shards of about SHARD rows, so the number of shards follows the input;
a shard is packed in one task, which reads ids, sizes and hashes only, never texts.  Bins never cross shards, so
each shard may leave its last bins part empty: with some 1,000 words a row, a few in about 4,000 bins.

Defined cases: a null or empty text is one piece of no words; a null source conflicts with none; the
cluster is, unless a column is named, the text up to ASCII case and white space (packed_apart() takes the
group of near-duplicates); pieces that tie are
taken in the order of doc_id (nulls last), piece, source, cluster; repeated rows are packed each; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, minhash
from . import textkernel as K
from .mixing import n_words

CAPACITY = 2048
SHARD = 8192
SHARDS_A_TASK = 16
WORD = r"[^\x20\x09-\x0D]"
RESULT = "doc_id long, piece int, start_word long, n_words long, bin_id long, bin_offset long"


class Bins:
    """Open bins by residual; find() gives the tightest without the bits asked for."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.leaves)  # -1: no bin below
        self.at: dict[int, list[int]] = {}
        self.mask: list[int] = []
        self.left: list[int] = []

    def _set(self, leaf: int, value: int) -> None:
        k = leaf + self.leaves
        self.common[k] = value
        k >>= 1
        while k:
            self.common[k] = self.common[2 * k] & self.common[2 * k + 1]
            k >>= 1

    def _next(self, leaf: int, bits: int) -> int:
        """The first leaf from this one on whose bins' common bits leave these free; -1 if none."""
        k = leaf + self.leaves
        while True:
            if self.common[k] != -1 and not self.common[k] & bits:
                if k >= self.leaves:
                    return k - self.leaves
                k *= 2
                continue
            while k & 1:  # past this subtree
                k >>= 1
                if k <= 1:
                    return -1
            k += 1

    def find(self, size: int, bits: int) -> int | None:
        leaf = size
        while leaf < self.leaves and (leaf := self._next(leaf, bits)) >= 0:
            for b in self.at[leaf]:
                if not self.mask[b] & bits:
                    return b
            leaf += 1
        return None

    def open(self, capacity: int) -> int:
        self.mask.append(0)
        self.left.append(capacity)
        return len(self.mask) - 1

    def put(self, b: int, size: int, bits: int) -> None:
        old = self.left[b]
        if old in self.at and b in self.at[old]:
            self.at[old].remove(b)
            value = -1
            for x in self.at[old]:
                value &= self.mask[x]
            self._set(old, value)
        self.mask[b] |= bits
        self.left[b] -= size
        new = self.left[b]
        here = self.at.setdefault(new, [])
        insort(here, b)
        self._set(new, self.mask[b] & (self.common[new + self.leaves] if len(here) > 1 else -1))


def pack(items: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """(doc_id, source, cluster, words) of a shard to (doc_id, piece, start, words, bin, offset)."""
    pieces = []
    for doc, source, cluster, n in items:
        for k in range(max(1, -(-n // capacity))):
            pieces.append((min(capacity, n - k * capacity), doc, k, source, cluster))
    pieces.sort(key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2], p[3] is None, p[3] or "", p[4] or 0))
    bit: dict[tuple, int] = {}
    for kind, at in (("s", 3), ("c", 4)):
        for value, n in sorted(Counter(p[at] for p in pieces if p[at] is not None).items()):
            if n > 1:
                bit[kind, value] = 1 << len(bit)
    bins, out = Bins(capacity), []
    for size, doc, k, source, cluster in pieces:
        bits = bit.get(("s", source), 0) | bit.get(("c", cluster), 0)
        b = bins.find(size, bits)
        if b is None:
            b = bins.open(capacity)
        out.append((doc, k, k * capacity, size, b, capacity - bins.left[b]))
        bins.put(b, size, bits)
    return out


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("cluster", T.LongType())]))
def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Words of a text, and a hash that is equal for texts that differ in A-Z case and white space only (null without words)."""
    for texts in batches:
        n, cluster = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for w in K.words(texts):
            n[w.lo : w.hi] = np.diff(w.ptr)
            for r in np.flatnonzero(np.diff(w.ptr)):
                cluster[w.lo + r] = K.whole(w.hashes[w.ptr[r] : w.ptr[r + 1]]).view(np.int64)[0]
        yield pa.StructArray.from_arrays([pa.array(n), pa.array(cluster, mask=n == 0)], ["n", "cluster"])


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, shard: int = SHARD, size: Column | None = None) -> DataFrame:
    """A row for each piece: its document, words, bin and place in the bin.  size: words that were counted before (with a cluster)."""
    spark = docs.sparkSession
    shards = max(1, -(-docs.count() // shard))
    tasks = min(shards, max(2 * spark.sparkContext.defaultParallelism, shards // SHARDS_A_TASK))
    own = F.lit(None).cast("long") if cluster is None else cluster.cast("long")
    keys = [F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source")]
    if size is not None and cluster is not None:
        light = docs.select(*keys, own.alias("cluster"), size.cast("long").alias("n"))
    else:
        light = docs.select(*keys, own.alias("own"), measured(F.col(text)).alias("m")).select("doc_id", "source", F.col("m.cluster" if cluster is None else "own").alias("cluster"), F.col("m.n").alias("n"))
    light = light.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "n"), F.lit(shards))).repartition(tasks, "shard")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cols = [rows[c].to_pylist() for c in ("doc_id", "source", "cluster", "n")]
        found = list(zip(*pack(list(zip(*cols)), capacity))) or [[]] * 6
        base = key[0].as_py() << 32
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        found[4] = [base + b for b in found[4]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(found, kinds)], names=["doc_id", "piece", "start_word", "n_words", "bin_id", "bin_offset"])

    return light.groupBy("shard").applyInArrow(run, RESULT)


def packed_apart(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", words: int = 5, percent: int = 80, **how) -> DataFrame:
    """packed() with the groups of near-duplicates as clusters.  Rows with a null id take the text's hash as id for the grouping."""
    name = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), name.alias("name"))
    found = minhash.groups(own, doc_id="name", words=words, percent=percent).where("n_shingles > 0").select("row.id", "row.fp", "component_id").distinct()
    # words are counted where the texts are read; ids and prints meet the groups, texts don't travel
    row = common.row_key(F.col("name"), F.col("text"))
    rows = own.select("doc_id", "source", row["id"].alias("id"), row["fp"].alias("fp"), n_words(F.col("text")).alias("n")).join(found, ["id", "fp"], "left")
    rows = common.stored(rows.select("doc_id", "source", "component_id", "n"), common.scratch(docs.sparkSession, "packing"))
    return packed(rows, cluster=F.col("component_id"), size=F.col("n"), **how)
