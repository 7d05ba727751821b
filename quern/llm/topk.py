"""Exact top-k inner products by the threshold algorithm.

Queries and candidates are dealt over a grid of cells, so that every query meets every candidate once:
a cell holds a bounded part of the candidates and streams its part of the queries past them.  A cell
keeps one list per dimension, sorted by value.  Rounds read the lists deeper, from the end that a query's
sign favours, score what turns up, and stop for a query when the bound that the lists' last values give
is below its k-th best score.  No candidate that could tie is left unseen.  The cells' k best are merged
at the end, with Spark's own pre-shuffle top-k.

The grid has `rows` by `columns` cells: more columns send candidates more often, more rows the queries;
they are chosen so that both together move least for the session's parallelism.

Scores are integers: components become floor(256 * x).  Products are exact, in doubles while these hold
them and in Python integers else; a score beyond 64 bits is an error.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a missing
component counts as 0; null ids take no part; a query never finds its own id; repeated rows of a query
count once (the least vector), repeated candidates each; ties go to the smaller id; fewer than k
candidates give fewer rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 1 << 15
CHUNK = 1024
STEP = 32
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(values: pa.ListArray) -> np.ndarray:
    """floor(256 * x) of each component, padded with zeros, as float64; integers beyond 2**53 stay exact there."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(values.offsets.to_numpy())
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    out[np.arange(out.shape[1]) < n[:, None]] = np.floor(256.0 * flat)
    return out


def _wide(v: np.ndarray, d: int) -> np.ndarray:
    return v if v.shape[1] == d else np.pad(v, ((0, 0), (0, d - v.shape[1])))


class Lists:
    """The candidates of a cell, by id, with their sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], vectors[order]
        self.order = np.argsort(self.v, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.v.T, self.order, axis=1)
        self.most = float(np.abs(self.v).max()) if self.v.size else 0.0

    def best(self, queries: np.ndarray, names: np.ndarray, k: int, step: int = STEP) -> list[list[tuple]]:
        """(score, id) of each query's k best here, best first.  `self.reads` counts scored candidates."""
        n, d = self.v.shape
        if queries.shape[1] != d:
            d = max(d, queries.shape[1])
            if self.v.shape[1] != d:
                return Lists(self.ids, _wide(self.v, d)).best(queries, names, k, step)
            queries = _wide(queries, d)
        exact = self.most * (float(np.abs(queries).max()) if queries.size else 0) * d < 2.0**53
        kind = np.float64 if exact else object
        q, v = (queries, self.v) if exact else (np.vectorize(int, otypes=[object])(queries), np.vectorize(int, otypes=[object])(self.v))
        least = np.array([-np.inf] * len(q), dtype=kind)
        top: list[list[tuple]] = [[] for _ in range(len(q))]
        active, scored, lo, self.reads = np.arange(len(q)), np.zeros(n, bool), 0, 0
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        while len(active) and lo < n:
            hi = min(n, lo + step)
            step *= 2
            up, down = (plus[active] > 0).any(axis=0), (minus[active] < 0).any(axis=0)
            touched = np.concatenate((self.order[up, n - hi : n - lo].ravel(), self.order[down, lo:hi].ravel()))
            if hi == n:
                touched = np.arange(n)
            new = np.zeros(n, bool)
            new[touched] = True
            new &= ~scored
            scored |= new
            new = np.flatnonzero(new)
            self.reads += len(new) * len(active)
            s = q[active] @ v[new].T
            same = names[active][:, None] == self.ids[new][None, :]
            s[same] = -np.inf
            for r in np.flatnonzero((s.max(axis=1) >= least[active]) if len(new) else []):
                own, a = s[r], active[r]
                at = np.flatnonzero((own >= least[a]) & (own > -np.inf))
                if len(at) > 4 * k and exact:
                    at = at[own[at] >= np.partition(own[at], -k)[-k]]
                top[a] = sorted(top[a] + [(-int(own[x]), int(self.ids[new[x]])) for x in at])[:k]
                if len(top[a]) == k:
                    least[a] = -top[a][-1][0]
            # a double sum of integers within 2**53 is exact; beyond, it is rounded up
            bound = plus[active] @ self.sorted[:, n - hi] + minus[active] @ self.sorted[:, hi - 1]
            if not exact:
                bound = np.nextafter(bound + np.abs(bound) * 1e-9, np.inf)
            active = active[~(bound < least[active])]
            lo = hi
        return [[(-s, i) for s, i in t] for t in top]


def _run(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, lists, asked = None, [], None, []

        def answer() -> pa.RecordBatch:
            nonlocal asked
            out: list[tuple] = []
            if asked and lists is not None:
                d = max(v.shape[1] for _, v in asked)
                names, q = np.concatenate([i for i, _ in asked]), np.concatenate([_wide(v, d) for _, v in asked])
                for name, found in zip(names.tolist(), lists.best(q, names, k)):
                    out += [(name, i, s) for s, i in found]
            asked = []
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], schema=_OUT)

        for batch in batches:
            own = batch["i"].to_numpy().astype(np.int64) << 32 | batch["j"].to_numpy()
            kind = batch["asks"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(own)]):
                if a == b:
                    continue
                if own[a] != cell:
                    yield answer()
                    cell, parts, lists = own[a], [], None
                piece = batch.slice(a, b - a)
                values = (piece["id"].to_numpy(), integers(piece["vector"]))
                if not kind[a]:
                    parts.append(values)
                    continue
                if lists is None and parts:
                    d = max(v.shape[1] for _, v in parts)
                    lists, parts = Lists(np.concatenate([i for i, _ in parts]), np.concatenate([_wide(v, d) for _, v in parts])), []
                for x in range(0, b - a, CHUNK):
                    asked.append((values[0][x : x + CHUNK], values[1][x : x + CHUNK]))
                    if sum(len(i) for i, _ in asked) >= CHUNK:
                        yield answer()
        yield answer()

    return run


def search(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of those for which the condition `queries` holds."""
    spark = vectors.sparkSession
    real = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & ~F.exists(F.col(embedding), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(real).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector"), queries.alias("asks"))
    wanted = max(2 * spark.sparkContext.defaultParallelism, 1)
    columns = max(1, int((wanted / 50) ** 0.5))
    across = max(-(-wanted // columns), -(-vectors.count() // cell))
    h = F.xxhash64("id", "vector")
    every = rows.select(F.pmod(h, F.lit(across)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"), F.lit(False).alias("asks"), "id", "vector")
    asked = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("i"), F.pmod(h, F.lit(columns)).cast("int").alias("j"), F.lit(True).alias("asks"), "id", "vector")
    cells = every.union(asked).repartition(across * columns, "i", "j").sortWithinPartitions("i", "j", "asks")
    found = cells.mapInArrow(_run(k), "query_id long, vec_id long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
