"""Whitening of embeddings by principal components from LOBPCG.

Vectors become integers, floor(scale * c) + shift, and each distinct one is fitted once.  Sums are exact
integers.  The covariance is never formed: a pass over the fit table multiplies the centred rows with a
block of directions and back, row block by row block in tasks, and treeReduce adds the products.  LOBPCG
keeps a block of iterates, their residuals and their previous directions; Rayleigh-Ritz on the three gives
the next iterates.  It ends when the residuals of the wanted components, taken from a fresh product, are
certified at RESIDUAL of the largest eigenvalue; otherwise it is an error.  GUARD more iterates than are
wanted keep the last wanted ones from waiting for close neighbours.  The driver holds blocks of
dimension by 3 * (wanted + GUARD) and small matrices; rows stay in tasks.

Whitened values are (x - mean) on a component over the root of its eigenvalue.  Their covariance over the
fit table is measured in a further pass, and its distance from the identity reported.

Defined cases: vectors that are null or hold a null or non-finite entry take no part; an entry that
others have and a vector lacks counts as 0; null ids take part; repeated rows give the same values each,
and count once in the fit; equal eigenvalues have any basis of their space; components whose eigenvalue
is below RANK of the largest have no whitened values and are left out, so equal vectors alone, or
one vector, give no rows; an empty table gives an empty result; integers beyond 64 bits are an error;
extra columns, also those named like the results, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, GUARD = 16, 8
RESIDUAL = 1e-12
RANK = 1e-13
MOST_PASSES = 500
SEED = 31


def whole(vector: Column, d: int, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """Integers of a vector of real entries, filled up to d."""
    fixed = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift)
    return F.concat(fixed, F.array_repeat(F.lit(shift).cast("long"), F.greatest(F.lit(d) - F.size(vector), F.lit(0))))


def matrix(vectors: pa.ListArray, d: int) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(-1, d)


def exact_product(a: np.ndarray, b: int | np.ndarray, most: int) -> np.ndarray:
    """a * b in 64 bits, or in Python's integers where these wouldn't hold it."""
    return a * b if most < 1 << 62 else a.astype(object) * b


@dataclass
class Centre:
    """How many distinct integer vectors of length d there are, and their sums."""

    d: int
    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0)) * 2
        s = np.array(self.sums, dtype=np.int64 if most < 1 << 62 else object)
        return exact_product(x, self.n, most) - s

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x).astype(np.float64) / self.n


@dataclass
class Fit:
    """The distinct integer vectors (column x) and their centre."""

    table: DataFrame
    centre: Centre

    def mean_of(self, of, shape: tuple) -> np.ndarray:
        """The mean over the vectors of what `of` sums over a block of centred rows: one pass."""
        centre = self.centre
        return _tree_sum(self.table, centre.d, lambda x: of(centre.rows(x)), shape) / centre.n

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block."""
        return self.mean_of(lambda c: c.T @ (c @ block), block.shape)


def _tree_sum(table: DataFrame, d: int, of, shape: tuple) -> np.ndarray:
    """The sum of an array over blocks of rows: partial sums in tasks, added in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += of(matrix(batch["x"], d))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = table.mapInArrow(run, "part binary").rdd.map(lambda r: np.frombuffer(r["part"]))
    return parts.treeAggregate(np.zeros(int(np.prod(shape))), lambda a, b: a + b, lambda a, b: a + b).reshape(shape)


def fit_table(vectors: DataFrame, d: int, path: str) -> Fit:
    """Distinct vectors of column x, with exact sums."""
    table = common.stored(vectors.select("x").distinct(), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = matrix(batch["x"], d)
            most = int(np.abs(x).max(initial=0)) * max(len(x), 1)
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, (x if most < 1 << 62 else x.astype(object)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(v) for v in sums]], pa.list_(pa.string()))], names=["n", "sums"])

    parts = table.mapInArrow(run, "n long, sums array<string>").rdd.map(lambda r: (r["n"], [int(v) for v in r["sums"]]))
    n, sums = parts.treeReduce(lambda a, b: (a[0] + b[0], [p + q for p, q in zip(a[1], b[1])]))
    return Fit(table, Centre(d, n, sums))


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of a block's part outside of another's span; directions that are lost to rounding go."""
    for _ in range(2):
        if against is not None:
            block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.shape[1]:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10 * s[0]]
    return block


def lobpcg(product, d: int, wanted: int, guard: int = GUARD, residual: float = RESIDUAL, most_passes: int = MOST_PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, falling; eigenvectors as columns; passes) of the symmetric non-negative map `product`."""
    wanted = min(wanted, d)
    m = min(d, wanted + guard)
    x = _orthonormal(np.random.default_rng(seed).standard_normal((d, m)))
    ax, last, fresh = product(x), np.zeros((d, 0)), True
    for passes in range(2, most_passes + 2):
        h = x.T @ ax
        e, c = np.linalg.eigh((h + h.T) / 2)
        e, c = e[::-1], c[:, ::-1]
        x, ax = x @ c, ax @ c
        r = ax - x * e
        if np.linalg.norm(r[:, :wanted], axis=0).max(initial=0.0) <= residual * max(e[0], 0.0):
            if fresh:
                return e[:wanted], x[:, :wanted], passes - 1
            x = _orthonormal(x)  # certify from the map itself, not from what was carried along
            ax, fresh, last = product(x), True, np.zeros((d, 0))
            continue
        q = _orthonormal(np.hstack([r, last]), x)
        if not q.shape[1]:
            x = _orthonormal(x)
            ax, fresh = product(x), True
            continue
        aq = product(q)
        s, sa = np.hstack([x, q]), np.hstack([ax, aq])
        h = s.T @ sa
        _, c = np.linalg.eigh((h + h.T) / 2)
        c = c[:, ::-1][:, :m]
        last = q @ c[x.shape[1] :]
        x, ax, fresh = s @ c, sa @ c, False
    raise RuntimeError(f"LOBPCG: residuals not certified at {residual} within {most_passes} passes")


@dataclass
class Whitener:
    """A centre with its components (columns of unit length), eigenvalues, and measures."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    passes: int
    identity_error: float = 0.0

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """Centred rows on the components, at unit variance."""
        return rows @ (self.vectors / np.sqrt(self.values))


def fitted(fit: Fit, components: int = COMPONENTS, guard: int = GUARD) -> Whitener:
    values, vectors, passes = lobpcg(fit.product, fit.centre.d, components, guard)
    real = values > max(values[0], 0.0) * RANK
    values, vectors, k = values[real], vectors[:, real], int(real.sum())
    trace = fit.mean_of(lambda c: np.array([(c**2).sum()]), (1,))[0]
    own = Whitener(fit.centre, values, vectors, values / trace if k else values, passes)
    if k:
        cov = fit.mean_of(lambda c: (lambda w: w.T @ w)(own.whitened(c)), (k, k))
        own.identity_error = float(np.abs(cov - np.eye(k)).max())
    return own


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row for each vector and component."""
    spark = vectors.sparkSession
    path = common.scratch(spark, "whitening")
    real = F.col(embedding).isNotNull() & ~F.exists(F.col(embedding), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(real).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    d = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    if not d:
        return spark.createDataFrame([], _OUT)
    x = rows.select("vec_id", whole(F.col("v"), d, scale, shift).alias("x"))
    model = fitted(fit_table(x, d, f"{path}/fit"), components)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], _OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = model.centre
        for batch in batches:
            own = matrix(batch["x"], d)
            apart = centre.centred(own)
            apart = exact_product(apart, apart, max(int(np.abs(apart).max(initial=0)) ** 2 * d, 1)).sum(axis=1)
            again, size = pa.array(np.repeat(np.arange(len(own)), k)), len(own) * k
            columns = [batch["vec_id"].take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(size, centre.n, np.int64))]
            columns += [pa.array([int(v) for v in apart], pa.int64()).take(again), pa.array(model.whitened(centre.rows(own)).ravel())]
            columns += [pa.array(np.tile(model.explained, len(own))), pa.array(np.full(size, model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, _OUT)
