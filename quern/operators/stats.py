"""Agreement, paired comparison, rates and gates with honest denominators."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate(n: Column, d: Column) -> Column:
    """Null where the denominator is 0."""
    return F.round(F.try_divide(n, d), 6)


def weighted_kappa(pairs: DataFrame, a: str, b: str, levels: int = 3) -> DataFrame:
    """Linear-weighted agreement of two raters; null ratings don't pair; no expected disagreement gives null."""
    step = levels - 1
    matrix = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cell = F.coalesce(F.collect_list(F.struct("a", "b", "n")), F.array().cast("array<struct<a:int,b:int,n:bigint>>"))  # at most levels ** 2
    one = matrix.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "n").agg(cell.alias("m"))
    of = lambda keep, x: F.aggregate(F.filter("m", keep), F.lit(0.0), lambda s, c: s + x(c))
    n = of(lambda c: F.lit(True), lambda c: c["n"].cast("double"))
    seen = of(lambda c: F.lit(True), lambda c: F.abs(c["a"] - c["b"]) / step * c["n"])
    ones = lambda c: c["n"].cast("double")
    rated = lambda side, level: of(lambda c: c[side] == level, ones)
    expected = F.lit(0.0)
    for x in range(levels):
        for y in range(levels):
            if x != y:
                expected = expected + abs(x - y) / step * rated("a", x) * rated("b", y)
    exact = of(lambda c: c["a"] == c["b"], lambda c: c["n"].cast("double"))
    out = one.select(n.alias("n"), F.try_divide(seen, n).alias("o"), F.try_divide(expected, n * n).alias("e"), exact.alias("x"))
    return out.select(F.col("n").cast("long").alias("paired"), F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(F.when(F.col("e") > 0, 1 - F.col("o") / F.col("e")), 6).alias("kappa"), rate(F.col("x"), F.col("n")).alias("exact"))


def bootstrap_interval(effects: list[float], seed: int, resamples: int = 2000) -> tuple[float, float] | None:
    """95 % interval of the mean over whole families (few numbers, already aggregated); null below two."""
    if len(effects) < 2:
        return None
    rng, places = random.Random(seed), range(len(effects))
    table = np.fromiter((rng.choice(places) for _ in range(resamples * len(effects))), np.int64).reshape(resamples, -1)
    low, high = np.percentile(np.asarray(effects)[table].mean(axis=1), [2.5, 97.5])
    return float(low), float(high)


def nth_rank(values: Column, share: float) -> Column:
    """The element of rank min(n - 1, int(share * n)) of a sorted array."""
    n = F.size(values)
    return F.element_at(F.array_sort(values), F.least(n - 1, F.floor(n * share).cast("int")) + 1)


def gate(value: Column, least: Column) -> Column:
    """PASS or FAIL; an unknown value fails."""
    return F.when(value >= least, "PASS").otherwise("FAIL")


def tri_state(bad: Column) -> Column:
    """Over a group: true if any is true, null if any is unknown, else false."""
    return F.when(F.bool_or(bad), True).when(F.count_if(bad.isNull()) > 0, None).otherwise(False)
