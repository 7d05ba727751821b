"""Relational operators that the plans share: keyed picks, joins by rank, fallback and containment.

Null keys are a group of their own in pick(), top() and numbered(), and meet nothing in joins; rows that repeat count each,
where an order is asked for all of its ties must be settled by it; texts are read whole; empty tables give empty results; extra
columns stay where rows pass through, and are ignored else.  Names that begin with two underscores are the operators' own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scratch import scratch, stored


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order.  Spark limits groups before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key, numbered; k = 0 gives none."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, n).where(F.col(name) <= k)


def matrix(rows: DataFrame, columns: DataFrame, most: int = 1000) -> DataFrame:
    """Every row with every one of a short list of columns; a list of over `most` is refused."""
    if columns.limit(most + 1).count() > most:
        raise ValueError(f"a matrix of over {most} columns")
    return rows.crossJoin(F.broadcast(columns))


def sorted_sets(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the sorted distinct values of each key; repeated ones are dropped before they are gathered."""
    return df.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def numbered(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Rows numbered from 1 within each key by a column of distinct values, without one task for a key.

    Rows are sorted by ranges; a range's number of rows of a key, added up over the ranges before it, is what its own
    numbers begin after.  Only these counts, one a range and key, meet in one task.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, order).withColumn("__part", F.spark_partition_id())
    held = stored(ranged, scratch(spark, "numbered"))
    counts = held.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, "__part", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(order))
    starts = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__part") == F.col("__p"))
    return held.withColumn("__own", own).join(starts, same).drop(*[f"__k{i}" for i in range(len(keys))], "__p").withColumn(name, (F.col("__own") + F.col("__before")).cast("long")).drop("__part", "__own", "__before")


def fallback_join(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[list[str], list[str]], value: str, seq: str) -> DataFrame:
    """left with `value` of right by the first key, else by the second; the last row in `seq` of a key counts.

    matched_by tells which key it was; null means neither.
    """
    last = F.max_by(F.col(value), F.col(seq))
    by_first = right.where(F.col(first[1]).isNotNull()).groupBy(F.col(first[1]).alias("__f")).agg(last.alias("__v1"), F.lit(1).alias("__m1"))
    by_second = right.groupBy(*[F.col(c).alias(f"__s{k}") for k, c in enumerate(second[1])]).agg(last.alias("__v2"), F.lit(1).alias("__m2"))
    both = [F.col(c) == F.col(f"__s{k}") for k, c in enumerate(second[0])]
    joined = left.join(by_first, F.col(first[0]) == F.col("__f"), "left").join(by_second, both, "left")
    found = F.when(F.col("__m1") == 1, "first").when(F.col("__m2") == 1, "second")
    return joined.withColumn("matched_by", found).withColumn(value, F.when(F.col("__m1") == 1, F.col("__v1")).otherwise(F.col("__v2"))).select(*left.columns, value, "matched_by")


def first_match(ranked: DataFrame, ranking: str, found: DataFrame, key: str, value: str) -> DataFrame:
    """Of each row's ranked ids, the first that `found` has: its rank and value (null if none)."""
    ids = ranked.withColumn("__row", F.monotonically_increasing_id())
    long = ids.select("__row", F.posexplode(ranking).alias("__rank", "__id"))
    hit = long.join(found.select(F.col(key).alias("__id"), F.col(value).alias("__value")), "__id")
    best = hit.groupBy("__row").agg(F.min(F.struct("__rank", "__id", "__value")).alias("__b"))
    return ids.join(best, "__row", "left").withColumn("match_rank", F.col("__b.__rank") + 1).withColumn("match_id", F.col("__b.__id")).withColumn("match", F.col("__b.__value")).drop("__row", "__b")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], value: str, low: str, high: str, width: float) -> DataFrame:
    """Inner join of points with the closed intervals of their keys that hold them.

    Intervals are cut into buckets of `width`, so it is an equi-join on keys and bucket, not a nested loop.
    """
    p = points.withColumn("__b", F.floor(F.col(value) / width))
    i = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(i, [*keys, "__b"]).where((F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))).drop("__b")


def both_ways(edges: DataFrame, a: str, b: str, label: str | None = None, inverse: dict[str, str] | None = None) -> DataFrame:
    """Edges and their reverses, the reverse's label by the inverse map where it has one."""
    back = edges.withColumn("__t", F.col(a)).withColumn(a, F.col(b)).withColumn(b, F.col("__t")).drop("__t")
    if label and inverse:
        names = F.create_map(*[F.lit(x) for kv in inverse.items() for x in kv])
        back = back.withColumn(label, F.coalesce(F.try_element_at(names, F.col(label)), F.col(label)))
    return edges.unionByName(back).distinct()


def valid_at(at: Column, start: Column, end: Column) -> Column:
    """Inclusive; a missing bound is open, a missing moment asks nothing."""
    return at.isNull() | ((start.isNull() | (start <= at)) & (end.isNull() | (end >= at)))


def in_scope(wanted: Column, scopes: Column) -> Column:
    """No wish admits all; else the scope itself or 'all' must be named, and unknown scopes are out."""
    return wanted.isNull() | F.coalesce(F.array_contains(scopes, wanted) | F.array_contains(scopes, F.lit("all")), F.lit(False))


def rule_holds(features: Column, needs: Column, any_of: Column, none_of: Column) -> Column:
    return (F.size(F.array_except(needs, features)) == 0) & ((F.size(any_of) == 0) | F.arrays_overlap(any_of, features)) & ~F.arrays_overlap(none_of, features)


def host_in(host: Column, of: Column) -> Column:
    return (host == of) | F.endswith(host, F.concat(F.lit("."), of))


def similar_pairs(sets: DataFrame, id_col: str, tokens: str, threshold: float, num: int, den: int, held: bool = False) -> DataFrame:
    """Pairs a < b of rows whose token sets (arrays of distinct values) have Jaccard >= num / den (= threshold).

    Exact prefix-filtered join: with tokens in order of rarity, two sets that reach the threshold share one
    of their first n - ceil(t * n) + 1; sizes must be within the threshold of each other.  Tokens of one set only are the
    rarest and meet nothing: a set's number of them is known from its size, and they are not dealt out.  A pair's common prefix
    tokens, with their places, bound what it can share at all; only pairs that can reach the threshold have their sets joined.  Rows of equal sets should be collapsed first.
    held: sets is a table in the shared folder already, and isn't written once more.
    """
    spark = sets.sparkSession
    # stored before it is filtered: a filter on the sets' size would compute them anew for every element
    base = sets.select(F.col(id_col).alias("id"), F.col(tokens).alias("set"))
    base = (base if held else stored(base, scratch(spark, "sets"))).where(F.size("set") > 0)
    freq = stored(base.select(F.explode("set").alias("t")).groupBy("t").count().where("count > 1"), scratch(spark, "counts"))  # stored, so a token of very many sets is split
    ranked = base.select("id", F.size("set").alias("n"), F.explode("set").alias("t")).join(freq, "t")
    order = F.array_sort(F.collect_list(F.struct("count", "t")))
    kept = F.floor(F.col("n") - F.ceil(F.col("n") * num / den - 1e-9)).cast("int") + 1
    shared = ranked.groupBy("id", "n").agg(order.alias("o")).withColumn("lone", F.col("n") - F.size("o"))
    prefix = shared.select("id", "n", "lone", F.posexplode(F.slice("o", F.lit(1), F.greatest(kept - F.col("lone"), F.lit(0)))).alias("at", "e")).select("id", "n", (F.col("lone") + F.col("at")).alias("at"), F.col("e.t").alias("t"))
    prefix = stored(prefix, scratch(spark, "prefixes"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = F.least("a.n", "b.n") * den >= F.greatest("a.n", "b.n") * num
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.id") < F.col("b.id")) & near)
    met = met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count(F.lit(1)).alias("c"), F.max("a.at").alias("pa"), F.max("b.at").alias("pb"))
    # what is shared up to the last common prefix token, and what could be after it, must reach what the threshold asks for
    most = F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    pairs = stored(met.where(most * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b"), scratch(spark, "candidates"))
    # sets travel once, to the ids that are left; these few are joined with both ends
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), scratch(spark, "left"))
    wanted = stored(base.join(ids, "id", "left_semi"), scratch(spark, "wanted"))
    left, right = wanted.select(F.col("id").alias("a"), F.col("set").alias("sa")), wanted.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").withColumn("i", F.size(F.array_intersect("sa", "sb"))).withColumn("u", F.size("sa") + F.size("sb") - F.col("i"))
    return scored.where(F.col("i") * den >= F.col("u") * num).select("a", "b", F.round(F.col("i") / F.col("u"), 6).alias("similarity"))


#: Bits of a set's print, into how many parts it is folded for a first look, and sets of a block in similar_pairs_dense().
PRINT_BITS, FOLDS, BLOCK = 4096, 4, 8192


def prints(tokens: Column) -> Column:
    """PRINT_BITS bits of an array of long hashes: those that the hashes' low ends name."""

    @F.arrow_udf("binary")
    def run(sets: pa.Array) -> pa.Array:
        sizes = sets.value_lengths().to_numpy(zero_copy_only=False)
        bits = np.zeros((len(sets), PRINT_BITS), np.uint8)
        bits[np.repeat(np.arange(len(sets)), sizes), sets.flatten().to_numpy() & (PRINT_BITS - 1)] = 1
        return pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())

    return run(tokens)


def _reaching(num: int, den: int, stripe: int = 16):
    """Of a group of prints of two blocks (or one), the pairs whose sets may have Jaccard >= num / den."""

    def run(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(groups))
        i, j, block, n = (t[c].to_numpy() for c in ("i", "j", "block", "n"))
        ids = t["id"].combine_chunks()
        words = np.frombuffer(b"".join(t["print"].to_pylist()), np.uint64).reshape(len(n), -1)
        folded = np.bitwise_or.reduce(words.reshape(len(n), FOLDS, -1), axis=1)
        x, y = np.flatnonzero(block == i), np.flatnonzero(block == j)
        right, size = np.ascontiguousarray(folded[y].T), n[y].astype(np.int64)
        for at in range(0, len(x), stripe):
            own = x[at : at + stripe]
            apart = np.zeros((len(own), len(y)), np.uint16)
            for w, column in enumerate(right):
                apart += np.bitwise_count(folded[own, w][:, None] ^ column)
            both = n[own].astype(np.int64)[:, None] + size
            # prints that differ in d bits are of sets that differ in d tokens at least
            hit = (both - apart) * (num + den) >= 2 * both * num
            hit &= np.minimum(n[own][:, None], size) * den >= np.maximum(n[own][:, None], size) * num
            if i[0] == j[0]:
                hit &= own[:, None] < y
            a, b = np.nonzero(hit)
            apart, both = np.bitwise_count(words[own[a]] ^ words[y[b]]).sum(axis=1, dtype=np.int64), both[a, b]
            keep = (both - apart) * (num + den) >= 2 * both * num
            a, b = a[keep], b[keep]
            if len(a):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[a])), ids.take(pa.array(y[b]))], ["x", "y"])

    return run


def similar_pairs_dense(sets: DataFrame, id_col: str, tokens: str, num: int, den: int) -> DataFrame:
    """similar_pairs() of sets of long hashes out of a small vocabulary, where most pairs share some token of their prefixes.

    Equal sets are decided once.  Of the rest, sorted by size, prints of PRINT_BITS bits are compared in pairs of blocks whose sizes
    can meet: as many bits as two prints differ in, so many tokens at least the sets differ in.  Only pairs that this leaves have
    their sets joined, so what is written grows with the prints and the result; the comparisons grow with the square of the
    different sets, in tasks of bounded memory.
    """
    spark = sets.sparkSession
    base = stored(sets.select(F.col(id_col).alias("id"), F.array_sort(tokens).alias("set")), scratch(spark, "sets")).where(F.size("set") > 0)
    whole = stored(base.groupBy("set").agg(F.min("id").alias("rep")), scratch(spark, "kinds"))
    member = stored(base.join(whole.withColumnRenamed("set", "__set"), F.col("set") == F.col("__set")).select("rep", "id"), scratch(spark, "members"))
    placed = numbered(whole.select("rep", F.size("set").alias("n"), prints(F.col("set")).alias("print")).withColumn("__o", F.struct("n", "rep")), [], "__o", "__place")
    rows = stored(placed.select(F.col("rep").alias("id"), "n", "print", F.floor((F.col("__place") - 1) / BLOCK).cast("int").alias("block")), scratch(spark, "prints"))
    sizes = rows.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    meet = sizes.alias("p").crossJoin(sizes.alias("q")).where((F.col("p.block") <= F.col("q.block")) & (F.col("p.high") * den >= F.col("q.low") * num))
    meet = stored(meet.select(F.col("p.block").alias("i"), F.col("q.block").alias("j")), scratch(spark, "meetings"))
    sides = meet.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    dealt = rows.join(sides, "block").select("i", "j", "block", "id", "n", "print")
    kind = sets.schema[id_col].dataType.simpleString()
    found = dealt.groupBy("i", "j").applyInArrow(_reaching(num, den), f"x {kind}, y {kind}").repartition("x", "y")
    left, right = whole.select(F.col("rep").alias("x"), F.col("set").alias("sx")), whole.select(F.col("rep").alias("y"), F.col("set").alias("sy"))
    scored = found.join(left, "x").join(right, "y").withColumn("i", F.size(F.array_intersect("sx", "sy"))).withColumn("u", F.size("sx") + F.size("sy") - F.col("i"))
    kinds = stored(scored.where(F.col("i") * den >= F.col("u") * num).select("x", "y", F.round(F.col("i") / F.col("u"), 6).alias("similarity")), scratch(spark, "similar"))
    of = lambda rep, name: member.select(F.col("rep").alias(rep), F.col("id").alias(name))
    apart = kinds.join(of("x", "p"), "x").join(of("y", "q"), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")
    same = of("x", "a").join(of("x", "b"), "x").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return apart.union(same)
