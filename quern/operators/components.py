"""Connected components of links, by alternating large-star and small-star rounds.

Each round moves every link towards the smallest node it can see.  Group minima are aggregated before
the shuffle and stored, so the join back has plain shuffles on both sides, of which Spark splits a node
with very many links.  Rounds are written to the shared folder, in as many parts as their links need; the
driver sees only two sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scratch import scratch, stored


#: Links of a part of a round's tables.
PART = 50_000


def _print(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _stars(links: DataFrame, large: bool, path: str, parts: int) -> DataFrame:
    """links (u, v), a stored table with u > v, to the same components' links with smaller v; the table of minima goes to path."""
    near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    least = stored(least.coalesce(parts), path)
    out = near.join(least, near["u"] == least["c"])
    if large:
        moved = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node that a link names, label the smallest node of its component.

    Null ends and links of a node to itself are ignored; repeated links count once; without links
    the result is empty.  Ids are integers.
    """
    spark = links.sparkSession
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    path = scratch(spark, "stars")
    now = stored(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u.isNotNull() & v.isNotNull() & (u != v)).distinct(), f"{path}/0")
    seen = _print(now)
    for k in range(1, most_rounds + 1 if seen[0] else 1):
        parts = 1 + 2 * seen[0] // PART
        wide = stored(_stars(now, True, f"{path}/{k}-large", parts).coalesce(parts), f"{path}/{k}-between")
        now = stored(_stars(wide, False, f"{path}/{k}-small", parts).coalesce(parts), f"{path}/{k}")
        was, seen = seen, _print(now)
        if was == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
