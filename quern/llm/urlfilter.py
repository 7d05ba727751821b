"""Url verdicts by rules and by propagation over the graph of hosts.

A rule names a host and a path prefix; it fits the host and its subdomains, and the longest rule that fits
decides.  Other urls are judged by their host: a host is a trusted (blocked) seed if allow (block) rules
decide at least half of its pages.  Trust runs from trusted seeds along links, personalised PageRank;
distrust runs from blocked seeds against them, so that hosts are answerable for what they link to.
A host is blocked if its distrust is at least THRESHOLD of a seed's mass and exceeds its trust.

All of it is DataFrame code.  Links are counted per pair of hosts before the shuffle; each round is one
join and one aggregation, both directions at once, and is written to the shared folder every few rounds.  The walks go
on until no host's mass grows by TOLERANCE; what reaches a host without links ends there, it does not return to the seeds.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule, and is allowed;
a null or empty page has no links; links within a host, without a host, or relative, don't count; ties of
rules of one length go to the alphabetically first; repeated rows are judged each; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .warc import host_path

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
#: Rounds that the query's SQL writes out; the walks themselves go on until no host's mass grows by TOLERANCE in KEEP_EVERY rounds.
ROUNDS = 10
TOLERANCE, LIMIT = 1e-6, 200
THRESHOLD = 0.05
KEEP_EVERY = 5
HREF = r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s<>]*)"


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.  The rules are few and become one expression."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    own, _ = host_path(F.col(url))
    found = pages.select(own.alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("to"))
    target, _ = host_path(F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("x:"), F.col("to"))).otherwise(F.col("to")))
    return found.withColumn("dst", target).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, limit: int = LIMIT) -> DataFrame:
    """(host, trust, distrust).  seeds: (host, trusted, blocked), masses of the two kinds.  An error if the walks don't settle in `limit` rounds."""
    spark = links.sparkSession
    path = common.scratch(spark, "hosts")
    links = common.stored(links, f"{path}/links")  # three aggregates read them
    out = links.groupBy(F.col("src").alias("h")).agg(F.sum("n").alias("w"))
    out = common.stored(out, f"{path}/out")  # aggregates are stored before they are joined back, so a hub host is split
    into = links.groupBy(F.col("dst").alias("h")).agg(F.sum("n").alias("w"))
    into = common.stored(into, f"{path}/into")
    ahead = links.join(out, F.col("src") == F.col("h")).select(F.lit(0).alias("way"), "src", "dst", (F.col("n") / F.col("w")).alias("p"))
    back = links.join(into, F.col("dst") == F.col("h")).select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("w")).alias("p"))
    edges = common.stored(ahead.union(back), f"{path}/edges")
    start = common.stored(seeds.select(F.explode(F.array(F.struct(F.lit(0).alias("way"), "host", F.col("trusted").cast("double").alias("m")), F.struct(F.lit(1).alias("way"), "host", F.col("blocked").cast("double").alias("m")))).alias("s")).select("s.*").where("m > 0"), f"{path}/seeds")
    base = start.select("way", "host", (F.col("m") * (1 - damping)).alias("m"))
    now = base
    if not edges.isEmpty():
        e = edges.select(F.col("way").alias("w"), "src", "dst", "p")
        kept = base
        for k in range(1, limit + 1):
            moved = now.join(e, (now["way"] == e["w"]) & (now["host"] == e["src"])).select("way", F.col("dst").alias("host"), (F.col("m") * F.col("p") * damping).alias("m"))
            now = common.stored(moved.union(base).groupBy("way", "host").agg(F.sum("m").alias("m")), f"{path}/{k}")
            if k % KEEP_EVERY == 0 or k == limit:
                old = kept.select("way", "host", F.col("m").alias("old"))
                growth = now.join(old, ["way", "host"], "left").agg(F.max(F.abs(F.col("m") - F.coalesce("old", F.lit(0.0))))).first()[0]
                if growth is None or growth < tolerance:
                    break
                kept = now
        else:
            raise RuntimeError(f"the walks over hosts did not settle in {limit} rounds")
    mass = lambda way: F.coalesce(F.sum(F.when(F.col("way") == way, F.col("m"))), F.lit(0.0))
    return now.groupBy("host").agg(mass(0).alias("trust"), mass(1).alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = THRESHOLD, **how) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    host, path = host_path(F.col(url))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    count = lambda v: F.count_if(F.col("r.verdict") == v)
    hosts = rows.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), count("allow").alias("a"), count("block").alias("b"))
    seeds = hosts.select("host", F.when(2 * F.col("a") >= F.col("n"), 1.0).otherwise(0.0).alias("trusted"), F.when(2 * F.col("b") >= F.col("n"), 1.0).otherwise(0.0).alias("blocked"))
    rank = propagate(host_links(pages, url, html), seeds, **how)
    bad = rank.where((F.round("distrust", 9) >= threshold) & (F.round("distrust", 9) > F.round("trust", 9))).select(F.col("host").alias("bad"))
    bad = common.stored(bad, common.scratch(pages.sparkSession, "bad-hosts"))
    judged = rows.join(bad, rows["host"] == bad["bad"], "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
