"""Hash-chained journals: an append log per key whose every entry names its predecessor's digest, and its verification.

Writing is a chain, so a key's new entries are digested in order (in its task, from the last digest on); keys are spread.
Checking is not: each entry is joined with its predecessor by (key, number), so a key with very many entries is spread over
all tasks, and the states that entries recorded are compared with a replay of the same updates.

Digest: sha256 of the predecessor's digest (empty for the first), `|`, and the payload, in hex.  Null keys are one key; a null
payload counts as empty; an empty table gives an empty journal without faults; extra columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LINKS = "key string, number long, payload string, previous string, digest string"


def digest_of(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, F.lit("|"), F.coalesce(payload, F.lit(""))).cast("binary"), 256)


def appended(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(key, number, payload, previous, digest) of entries (key, seq, payload), after the heads (key, number, digest) of a journal.

    Entries of a key are taken in the order of seq; equal ones in the order of their payloads.
    """
    rows = entries.select(F.col("key").cast("string").alias("key"), F.col("seq"), F.coalesce("payload", F.lit("")).alias("payload"), F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("digest"))
    if heads is not None:
        ends = heads.select(F.col("key").cast("string").alias("key"), F.lit(None).cast(entries.schema["seq"].dataType).alias("seq"), F.lit(None).cast("string").alias("payload"), "number", "digest")
        rows = rows.union(ends)
    rows = rows.withColumn("late", F.col("payload").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, number, last = False, None, 0, ""
        for batch in batches:
            out = []
            for key, payload, n, head in zip(*(batch[c].to_pylist() for c in ("key", "payload", "number", "digest"))):
                if not begun or key != at:
                    begun, at, number, last = True, key, 0, ""
                if payload is None:
                    number, last = n, head
                    continue
                number, previous, last = number + 1, last, sha256(f"{last}|{payload}".encode()).hexdigest()
                out.append((key, number, payload, previous, last))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["key", "number", "payload", "previous", "digest"])

    ordered = rows.repartition("key").sortWithinPartitions("key", "late", "seq", "payload").select("key", "payload", "number", "digest")
    return ordered.mapInArrow(run, _LINKS)


def heads(journal: DataFrame) -> DataFrame:
    """(key, number, digest) of each key's last entry: what a later check of the end needs."""
    return journal.groupBy("key").agg(F.max("number").alias("number"), F.max_by("digest", "number").alias("digest"))


def faults(journal: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, number, fault): what is wrong with a journal (key, number, payload, previous, digest); known: heads() of before.

    CHANGED: the digest isn't that of payload and predecessor.  REPEATED: several entries have the number.  REORDERED: the
    named predecessor stands elsewhere in the key.  MISSING: it stands nowhere, and the entry before isn't there.  BROKEN_LINK:
    it stands nowhere, and the entry before is another one.  TRUNCATED: the key ends before the known head, or not in it.
    """
    j = journal.select(F.coalesce(F.col("key").cast("string"), F.lit("\0")).alias("key"), "number", "payload", "previous", "digest")
    before = j.groupBy("key", (F.col("number") + 1).alias("number")).agg(F.collect_set("digest").alias("there"))  # one, but for repeated numbers
    places = j.groupBy("key", F.col("digest").alias("previous")).agg(F.min("number").alias("stands"))
    same = j.groupBy("key", "number").agg(F.count(F.lit(1)).alias("n"))
    x = j.join(before, ["key", "number"], "left").join(places, ["key", "previous"], "left").join(same, ["key", "number"])
    first = (F.col("number") == 1) & (F.col("previous") == "")
    linked = first | F.coalesce(F.array_contains("there", F.col("previous")), F.lit(False))
    found = F.array_compact(F.array(
        F.when(F.col("digest") != digest_of(F.col("previous"), F.col("payload")), "CHANGED"), F.when(F.col("n") > 1, "REPEATED"),
        F.when(~linked, F.when(F.col("stands").isNotNull() | (F.col("previous") == ""), "REORDERED").when(F.col("there").isNull(), "MISSING").otherwise("BROKEN_LINK")),
    ))
    out = x.select("key", "number", F.explode(found).alias("fault"))
    if known is not None:
        k = known.select(F.coalesce(F.col("key").cast("string"), F.lit("\0")).alias("key"), F.col("number").alias("kn"), F.col("digest").alias("kd"))
        ends = k.join(j.select("key", F.col("number").alias("kn"), F.col("digest").alias("d")), ["key", "kn"], "left")
        out = out.union(ends.groupBy("key", "kn", "kd").agg(F.max(F.coalesce(F.col("d") == F.col("kd"), F.lit(False))).alias("ok")).where("not ok").select("key", F.col("kn").alias("number"), F.lit("TRUNCATED").alias("fault")))
    return out.withColumn("key", F.nullif(F.col("key"), F.lit("\0")))


def differing(recorded: DataFrame, replayed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column, recorded, replayed) where the states that a journal recorded are not those of a replay; a key on one side only differs in all."""
    a = recorded.select(F.col(key).alias("__a"), *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    b = replayed.select(F.col(key).alias("__b"), *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    j = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full")
    one = F.col("__a").isNull() != F.col("__b").isNull()
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("recorded"), F.col(f"b_{c}").alias("replayed")) for c in columns])).alias("x")
    return j.select(F.coalesce("__a", "__b").alias(key), one.alias("one"), each).where("one or not (x.recorded <=> x.replayed)").select(key, "x.*")
