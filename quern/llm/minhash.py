"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

A permutation gives two signature values, its minimum and its maximum over the document's shingles, so
BANDS * ROWS values cost half as many hash evaluations.  Documents with equal sets are one class from
the start.  Classes that share a band form a bucket:

1. every member is compared, on full sets, with the bucket's smallest member (the pivot); pivots with
   many members are salted, so the work is linear in the buckets' sizes and spread;
2. components of these links leave few buckets with members in different components.  Those are
   compared completely, in blocks of about BLOCK sets or BLOCK_BYTES, by one matrix product a block pair; only
   a spanning forest of the links leaves a task, never the pairs.  (Further pivots settle few of them: what is
   left are members of one bucket that are less similar than asked for, whichever of them is the pivot);
3. components of all links are the result.

At similarity 0.8 a link is in no common bucket with probability (1 - 0.8**4)**32 = 5e-8.

Words are runs of anything but ASCII white space, A-Z in lower case.  Defined cases: null and empty
texts have the empty set and are linked with nothing; texts shorter than a shingle are one shingle;
repeated rows (equal id and text) are decided alike; a null doc_id is never a component's id unless
all of its ids are null; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.components import components

from . import common
from . import textkernel as K

BANDS, ROWS = 32, 4
SALT_ROWS = 512
BLOCK = 1024
BLOCK_BYTES = 32 << 20
_A = (K.seeds(BANDS * ROWS // 2, 71) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]
_B = (K.seeds(BANDS * ROWS // 2, 73) >> np.uint64(16)).astype(np.uint32)[:, None]
_MULT = K.seeds(ROWS, 79)


def signature(shingles: np.ndarray, perms: int = BANDS * ROWS // 2) -> np.ndarray:
    """Minimum and maximum of each permutation: 2 * perms values; the order interleaves them."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(perms, 0xFFFFFFFF, np.uint32), np.zeros(perms, np.uint32)
    for k in range(0, len(x), 1 << 14):
        h = x[k : k + (1 << 14)] * _A[:perms] + _B[:perms]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of `rows` values, different bands never sharing one by design."""
    cut = sig[: len(sig) // rows * rows].astype(np.uint64).reshape(-1, rows)
    h = (K.mix(cut + np.uint64(1)) * _MULT[:rows]).sum(axis=1, dtype=np.uint64)
    return K.mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)


def _sketcher(words: int):
    kind = "n int, fp binary, bands array<long>"

    @F.arrow_udf(kind)
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n, fp, bands = np.zeros(len(texts), np.int32), [None] * len(texts), [None] * len(texts)
            for w in K.words(texts):
                for r in range(w.hi - w.lo):
                    s = K.shingle_set(w.hashes[w.ptr[r] : w.ptr[r + 1]], words)
                    if len(s):
                        k = w.lo + r
                        n[k], fp[k], bands[k] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), band_keys(signature(s))
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["n", "fp", "bands"])

    return sketch


def _setter(words: int):
    @F.arrow_udf("binary")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for w in K.words(texts):
                out += [K.shingle_set(w.hashes[w.ptr[r] : w.ptr[r + 1]], words).tobytes() for r in range(w.hi - w.lo)]
            yield pa.array(out, pa.binary())

    return shingles


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (n + m - inter)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pivot_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            pivot, salt, ids, sets = batch["pivot"].to_pylist(), batch["salt"].to_pylist(), batch["id"].to_pylist(), batch["shingles"]
            for k, key in enumerate(zip(pivot, salt)):
                s = np.frombuffer(sets[k].as_buffer(), np.uint64)
                if ids[k] == pivot[k]:
                    at, own = key, s.copy()
                elif at == key and linked(own, s, percent):
                    found.append((pivot[k], ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=_LINKS)

    return run


def block_links(ids: list[int], labels: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different labels."""
    if len(set(labels)) < 2:
        return []
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [lo, lo + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[a:b], column[a:b] - lo] = 1
        inter += x @ x.T
    i, j = np.nonzero(np.triu(100 * inter >= percent * (n[:, None] + n[None, :] - inter), 1))
    root = {x: x for x in labels}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for p, q in zip(i.tolist(), j.tolist()):
        x, y = top(labels[p]), top(labels[q])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((ids[p], ids[q]))
    return out


def _rest_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, {}

        def close() -> list[tuple[int, int]]:
            rows = sorted(group.items())
            return block_links([k for k, _ in rows], [v[0] for _, v in rows], [v[1] for _, v in rows], percent) if len(rows) > 1 else []

        found: list[tuple[int, int]] = []
        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("bucket", "i", "j", "id", "label")]
            for k, (bucket, i, j, name, label) in enumerate(zip(*cols)):
                if at != (bucket, i, j):
                    found += close()
                    at, group = (bucket, i, j), {}
                group[name] = (label, np.frombuffer(batch["shingles"][k].as_buffer(), np.uint64).copy())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=_LINKS)
            found = []
        found = close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=_LINKS)

    return run


def _stars(pairs: DataFrame, sets: DataFrame, percent: int, path: str) -> DataFrame:
    """The links among pairs (pivot, id), a stored table; a pivot with many members is salted by their number, which is stored at path."""
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    salts = common.stored(salts, path)
    many = pairs.join(salts, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id")
    one = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("id"))
    stars = many.union(one).join(sets, "id").select("pivot", "salt", "id", "shingles").withColumn("later", F.col("id") != F.col("pivot"))
    stars = stars.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "later")
    return stars.mapInArrow(_pivot_links(percent), "a long, b long")


def _apart(member: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their labels, and the buckets that hold different ones (with size and mass).

    Buckets of two are settled; buckets with equal members count once.
    """
    apart = member.where("size > 2").join(label, member["id"] == label["node"], "left").select("bucket", "id", F.coalesce("label", "id").alias("label"), "mass")
    prints = [F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("s2")]
    left = apart.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size"), F.max("mass").alias("mass"), *prints)
    return apart, left.where("x <> y").groupBy("size", "s1", "s2", "mass").agg(F.min("bucket").alias("bucket"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, row (id and text hash), n_shingles, component_id, kept, and group.

    group is the component's own number, null for the empty set: components that share their least doc_id,
    because rows share it, differ in it.
    """
    spark = docs.sparkSession
    path = common.scratch(spark, "minhash")
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = common.row_key(F.col("doc_id"), F.col("text"))
    drawn = base.select(key.alias("row"), _sketcher(words)(F.col("text")).alias("s")).select("row", "s.*")
    rows = common.stored(drawn, f"{path}/rows")

    # classes of equal sets, with dense unique ids
    classes = rows.where("n > 0").groupBy("fp").agg(F.min("row").alias("row"), F.min("row.id").alias("least"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = common.stored(classes.withColumn("id", F.monotonically_increasing_id()), f"{path}/classes")

    keys = classes.select("id", F.explode("bands").alias("bucket"))
    sized = classes.select("id", "n", F.explode("bands").alias("bucket"))
    full = sized.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("mass")).where("size > 1")
    full = common.stored(full, f"{path}/buckets")  # stored, so the join's sides are plain shuffles and a full bucket is split
    member = common.stored(keys.join(full, "bucket"), f"{path}/members")

    need = member.select("id").distinct().join(classes.select("id", "row"), "id")
    text_of = base.withColumn("row", key).drop("doc_id")
    sets = need.join(text_of, (need["row.id"].eqNullSafe(text_of["row.id"])) & (need["row.fp"] == text_of["row.fp"])).select("id", _setter(words)(F.col("text")).alias("shingles"))
    sets = common.stored(sets, f"{path}/sets")

    pairs = common.stored(member.where("id <> pivot").select("pivot", "id").distinct(), f"{path}/pairs")
    links = common.stored(_stars(pairs, sets, percent, f"{path}/salts"), f"{path}/links")
    label = components(links)
    apart, left = _apart(member, label)
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("mass") * 8 / BLOCK_BYTES)).cast("int")
    left = common.stored(left.select("bucket", blocks.alias("blocks")), f"{path}/left")
    rest = common.stored(apart.join(left, "bucket").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")), f"{path}/rest")
    if not rest.isEmpty():
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        tiles = rest.select("bucket", "id", "label", "own", other).select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label")
        tiles = tiles.join(sets, "id").select("bucket", "i", "j", "id", "label", "shingles").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        more = common.stored(tiles.mapInArrow(_rest_links(percent), "a long, b long"), f"{path}/more")
        label = components(links.union(more))

    known = classes.join(label, classes["id"] == label["node"], "left").select("fp", "least", F.coalesce("label", "id").alias("group"))
    best = known.groupBy("group").agg(F.min("least").alias("component_id"))
    found = known.join(best, "group").select("fp", "group", "component_id")
    out = rows.select(F.col("row.id").alias("doc_id"), "row", "fp", F.col("n").cast("long").alias("n_shingles")).join(found, "fp", "left")
    component = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.withColumn("component_id", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "row", "n_shingles", "component_id", "kept", "group")
