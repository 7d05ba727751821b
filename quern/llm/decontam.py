"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a seed (min_match words in a row) are tiled: running Karp-Rabin
looks for the longest common word runs that no tile covers yet, marks them, and goes on with shorter
ones down to min_match.  Tiles may lie in any order, so reordered passages count.  A document is
contaminated if tiles cover at least `threshold` of an item's words.

A pair is tiled only if it can matter: the words of an item that shared seeds cover bound what tiles can, so
items are tiled in falling order of this bound and the rest is left once neither `threshold` nor the best
coverage found can be reached.  An opening phrase that many items share costs no tiling of them all.

Documents stay where they were read: the map needs no shuffle.  The items' seeds go to the tasks in
chunks of at most CHUNK_BYTES of text, and a larger benchmark takes more passes.

Words are runs of anything but ASCII white space, A-Z in lower case.  Defined cases: a null or empty
text has no words and is clean; an item without words is ignored; an item shorter than min_match words
matches as a whole; of items with equal coverage the smallest item_id is named (null ids last); rows
that repeat are decided alike; an empty benchmark leaves all documents clean; extra columns stay.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textkernel as K

MIN_MATCH = 5
THRESHOLD = 0.8
CHUNK_BYTES = 16 << 20
_FILTER_BITS = 22
HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("covered", T.IntegerType(), False), T.StructField("words", T.IntegerType(), False)])


def _window_hashes(tokens: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of s tokens, rolled by prefix sums."""
    powers, inverses = K._power_tables(len(tokens) + 1)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * powers[: len(tokens)], out=sums[1:])
    return (sums[s:] - sums[:-s]) * inverses[: len(tokens) - s + 1]


def _free(marked: np.ndarray, s: int) -> np.ndarray:
    sums = np.append(0, np.cumsum(marked))
    return sums[s:] == sums[:-s]


def _matches(p: np.ndarray, t: np.ndarray, mp: np.ndarray, mt: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal common runs of s or more tokens outside tiles: starts in p and t, lengths."""
    empty = (np.zeros(0, np.int64),) * 3
    if len(p) < s or len(t) < s:
        return empty
    ip, it = np.flatnonzero(_free(mp, s)), np.flatnonzero(_free(mt, s))
    hp, ht = _window_hashes(p, s)[ip], _window_hashes(t, s)[it]
    order = np.argsort(hp, kind="stable")
    hp, ip = hp[order], ip[order]
    lo, hi = np.searchsorted(hp, ht, "left"), np.searchsorted(hp, ht, "right")
    n = hi - lo
    if not n.sum():
        return empty
    j = np.repeat(it, n)
    i = ip[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
    # a run that could begin earlier is found from there
    inner = (i > 0) & (j > 0)
    inner[inner] = (p[i[inner] - 1] == t[j[inner] - 1]) & ~mp[i[inner] - 1] & ~mt[j[inner] - 1]
    i, j = i[~inner], j[~inner]
    size, live = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(live):
        a, b = i[live] + size[live], j[live] + size[live]
        ok = (a < len(p)) & (b < len(t))
        live, a, b = live[ok], a[ok], b[ok]
        live = live[(p[a] == t[b]) & ~mp[a] & ~mt[b]]
        size[live] += 1
    good = size >= s  # equal tokens, not only equal hashes
    return i[good], j[good], size[good]


def tiles(p: np.ndarray, t: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling of token hashes p by t: (start in p, start in t, length), longest first."""
    min_match = max(1, min(min_match, len(p)))
    mp, mt = np.zeros(len(p), bool), np.zeros(len(t), bool)
    out: list[tuple[int, int, int]] = []
    s = max(min_match, min(len(p), len(t), 4 * min_match))
    while True:
        i, j, size = _matches(p, t, mp, mt, s)
        if len(size) and size.max() > 2 * s:
            s = int(size.max())
            continue
        queue: dict[int, list[tuple[int, int]]] = {}
        for a, b, n in sorted(zip(i.tolist(), j.tolist(), size.tolist())):
            queue.setdefault(n, []).append((a, b))
        while queue:
            n = max(queue)
            for a, b in sorted(queue.pop(n)):
                taken = mp[a : a + n] | mt[b : b + n]
                if not taken.any():
                    mp[a : a + n] = mt[b : b + n] = True
                    out.append((a, b, n))
                    continue
                edges = np.flatnonzero(np.diff(np.concatenate(([1], taken.view(np.int8), [1]))))
                for x, y in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if y - x >= s:
                        queue.setdefault(y - x, []).append((a + x, b + x))
        if s <= min_match:
            return out
        s = max(min_match, s // 2)


def _chunks(benchmark: DataFrame, item_id: str, item_text: str, limit: int) -> Iterator[list[tuple]]:
    """The items in lists of about `limit` bytes of text."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // limit))
    for k in range(parts):
        rows = (items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else items).collect()
        if rows:
            yield [(r["i"], r["t"]) for r in rows]


class _Index:
    """Seeds of a chunk of items; a bit filter on their low bits screens the documents' windows."""

    def __init__(self, items: list[tuple], min_match: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        self.items: list[tuple[int | None, np.ndarray]] = []
        for w in K.words(texts):
            for r in range(w.lo, w.hi):
                h = w.hashes[w.ptr[r - w.lo] : w.ptr[r - w.lo + 1]]
                if len(h):
                    self.items.append((items[r][0], h))
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in {min(min_match, len(h)) for _, h in self.items}:
            pairs = [(K.ngrams(h, n), k) for k, (_, h) in enumerate(self.items) if min(min_match, len(h)) == n]
            seed = np.concatenate([s for s, _ in pairs])
            owner = np.concatenate([np.full(len(s), k, np.int64) for s, k in pairs])
            place = np.concatenate([np.arange(len(s)) for s, _ in pairs])
            order = np.lexsort((place, owner, seed))
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(seed & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
            self.by_size[n] = (seed[order], owner[order], place[order], bits)
        self.size = np.array([len(h) for _, h in self.items], np.int64)
        names = sorted({i for i, _ in self.items if i is not None})
        self.rank = np.array([len(names) if i is None else bisect_left(names, i) for i, _ in self.items], np.int64)

    def candidates(self, h: np.ndarray, ptr: np.ndarray) -> list[tuple[int, int, int]]:
        """(text in the slice, item, words of the item that shared seeds cover) of pairs that share a seed.

        Of each text, the items come in falling order of the share that is covered, then of their ids.
        """
        found = []
        for n, (seed, owner, place, bits) in self.by_size.items():
            g = K.ngrams(h, n)
            at = np.flatnonzero(bits[(g & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(seed, g[at], "left"), np.searchsorted(seed, g[at], "right")
            at, lo, hi = at[hi > lo], lo[hi > lo], hi[hi > lo]
            row = np.searchsorted(ptr, at, "right") - 1
            inside = at + n <= ptr[row + 1]
            at, lo, hi, row = at[inside], lo[inside], hi[inside], row[inside]
            c = hi - lo
            if not len(c):
                continue
            which = np.repeat(lo - np.append(0, np.cumsum(c)[:-1]), c) + np.arange(c.sum())
            at = np.unique(np.stack([np.repeat(row, c), owner[which], place[which]]), axis=1)
            new = np.append(True, (np.diff(at[:2]) != 0).any(axis=0))
            step = np.append(np.diff(at[2]), n)
            step[np.append(new[1:], True)] = n
            first = np.flatnonzero(new)
            found.append(np.stack([at[0][first], at[1][first], np.add.reduceat(np.minimum(step, n), first)]))
        if not found:
            return []
        row, item, covered = np.concatenate(found, axis=1)
        return np.stack([row, item, covered])[:, np.lexsort((self.rank[item], -covered / self.size[item], row))].T.tolist()


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, chunk_bytes: int = CHUNK_BYTES, out: str = "hits", at_least: float | None = None) -> DataFrame:
    """docs with a column `out`: of every item that shares a seed, its id, words, and words that tiles cover.

    With at_least, only of items that reach this share, and of the one with the best share below.
    """
    spark = docs.sparkSession
    done = docs.withColumn(out, F.lit(None).cast(T.ArrayType(HIT)))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("covered", pa.int32()), ("words", pa.int32())]))
    for k, chunk in enumerate(_chunks(benchmark, item_id, item_text, chunk_bytes)):
        index = spark.sparkContext.broadcast(_Index(chunk, min_match))

        @F.arrow_udf(T.ArrayType(HIT))
        def tile(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = index.value
            for texts in batches:
                result: list[list | None] = [None] * len(texts)
                for w in K.words(texts):
                    of, best = -1, (0, 1, 0)
                    for r, i, bound in own.candidates(w.hashes, w.ptr):
                        name, p = own.items[i]
                        if r != of:
                            of, best = r, (0, 1, len(own.items))
                        if at_least is not None and bound / len(p) < at_least:
                            more = bound * best[1] - best[0] * len(p)
                            if more < 0 or (more == 0 and own.rank[i] >= best[2]):
                                continue
                        found = tiles(p, w.hashes[w.ptr[r] : w.ptr[r + 1]], min_match)
                        if found:
                            n = sum(n for _, _, n in found)
                            more = n * best[1] - best[0] * len(p)
                            if more > 0 or (more == 0 and own.rank[i] < best[2]):
                                best = (n, len(p), own.rank[i])
                            result[w.lo + r] = [*(result[w.lo + r] or []), {"item_id": name, "covered": n, "words": len(p)}]
                yield pa.array(result, kind)

        more = F.coalesce(tile(F.col(text)), F.array().cast(T.ArrayType(HIT)))
        done = done.withColumn(out, F.concat(F.coalesce(F.col(out), F.array().cast(T.ArrayType(HIT))), more))
        if k % 4 == 3:
            done = common.stored(done, common.scratch(spark, "hits"))
    return done.withColumn(out, F.coalesce(F.col(out), F.array().cast(T.ArrayType(HIT))))


def decide(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, prefix: str = "", **how) -> DataFrame:
    """docs with the best item, its coverage, the items at or over the threshold, and the decision."""
    tmp = f"{prefix}__hits"
    share = lambda x: x["covered"] / x["words"]
    none = F.struct(F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("covered"), F.lit(1).alias("words"))
    return (
        hits(docs, benchmark, out=tmp, at_least=threshold, **how)
        .withColumn(f"{prefix}__best", F.coalesce(F.get(F.array_sort(F.col(tmp), lambda a, b: F.when(share(a) > share(b), -1).when(share(a) < share(b), 1).when(a["item_id"].eqNullSafe(b["item_id"]), 0).when(b["item_id"].isNull() | (a["item_id"] < b["item_id"]), -1).otherwise(1)), F.lit(0)), none))
        .withColumn(f"{prefix}item_id", F.col(f"{prefix}__best.item_id"))
        .withColumn(f"{prefix}covered_words", F.col(f"{prefix}__best.covered").cast("int"))
        .withColumn(f"{prefix}coverage", share(F.col(f"{prefix}__best")))
        .withColumn(f"{prefix}item_ids", F.array_sort(F.array_distinct(F.transform(F.filter(tmp, lambda x: share(x) >= threshold), lambda x: x["item_id"]))))
        .withColumn(f"{prefix}contaminated", F.col(f"{prefix}coverage") >= threshold)
        .drop(tmp, f"{prefix}__best")
    )
