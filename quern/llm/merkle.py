"""Merkle manifest of a table: a tree for each value of a key, and a tree over their roots.

The reduction works on sparse forests, an associative and commutative monoid.  A forest holds nodes of
trees of known width, keyed by level and index.  merge() joins two forests and replaces every run of
siblings that is complete (the arity is known, and the width tells how long the last run is) by its
parent.  A part holds the leaves of a range, of which at most two nodes a level stay unresolved.  Parts
are merged FAN at a time, round by round, in tasks, as treeReduce does; each round is a table in the
shared folder, since proofs need the nodes that merging uses up.  The way back hands every node the
digests beside its path to the root, round by round, down to the leaves.  No step sees more than FAN
forests, or the leaves of one part, at once; nothing is collected by the driver.

A leaf is the hash of its fields, each `-` if null, else its number of UTF-8 bytes, `:` and its value.
A node is the hash of its children's digests, written as lower-case hex and joined.

Defined cases: nulls are written `-`; a null key is a tree of its own and comes first, by bytes; rows
whose place is null come first; rows that tie in their place are taken in the order of their digests, so
repeated rows are leaves each; a tree of one leaf has this leaf as its root, whose proof then begins
above; texts of any length are hashed by Spark and never shuffled; an empty table gives an empty
result; extra columns, also those named like the results, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ARITY = 2
FAN = 16
LEAVES = 1 << 16
BATCH = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Levels = dict[int, dict[int, str]]


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def above(width: int) -> int:
    return -(-width // ARITY)


def run_of(index: int, width: int) -> range:
    """The siblings of a node of a level of this width, itself included."""
    low = index // ARITY * ARITY
    return range(low, min(low + ARITY, width))


def settle(forest: Levels, width: int) -> Levels:
    """Adds the parent of every complete run, level by level, to the forest of a tree with `width` leaves."""
    level = 0
    while width > 1:
        have, parents = forest.get(level, {}), forest.setdefault(level + 1, {})
        for i in have:
            if i // ARITY not in parents and all(j in have for j in run_of(i, width)):
                parents[i // ARITY] = hashed("".join(have[j] for j in run_of(i, width)))
        level, width = level + 1, above(width)
    return forest


def unresolved(forest: Levels) -> Iterator[tuple[int, int, str]]:
    """(level, index, digest) of the nodes whose parent isn't known."""
    for level, nodes in sorted(forest.items()):
        parents = forest.get(level + 1, {})
        yield from ((level, i, h) for i, h in nodes.items() if i // ARITY not in parents)


def merge(a: Levels, b: Levels, width: int) -> Levels:
    """The monoid's product: the unresolved nodes of both, with complete runs merged."""
    both: Levels = {}
    for side in (a, b):
        for level, nodes in side.items():
            both.setdefault(level, {}).update(nodes)
    out: Levels = {}
    for level, i, h in unresolved(settle(both, width)):
        out.setdefault(level, {})[i] = h
    return out


def fold(digest: str, proof: str, index: int, width: int) -> tuple[str, str]:
    """The root that a leaf's digest and its siblings' give, and what is left of the proof."""
    while width > 1:
        run = run_of(index, width)
        left, right = 64 * (index - run[0]), 64 * (len(run) - 1)
        digest = hashed(proof[:left] + digest + proof[left:right])
        proof, index, width = proof[right:], index // ARITY, above(width)
    return digest, proof


def _beside(forest: Levels, level: int, index: int, width: int, ends: dict) -> tuple[str, tuple]:
    """Siblings from a node up to the first ancestor (or itself) in ends, and what ends has for it."""
    beside = []
    while (end := ends.get((level, index))) is None:
        nodes = forest[level]
        beside += [nodes[j] for j in run_of(index, width) if j != index]
        level, index, width = level + 1, index // ARITY, above(width)
    return "".join(beside), end


def _width_at(width: int, level: int) -> int:
    for _ in range(level):
        width = above(width)
    return width


def _grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows of consecutive equal values of a column."""
    held, at = [], None
    for batch in batches:
        own = batch[by].to_numpy()
        cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and own[lo] != at:
                yield int(at), pa.Table.from_batches(held)
                held = []
            at = own[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield int(at), pa.Table.from_batches(held)


def _rows(out: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(out), BATCH):
        columns = zip(*out[k : k + BATCH])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_NODE = pa.schema([("part", pa.int32()), ("tree", pa.string()), ("width", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("digest", pa.string()), ("root", pa.bool_())])
_PATH = pa.schema([("part", pa.int32()), ("tree", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("proof", pa.string()), ("subroot", pa.string()), ("top", pa.string()), ("rank", pa.int64()), ("trees", pa.int64())])
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_SQL[f.type]}" for f in schema)


def _left(part: int, tree: str | None, width: int, forest: Levels) -> list[tuple]:
    return [(part, tree, width, level, i, h, _width_at(width, level) == 1) for level, i, h in unresolved(forest)]


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of parts, each part's starts before them, to the parts' unresolved nodes."""
    for part, rows in _grouped(batches, "part"):
        starts, leaves = {}, {}
        for tree, start, width, leaf in zip(*[rows[c].to_pylist() for c in ("tree", "start", "width", "leaf")]):
            if leaf is None:
                starts[tree] = (start, width)
            else:
                leaves.setdefault(tree, []).append(leaf)
        out = []
        for tree, digests in leaves.items():
            start, width = starts[tree]
            out += _left(part, tree, width, settle({0: dict(enumerate(digests, start))}, width))
        yield from _rows(out, _NODE)


def _forests(rows: pa.Table) -> dict:
    """{tree: [width, nodes by level]} of node rows."""
    found: dict = {}
    for tree, width, level, i, h in zip(*[rows[c].to_pylist() for c in ("tree", "width", "level", "index", "digest")]):
        if h is not None:
            found.setdefault(tree, [width, {}])[1].setdefault(level, {})[i] = h
    return found


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unresolved nodes of FAN parts to those of the group."""
    for group, rows in _grouped(batches, "group"):
        out = []
        for tree, (width, forest) in _forests(rows).items():
            out += _left(group, tree, width, settle(forest, width))
        yield from _rows(out, _NODE)


def _ends(rows: pa.Table) -> dict:
    ends: dict = {}
    for tree, level, i, *what in zip(*[rows[c].to_pylist() for c in ("tree", "level", "index", "proof", "subroot", "top", "rank", "trees")]):
        if what[0] is not None:
            ends.setdefault(tree, {})[level, i] = tuple(what)
    return ends


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of a group's unresolved nodes to those of the nodes that its parts left."""
    for _, rows in _grouped(batches, "group"):
        ends, forests, out = _ends(rows), _forests(rows), []
        for forest in forests.values():
            settle(forest[1], forest[0])
        for part, tree, width, level, i, h in zip(*[rows[c].to_pylist() for c in ("part", "tree", "width", "level", "index", "digest")]):
            if h is not None:
                beside, (proof, *rest) = _beside(forests[tree][1], level, i, _width_at(width, level), ends[tree])
                out.append((part, tree, level, i, beside + proof, *rest))
        yield from _rows(out, _PATH)


def _answer(out: list[tuple], names: list[str], rows: pa.Table, at: list[int]) -> pa.RecordBatch:
    """Result rows: the leaves' own columns, and what was found for them."""
    own = rows.take(pa.array(at, pa.int64()))
    kinds = {"index": pa.int64(), "width": pa.int64(), "verified": pa.bool_()}
    found = [pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*out))]
    return pa.RecordBatch.from_arrays([*[own[c].combine_chunks() for c in ("tree", "place", "leaf", "forged")], *found], names=["tree", "place", "leaf", "forged", *names])


_PROVEN = ["index", "width", "proof", "subroot", "top", "proof_sha256", "folded_root"]


def _prove(with_proof: bool):
    """Leaves, starts and proofs of a part's unresolved nodes to the leaves' own proofs, checked by folding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, "part"):
            ends, starts, leaves, where = _ends(rows), {}, {}, {}
            trees, digests, forged = (rows[c].to_pylist() for c in ("tree", "leaf", "forged"))
            for k, (tree, leaf, start, width) in enumerate(zip(trees, digests, rows["start"].to_pylist(), rows["width"].to_pylist())):
                if leaf is not None:
                    leaves.setdefault(tree, []).append(leaf)
                    where.setdefault(tree, []).append(k)
                elif start is not None:
                    starts[tree] = (start, width)
            for tree, own in leaves.items():
                start, width = starts[tree]
                forest, out, at = settle({0: dict(enumerate(own, start))}, width), [], []
                for i, k in enumerate(where[tree], start):
                    beside, (proof, subroot, top, rank, many) = _beside(forest, 0, i, width, ends[tree])
                    proof = beside + proof
                    root, rest = fold(forged[k] or digests[k], proof, i, width)
                    root, _ = fold(root, rest, rank, many)
                    out.append((i, width, proof if with_proof else None, subroot, top, hashed(proof), root))
                    at.append(k)
                    if len(out) == BATCH:
                        yield _answer(out, _PROVEN, rows, at)
                        out, at = [], []
                if out:
                    yield _answer(out, _PROVEN, rows, at)

    return run


@dataclass
class Forest:
    """Trees over leaves (tree, place, leaf, forged) after the way up: tables of the shared folder."""

    held: DataFrame
    starts: DataFrame
    rounds: list[DataFrame]  # unresolved nodes after each round, round 0 by parts
    parts: int

    def roots(self) -> DataFrame:
        """round, part, tree, width, level, index, digest of each tree's root: where it was resolved."""
        every = [r.where("root").select(F.lit(k).alias("round"), "*") for k, r in enumerate(self.rounds)]
        out = every[0]
        for r in every[1:]:
            out = out.union(r)
        return out.drop("root")

    def prove(self, rooted: DataFrame, path: str, with_proof: bool = False) -> DataFrame:
        """The leaves with their proofs.  rooted: roots() with proof, subroot, top, rank, trees of what is above them."""
        columns = [f.name for f in _PATH]
        paths = rooted.where(F.col("round") == len(self.rounds) - 1).select(*columns)
        for k in range(len(self.rounds) - 1, 0, -1):
            nodes = self.rounds[k - 1].where("not root").withColumn("group", _group(F.col("part")))
            both = nodes.unionByName(paths.withColumn("group", F.col("part")).drop("part"), allowMissingColumns=True)
            tasks = _groups(self.parts, k)
            down = both.repartitionById(tasks, "group").sortWithinPartitions("group").mapInArrow(_hand_down, _ddl(_PATH))
            paths = common.stored(down.union(rooted.where(F.col("round") == k - 1).select(*columns)), f"{path}/down{k}")
        rows = self.held.unionByName(self.starts, allowMissingColumns=True).unionByName(paths, allowMissingColumns=True)
        rows = rows.repartitionById(self.parts, "part").sortWithinPartitions("part", "tree", "place", "leaf")
        kinds = {"index": "long", "width": "long"}
        own = [f"{c} {self.held.schema[c].dataType.simpleString()}" for c in ("tree", "place", "leaf", "forged")]
        return rows.mapInArrow(_prove(with_proof), ", ".join([*own, *[f"`{n}` {kinds.get(n, 'string')}" for n in _PROVEN]]))


def _group(part: Column) -> Column:
    return F.floor(part / FAN).cast("int")


def _groups(parts: int, rounds: int) -> int:
    for _ in range(rounds):
        parts = -(-parts // FAN)
    return parts


def grow(leaves: DataFrame, path: str, most: int = LEAVES) -> Forest:
    """The way up over a stored table of leaves (tree, place, leaf, forged, salt); salt parts equal rows."""
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // most))
    ranged = leaves.repartitionByRange(parts, "tree", "place", "leaf", "salt").withColumn("part", F.spark_partition_id())
    held = common.stored(ranged.drop("salt"), f"{path}/held")
    counts = held.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    start = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = common.stored(counts.select("tree", "part", start.alias("start"), F.sum("n").over(tree).alias("width")), f"{path}/starts")
    rows = held.select("part", "tree", "place", "leaf").unionByName(starts, allowMissingColumns=True)
    rows = rows.repartitionById(parts, "part").sortWithinPartitions("part", "tree", "place", "leaf")
    rounds = [common.stored(rows.mapInArrow(_plant, _ddl(_NODE)), f"{path}/up0")]
    left = parts
    while left > 1:
        nodes = rounds[-1].where("not root").withColumn("group", _group(F.col("part")))
        left = -(-left // FAN)
        up = nodes.repartitionById(left, "group").sortWithinPartitions("group").mapInArrow(_reduce, _ddl(_NODE))
        rounds.append(common.stored(up, f"{path}/up{len(rounds)}"))
    return Forest(held, starts, rounds, parts)


def leaf_digest(values: dict[str, Column]) -> Column:
    """The hash of a row's fields, in their order."""
    fields = []
    for value in values.values():
        s = value.cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*fields).cast("binary"), 256)


@dataclass
class Manifest:
    """proofs: a row for each leaf; trees: key, n_rows, subroot, root and the proof of each subroot."""

    proofs: DataFrame
    trees: DataFrame


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, tree: str = "lang", place: str = "doc_id", most: int = LEAVES) -> Manifest:
    """Manifest of docs.  Where `tampered` holds, proofs are checked against the leaf that has the fields `changed`."""
    path = common.scratch(docs.sparkSession, "merkle")
    own = {c: F.col(c) for c in fields}
    forged = F.when(tampered, leaf_digest(own | (changed or {}))) if tampered is not None else F.lit(None).cast("string")
    leaves = docs.select(F.col(tree).cast("string").alias("tree"), F.col(place).alias("place"), leaf_digest(own).alias("leaf"), forged.alias("forged"), F.monotonically_increasing_id().alias("salt"))
    trees = grow(common.stored(leaves, f"{path}/leaves"), f"{path}/trees", most)
    roots = common.stored(trees.roots(), f"{path}/roots")
    # the tree over the trees' roots, by the same way
    tops = roots.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("place"), F.col("digest").alias("leaf"), F.lit(None).cast("string").alias("forged"), F.lit(0).alias("salt"))
    crown = grow(tops, f"{path}/crown", most)
    bare = crown.roots().select("*", F.lit("").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("top"), F.lit(0).cast("long").alias("rank"), F.lit(1).cast("long").alias("trees"))
    crowned = crown.prove(bare, f"{path}/crown", True).select(F.col("place").alias("key"), F.col("leaf").alias("subroot"), "top", F.col("index").alias("rank"), F.col("width").alias("trees"), "proof")
    crowned = common.stored(crowned, f"{path}/crowned")
    rooted = common.stored(roots.join(crowned, roots["tree"].eqNullSafe(crowned["key"])).drop("key"), f"{path}/rooted")
    proofs = trees.prove(rooted, f"{path}/trees").select("place", "tree", "leaf", "index", "subroot", F.col("top").alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.col("top")).alias("verified"))
    return Manifest(proofs, rooted.select(F.col("tree").alias("key"), F.col("width").alias("n_rows"), "subroot", F.col("top").alias("root"), "proof"))
