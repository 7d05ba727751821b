"""Many literal cues in one pass over a text.

All cues are in one automaton (a trie with failure links), which is built once in a task and reads each text once,
however many cues there are.  Cues are found anywhere, also inside words and inside each other.  A null text gives null,
an empty one no hits; repeated cues count once.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_HITS = "array<struct<cue: int, start: int, end: int>>"


@lru_cache(maxsize=16)
def _machine(cues: tuple[str, ...]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for k, cue in enumerate(cues):
        machine.add_word(cue, (k, len(cue)))
    machine.make_automaton()
    return machine


class Cues:
    """A list of cues, and conditions on which of them a text holds."""

    def __init__(self, phrases: Iterable[str]):
        self.cues = tuple(dict.fromkeys(phrases))
        self.number = {p: k for k, p in enumerate(self.cues)}

    def spans(self, text: Column) -> Column:
        """array<struct<cue, start, end>> of every occurrence (ends exclusive, in characters), by end."""
        cues = self.cues
        kind = pa.list_(pa.struct([("cue", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

        @F.arrow_udf(_HITS)
        def run(texts: pa.Array) -> pa.Array:
            find = _machine(cues).iter
            return pa.array([None if t is None else [{"cue": k, "start": e + 1 - n, "end": e + 1} for e, (k, n) in find(t)] for t in texts.to_pylist()], kind)

        return run(text)

    def found(self, text: Column) -> Column:
        """array<int>: the numbers of the cues that a text holds."""
        cues = self.cues

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            find = _machine(cues).iter
            return pa.array([None if t is None else sorted({k for _, (k, _) in find(t)}) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return run(text)

    def bits(self, text: Column, lists: list[tuple[str, ...]]) -> Column:
        """long: bit k is set if the text holds a cue of the k-th list (up to 63 lists)."""
        if len(lists) > 63:
            raise ValueError("a long has bits for 63 lists")
        cues = self.cues
        mask = [sum(1 << k for k, ps in enumerate(lists) if c in ps) for c in cues]

        @F.arrow_udf("long")
        def run(texts: pa.Array) -> pa.Array:
            find = _machine(cues).iter

            def of(t: str) -> int:
                b = 0
                for _, (k, _) in find(t):
                    b |= mask[k]
                return b

            return pa.array([None if t is None else of(t) for t in texts.to_pylist()], pa.int64())

        return run(text)

    def holding(self, text: Column, rules: list[tuple[str, list[list[str]], list[str]]]) -> Column:
        """array<int>: the numbers of the rules (group, cue lists of which each needs one, cues none of which may be there) that a
        text meets; of each group only the first.  Every rule needs a cue, so a text without cues costs its reading alone."""
        cues = self.cues
        plain = [(group, [{self.number[c] for c in n} for n in needs], {self.number[c] for c in unless}) for group, needs, unless in rules]
        asked: dict[int, list[int]] = {}
        for k, (_, needs, _) in enumerate(plain):
            for c in needs[0]:
                asked.setdefault(c, []).append(k)

        def met(there: set[int]) -> list[int]:
            first: dict[str, int] = {}
            for k in sorted({k for c in there for k in asked.get(c, ())}):
                group, needs, unless = plain[k]
                if group not in first and not there & unless and all(there & n for n in needs):
                    first[group] = k
            return sorted(first.values())

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            find = _machine(cues).iter
            return pa.array([None if t is None else met({k for _, (k, _) in find(t)}) for t in texts.to_pylist()], pa.list_(pa.int32()))

        return run(text)

    def has(self, found: Column, *phrases: str) -> Column:
        """Whether any of the phrases is among the found ones."""
        return F.coalesce(F.arrays_overlap(found, F.array(*[F.lit(self.number[p]) for p in phrases])), F.lit(False))
