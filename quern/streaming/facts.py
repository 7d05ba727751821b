"""Visible facts of a conversation: confirmed, unknown or in conflict, with explicit supersession.

An ordered fold over a key's updates.  Keys are partitioned by Spark and read in order; a key's state is
one small record, so a key of any length streams through a task without being gathered.

An update is refused, and leaves the fact as it was, if its key, turn or status is missing, if it is unknown with a value
or known without one, if it supersedes a turn other than the current one, if the turn has updated the key already, or if
it changes the fact without superseding or calling itself a conflict.  A null key is one key; ties in seq go by turn; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

STATUSES = {"confirmed", "unknown", "conflict"}
RESULT = "key string, status string, value string, turn_id string, alternatives array<string>, history array<string>, refused array<struct<turn_id: string, rule: string>>"
_REFUSAL = pa.struct([("turn_id", pa.string()), ("rule", pa.string())])
_KIND = pa.schema([("key", pa.string()), ("status", pa.string()), ("value", pa.string()), ("turn_id", pa.string()), ("alternatives", pa.list_(pa.string())), ("history", pa.list_(pa.string())), ("refused", pa.list_(_REFUSAL))])


class Fact:
    """Of one key; status is null until an update is taken."""

    def __init__(self) -> None:
        self.status = self.value = self.turn_id = None
        self.alternatives: list[str] = []
        self.history: list[str] = []
        self.refused: list[dict] = []

    def fault(self, key: str | None, value: str | None, status: str | None, supersedes: str | None, turn: str | None) -> str | None:
        """The first rule that an update breaks."""
        known = self.turn_id is not None
        rules = [
            ("MISSING_KEY", not (key or "").strip()), ("MISSING_TURN", not (turn or "").strip()), ("INVALID_STATUS", status not in STATUSES),
            ("UNKNOWN_WITH_VALUE", status == "unknown" and value is not None), ("MISSING_VALUE", status != "unknown" and value is None),
            ("STALE_SUPERSEDES", supersedes is not None and not (known and supersedes == self.turn_id)), ("REPEATED_TURN", turn in self.history),
            ("CHANGED_WITHOUT_SUPERSEDES", known and supersedes is None and status != "conflict" and (status, value) != (self.status, self.value)),
        ]
        return next((name for name, broken in rules if broken), None)

    def update(self, key: str | None, value: str | None, status: str | None, supersedes: str | None, turn: str | None) -> None:
        rule = self.fault(key, value, status, supersedes, turn)
        if rule:
            self.refused.append({"turn_id": turn, "rule": rule})
            return
        if status == "conflict":
            kept = [] if supersedes is not None else self.alternatives or ([self.value] if self.status == "confirmed" else [])
            self.alternatives = kept if value in kept else [*kept, value]
        else:
            self.alternatives = []
        self.status, self.value, self.turn_id = status, value, turn
        self.history.append(turn)


    def observe(self, key: str | None, value: str | None, status: str | None, corrected: bool | None, turn: str | None) -> None:
        """A declaration: a change supersedes what it corrects or makes known, else it is a conflict; doubt alone retracts nothing."""
        supersedes = None
        if self.turn_id is not None and (status, value) != (self.status, self.value):
            if corrected or self.status == "unknown":
                supersedes = self.turn_id
            elif status == "unknown":
                self.refused.append({"turn_id": turn, "rule": "UNCERTAIN_RETRACTION"})
                return
            else:
                status = "conflict"
        self.update(key, value, status, supersedes, turn)


def fold(updates: DataFrame) -> DataFrame:
    """The final state of each key; updates: key, seq, value, status, supersedes, turn_id."""
    return _folded(updates, "supersedes", Fact.update)


def observed(declarations: DataFrame) -> DataFrame:
    """The final state of each key; declarations: key, seq, value, status, corrected, turn_id."""
    return _folded(declarations, "corrected", Fact.observe)


def _folded(rows: DataFrame, how: str, step: Callable) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fact = None, None
        for batch in batches:
            done = []
            for key, value, status, mode, turn in zip(*(batch[c].to_pylist() for c in ("key", "value", "status", how, "turn_id"))):
                if fact is None or key != at:
                    if fact is not None:
                        done.append((at, fact))
                    at, fact = key, Fact()
                step(fact, key, value, status, mode, turn)
            yield _rows(done)
        yield _rows([(at, fact)] if fact is not None else [])

    ordered = rows.repartition("key").sortWithinPartitions("key", "seq", "turn_id").select("key", "value", "status", how, "turn_id")
    return ordered.mapInArrow(run, RESULT)


def _rows(done: list[tuple[str, Fact]]) -> pa.RecordBatch:
    cols = [[k for k, _ in done], *([getattr(f, c) for _, f in done] for c in _KIND.names[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _KIND.types)], schema=_KIND)
