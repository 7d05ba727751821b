"""A simulated respondent who discloses facts: scheduled events first, then what is asked, within a turn budget.

A session is an ordered fold with small state; sessions are partitioned by key and stream through tasks, so
a session of any length is never gathered.  Script (facts, events) comes with the session's first row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

RESULT = "session_id string, turn int, kind string, item string, reply string, matched boolean"
_KIND = pa.schema([("session_id", pa.string()), ("turn", pa.int32()), ("kind", pa.string()), ("item", pa.string()), ("reply", pa.string()), ("matched", pa.bool_())])
UNKNOWN = "I don't know."


@dataclass
class Session:
    """facts: slot to text; events: (turn, name, text), each once, none skipped; ends after `budget` turns."""

    facts: dict[str, str]
    events: list[tuple[int, str, str]]
    budget: int
    told: set[str] = field(default_factory=set)
    turn: int = 0
    done: bool = False

    def step(self, slots: list[str]) -> tuple[str, str | None, str, bool]:
        """kind, item, reply, matched for the next question."""
        if self.done or self.turn >= self.budget:
            self.done = True
            return "ended", None, "", False
        self.turn += 1
        due = sorted(e for e in self.events if e[0] <= self.turn)
        if due:
            self.events.remove(due[0])
            return "event", due[0][1], due[0][2], True
        for slot in slots:
            if slot in self.facts and slot not in self.told:
                self.told.add(slot)
                return "fact", slot, self.facts[slot], True
        for slot in slots:
            if slot in self.told:
                return "repeat", slot, self.facts[slot], True
        return "unmatched", None, UNKNOWN, False


def play(turns: DataFrame) -> DataFrame:
    """turns: session_id, turn, slots array, facts map, events array<struct<turn, name, text>>, budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, session, began = None, None, False
        for batch in batches:
            out = []
            for name, turn, slots, facts, events, budget in zip(*(batch[c].to_pylist() for c in ("session_id", "turn", "slots", "facts", "events", "budget"))):
                if not began or name != at:
                    at, began = name, True
                    session = Session(dict(facts or []), [(e["turn"], e["name"], e["text"]) for e in events or []], budget)
                out.append((name, turn, *session.step(slots or [])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(_KIND.types)], schema=_KIND)

    ordered = turns.repartition("session_id").sortWithinPartitions("session_id", "turn").select("session_id", "turn", "slots", "facts", "events", "budget")
    return ordered.mapInArrow(run, RESULT)
