"""The truth ledger as a stream: keyed state per slot, one row out for each event's action.

A slot's state is its frontier (the newest date, and how many edges it has) and a map from (date, claim) to whether the edge
came on time.  An event looks up its own edge and the frontier, whatever the slot holds already: state work per event doesn't
grow with the slot, and only changed entries are written.  State is kept in RocksDB, in the query's checkpoint folder.

Late events are facts, not noise, so there is no watermark: nothing is ever dropped.  Batches may cut the arrival order
anywhere; within a batch a slot's events are taken in the order of seq.  Null claims are one claim, null slots one slot;
repeated events merge; an empty stream gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "slot string, seq string, action string, active_truth_changed boolean"
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Ledger(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frontier = handle.getValueState("frontier", "day string, edges int")
        self.edges = handle.getMapState("edges", "day string, claim string", "on_time boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        newest, peers = self.frontier.get() if self.frontier.exists() else (None, 0)
        was, done = (newest, peers), []
        for seq, claim, day in zip(events["seq"], events["claim"], events["effective"]):
            edge = (day, "" if claim is None else claim)
            if self.edges.containsKey(edge):
                done.append((key[0], seq, "MERGED_IDEMPOTENT", False))
                continue
            self.edges.updateValue(edge, (newest is None or day >= newest,))
            if newest is None or day > newest:
                done.append((key[0], seq, "INSERTED_ACTIVE" if newest is None else "SUPERSEDED_PRIOR", True))
                newest, peers = day, 1
            elif day < newest:
                done.append((key[0], seq, "INSERTED_HISTORICAL", False))
            else:
                done.append((key[0], seq, "CONTRADICTION_RECORDED", peers == 1))
                peers += 1
        if (newest, peers) != was:
            self.frontier.update((newest, peers))
        yield pd.DataFrame(done, columns=["slot", "seq", "action", "active_truth_changed"])

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Queries that this session starts from now on keep their state in RocksDB, which keyed state needs."""
    spark.conf.set(*PROVIDER)


def actions(events: DataFrame) -> DataFrame:
    """Streaming events (slot, claim, effective as text, seq) to their actions."""
    keyed_state(events.sparkSession)
    return events.groupBy("slot").transformWithStateInPandas(Ledger(), OUT, "append", "None")
