"""Corrections locked by version on a stream: the state of ``operators.locking`` kept by session.

Version and text are a value, marks a map by the seq of their correction, so a
micro-batch reads and writes what it changes.  A session that is silent for ``ttl`` is
forgotten, and its next event finds a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.locking import RESULTS, Session, rows

#: State is kept by this provider only.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Lock(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.document = handle.getValueState("document", "version long, text string", ttlDurationMs=self.ttl_ms)
        self.marks = handle.getMapState("marks", "seq long", "start int, end int", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = pd.concat(batches).sort_values("seq", kind="stable")
        state = Session()
        if self.document.exists():
            state.version, state.text = self.document.get()
            state.marks = {k[0]: tuple(v) for k, v in self.marks.iterator()}
        before = dict(state.marks)
        found = [r for e in events.to_dict("records") for r in state.take(e)]
        self.document.update((state.version, state.text))
        for seq in before.keys() - state.marks.keys():
            self.marks.removeKey((seq,))
        for seq, place in state.marks.items():
            if before.get(seq) != place:
                self.marks.updateValue((seq,), place)
        yield rows(key[0], found)

    def close(self) -> None:
        pass


def locked(events: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Results (columns of RESULTS) of a stream of events (columns of ``locking.EVENTS``), those of a session in order of seq across micro-batches."""
    return events.groupBy("session").transformWithStateInPandas(Lock(ttl_ms), outputStructType=RESULTS, outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")
