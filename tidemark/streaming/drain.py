"""The state of viewers that follow running analyses, kept by Spark over a stream of messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Messages that a viewer takes in one trigger.
MOST_MESSAGES = 64
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VIEW = "viewer STRING, analysed BIGINT, last_finished BIGINT, done BOOLEAN, waiting BIGINT"


class Drain(StatefulProcessor):
    """One viewer's state: which files are done, the last Finished message, and the messages that wait.

    Messages are taken in the order of ``seq``, no more than ``most`` a trigger; those of another generation are taken and
    dropped.  A Progress message marks its file; a Finished message replaces the state: everything is done.  What waits is taken at
    the next trigger, which a timer asks for if no message comes.
    """

    def __init__(self, generation: int, most: int = MOST_MESSAGES):
        self.generation, self.most = generation, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.view = handle.getValueState("view", "analysed BIGINT, last_finished BIGINT, done BOOLEAN")
        self.files = handle.getMapState("files", "index BIGINT", "kind STRING")
        self.queue = handle.getListState("queue", "seq BIGINT, generation BIGINT, index BIGINT, kind STRING")

    def _take(self, key, new: list[tuple], now: int) -> pd.DataFrame:
        waiting = sorted([*map(tuple, self.queue.get()), *new])
        analysed, last, done = self.view.get() if self.view.exists() else (0, None, False)
        for _, generation, index, kind in waiting[: self.most]:
            if generation != self.generation:
                continue
            if kind == "Finished":
                last, done = index if last is None else max(last, index), True
            elif not self.files.containsKey((index,)):
                self.files.updateValue((index,), (kind,))
                analysed += 1
        left = waiting[self.most :]
        self.view.update((analysed, last, done))
        self.queue.put(left) if left else self.queue.clear()
        if left:
            self.handle.registerTimer(now + 1)
        return pd.DataFrame({"viewer": [key[0]], "analysed": [analysed], "last_finished": pd.array([last], "Int64"), "done": [done], "waiting": [len(left)]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [t for frame in rows for t in frame[["seq", "generation", "index", "kind"]].astype({"kind": str}).itertuples(index=False, name=None)]
        yield self._take(key, [(int(s), int(g), int(i), k) for s, g, i, k in new], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._take(key, [], timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Make queries of the session keep their state where Drain needs it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def drained_stream(messages: DataFrame, generation: int, *, most: int = MOST_MESSAGES) -> DataFrame:
    """(viewer, analysed, last_finished, done, waiting) of each viewer that a trigger touches, after it.

    ``messages``: a stream of (viewer, seq, generation, index, kind).  The batch form is progress.drained.
    """
    use_state_store(messages.sparkSession)
    return messages.groupBy("viewer").transformWithStateInPandas(statefulProcessor=Drain(generation, most), outputStructType=VIEW, outputMode="Update", timeMode="ProcessingTime")
