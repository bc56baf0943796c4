"""Each job's state kept by the stream itself: one keyed state and one idle timer for a job, in one query for all jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.streaming.events import TERMINAL

OUT = "job_id string, event_id long, status string, percent double, events long, ended boolean, idle boolean"


class JobStates(StatefulProcessor):
    """Keeps the last event of a job and how many there were; tells each change.

    A job whose events stop for ``idle_ms`` before it has ended is told once as
    idle. Events that are older than the last one count but change nothing, so
    a replay after a restart tells nothing twice.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "event_id long, status string, percent double, events long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, status, percent, events = self.state.get() if self.state.exists() else (-1, None, 0.0, 0)
        before = last
        for frame in rows:
            fresh = frame[frame["event_id"] > last].sort_values("event_id")
            events += len(frame)
            if len(fresh):
                row = fresh.iloc[-1]
                last, status, percent = int(row["event_id"]), row["status"], float(row["percent"])
        self.state.update((last, status, percent, events))
        ended = status in TERMINAL
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if last > before:
            yield self._told(key, last, status, percent, events, ended, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            last, status, percent, events = self.state.get()
            yield self._told(key, last, status, percent, events, status in TERMINAL, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _told(key, last, status, percent, events, ended, idle) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "event_id": [last], "status": [status], "percent": [percent], "events": [events], "ended": [ended], "idle": [idle]})


def job_states(events: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """A stream of job states from a stream of job events ``event_id, job_id, status, percent``; needs the RocksDB state store."""
    narrow = events.select("job_id", "event_id", "status", "percent")
    return narrow.groupBy("job_id").transformWithStateInPandas(JobStates(idle_ms), OUT, "Update", "ProcessingTime")


#: What a session needs for keyed states.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
