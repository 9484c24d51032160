"""Streams over status events and messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions import fixed

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_store(df: DataFrame) -> None:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


# ---- counts -----------------------------------------------------------------
def live_counts(events: DataFrame, status: str) -> DataFrame:
    return events.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, status: str, time: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window; late events within the watermark still count."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), status).agg(F.count(F.lit(1)).alias("n"))


# ---- summary trigger --------------------------------------------------------
class _SummaryDue(StatefulProcessor):
    """Count of messages and summary version per conversation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "messages bigint, version bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        messages, version = self._seen.get() if self._seen.exists() else (0, 0)
        messages += sum(len(batch) for batch in rows)
        due = []
        while messages >= (version + 1) * fixed.SUMMARY_EVERY:
            version += 1
            due.append(version)
        self._seen.update((messages, version))
        if due:
            yield pd.DataFrame({"conv_id": [key[0]] * len(due), "version": due, "messages": [v * fixed.SUMMARY_EVERY for v in due]})

    def close(self) -> None:
        pass


def summary_triggers(messages: DataFrame) -> DataFrame:
    """One row (conv_id, version, messages) whenever a conversation reaches the next eight messages."""
    _state_store(messages)
    return messages.select("conv_id").groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_SummaryDue(), outputStructType="conv_id bigint, version bigint, messages bigint",
        outputMode="append", timeMode="none",
    )


# ---- stalled work -----------------------------------------------------------
class _Stalled(StatefulProcessor):
    """Alert when a document in a working status has no event for fifteen minutes."""

    def __init__(self, terminal: list[str], minutes: int) -> None:
        self._terminal, self._wait = set(terminal), minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "status string, at bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, at, timer = self._last.get() if self._last.exists() else (None, -1, -1)
        gaps = []
        pending = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for when, new in zip(pending["ts"], pending["status"]):
            moment = int(pd.Timestamp(when).value // 1_000_000)
            if moment < at:
                continue
            if status is not None and status not in self._terminal and moment - at > self._wait:
                gaps.append((key[0], status, pd.Timestamp(at, unit="ms")))
            status, at = new, moment
        if timer >= 0:
            self._handle.deleteTimer(timer)
            timer = -1
        if status is not None and status not in self._terminal:
            timer = at + self._wait + 1
            self._handle.registerTimer(timer)
        self._last.update((status, at, timer))
        if gaps:
            yield pd.DataFrame(gaps, columns=["doc_id", "status", "last_seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self._last.exists():
            return
        status, at, timer = self._last.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        # Told once: a later event starts the watch again.
        self._last.clear()
        yield pd.DataFrame({"doc_id": [key[0]], "status": [status], "last_seen": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def stalled_alerts(events: DataFrame, terminal: list[str], minutes: int = fixed.STALL_MINUTES, late: str = "1 minute") -> DataFrame:
    """Alerts (doc_id, status, last_seen) over events (doc_id, event_id, status, ts timestamp)."""
    _state_store(events)
    return (
        events.select("doc_id", "event_id", "status", "ts").withWatermark("ts", late).groupBy("doc_id")
        .transformWithStateInPandas(
            statefulProcessor=_Stalled(terminal, minutes),
            outputStructType="doc_id bigint, status string, last_seen timestamp", outputMode="append", timeMode="eventTime",
        )
    )
