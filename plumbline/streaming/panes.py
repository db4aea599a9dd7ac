"""Accumulating panes of event-time windows: early, on time and late, by timers over state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds by the clock between early and between late panes of a window.
EARLY, LATE = 30, 60
PANES = "start long, key string, pane int, timing string, n long, total double"


class Panes(StatefulProcessor):
    """The state of one window of one key: rows, their sum, panes so far, the clock at the last one, whether it was due.

    The watermark follows the latest row by ``lateness``. A timer at the window's end less that is due when rows of the end have
    been seen: the pane on time. Rows until then come in early panes, rows from then on in late ones, at most one in so many
    seconds; a pane holds all rows so far. Once the watermark has passed the end, rows are too late and dropped; by a timer at the
    end what no pane has shown yet comes in a last one, and the state goes.
    """

    def __init__(self, size_ms: int, lateness_ms: int, early_s: float = EARLY, late_s: float = LATE) -> None:
        self.size_ms, self.lateness_ms, self.early_ms, self.late_ms = size_ms, lateness_ms, int(early_s * 1000), int(late_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "n long, total double, panes int, shown long, clock long, due boolean")

    def _emit(self, key: tuple, state: list, timing: str, now: int) -> pd.DataFrame:
        state[2], state[3], state[4] = state[2] + 1, state[0], now
        return pd.DataFrame({"start": [key[0]], "key": [key[1]], "pane": [state[2]], "timing": [timing], "n": [state[0]], "total": [state[1]]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, end = timerValues.getCurrentProcessingTimeInMs(), key[0] + self.size_ms
        if timerValues.getCurrentWatermarkInMs() >= end:
            return  # too late
        state = list(self.state.get()) if self.state.exists() else None
        if state is None:
            state = [0, 0.0, 0, 0, 0, False]
            self.handle.registerTimer(max(end - self.lateness_ms, 1))
            self.handle.registerTimer(end)
        for part in rows:
            state[0] += len(part)
            state[1] += float(part["value"].fillna(0).sum())
        wait = self.late_ms if state[5] else self.early_ms
        if now - state[4] >= wait:
            yield self._emit(key, state, "late" if state[5] else "early", now)
        self.state.update(tuple(state))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, state = timerValues.getCurrentProcessingTimeInMs(), list(self.state.get()) if self.state.exists() else None
        if state is None:
            return
        if not state[5]:
            state[5] = True
            yield self._emit(key, state, "on time", now)
            self.state.update(tuple(state))
        if expiredTimerInfo.getExpiryTimeInMs() >= key[0] + self.size_ms:
            if state[3] < state[0]:
                yield self._emit(key, state, "late", now)
            self.state.clear()

    def close(self) -> None:
        pass


def paned(stream: DataFrame, ts: str, key: str, value: str, *, size_seconds: int, lateness_seconds: int, early_s: float = EARLY, late_s: float = LATE) -> DataFrame:
    """``start`` (of the window, in milliseconds), ``key, pane`` (1 on), ``timing`` (early, on time or late), ``n, total`` (so far).

    The session must keep its state in RocksDB, as timers need.
    """
    size = size_seconds * 1000
    start = (F.floor(F.unix_millis(F.col(ts)) / size) * size).cast("long")
    rows = stream.withWatermark(ts, f"{lateness_seconds} seconds").select(start.alias("start"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"), F.col(ts))
    processor = Panes(size, lateness_seconds * 1000, early_s, late_s)
    return rows.groupBy("start", "key").transformWithStateInPandas(processor, outputStructType=PANES, outputMode="update", timeMode="eventtime")
