"""Count windows over streams: a recording's window is emitted when it is full, or when its tail has been quiet for long enough."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.windows import LEAST, SIZE

#: What a window gives: its recording, number, size, and statistics of ``value``.
OUTPUT = "split_group_id string, window_number long, window_tx_count long, value_mean double, value_std double, first_seen double, last_seen double"
STATE = "window_number long, n long, counted long, mean double, squares double, first_seen double, last_seen double"
_EMPTY = (0, 0, 0.0, 0.0, 0.0, 0.0)


class _Counter(StatefulProcessor):
    """Keeps running moments of the open window only (Welford), so state does not grow with the window's size."""

    def __init__(self, size: int, least: int, quiet_ms: int) -> None:
        self.size, self.least, self.quiet = size, least, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _out(self, key: tuple, w: tuple) -> tuple:
        number, n, counted, mean, squares, first, last = w
        return key[0], number, n, mean if counted else None, (squares / counted) ** 0.5 if counted else None, first, last

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, n, counted, mean, squares, first, last = self.open.get() if self.open.exists() else (0, *_EMPTY)
        done = []
        for part in rows:
            part = part.sort_values(["request_timestamp", "ingest_seq"], kind="stable")
            for t, v in zip(part["request_timestamp"], part["value"], strict=True):
                first, last, n = t if n == 0 else first, t, n + 1
                if pd.notna(v):
                    counted += 1
                    step = float(v) - mean
                    mean += step / counted
                    squares += step * (float(v) - mean)
                if n == self.size:
                    done.append(self._out(key, (number, n, counted, mean, squares, first, last)))
                    number += 1
                    n, counted, mean, squares, first, last = _EMPTY
        self.open.update((number, n, counted, mean, squares, first, last))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield pd.DataFrame(done, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = []
        if self.open.exists():
            w = self.open.get()
            if w[1] >= self.least:
                rows.append(self._out(key, w))
            self.open.update((w[0] + (w[1] > 0), *_EMPTY))  # the next window's number, so that none is given twice
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def stream_count_windows(stream: DataFrame, *, size: int = SIZE, least: int = LEAST, quiet_ms: int = 60_000) -> DataFrame:
    """Windows of a stream of ``split_group_id, request_timestamp, ingest_seq, value``.

    Rows must arrive in order of time across micro-batches (within one they are sorted).
    A tail of at least ``least`` rows is emitted after ``quiet_ms`` without rows, a shorter
    one is dropped; the recording then goes on with the next window's number, which is all
    that stays of it. Missing values count as rows only. Needs the RocksDB state store.
    """
    return stream.groupBy("split_group_id").transformWithStateInPandas(_Counter(size, least, quiet_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime")
