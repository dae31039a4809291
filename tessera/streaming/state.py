"""Keyed state kept by Python functions across batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def running_totals(stream: DataFrame) -> DataFrame:
    """(user_id, n, total, batch rows) of each user after each batch that holds the user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    grouped = stream.select("user_id", "value").groupBy("user_id")
    return grouped.applyInPandasWithState(step, "user_id long, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


class Sessions(StatefulProcessor):
    """One open session a key, in keyed state, which a timer on event time closes ``gap`` microseconds after its last row.

    A row further on closes it as well. Rows must come in order of time across
    batches, apart from what the watermark allows for.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "begin long, last long, n long")

    def _timer(self, last: int) -> int:
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for f in rows for t in f["micros"].tolist())
        held = self.open.get() if self.open.exists() else None
        if held:
            self.handle.deleteTimer(self._timer(held[1]))
        begin, last, n = held or (times[0], times[0], 0)
        closed = []
        for t in times:
            if t - last >= self.gap:
                closed.append((begin, n))
                begin, n = t, 0
            begin, last, n = min(begin, t), max(last, t), n + 1
        self.open.update((begin, last, n))
        self.handle.registerTimer(self._timer(last))
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin, _, n = self.open.get()
        self.open.clear()
        yield self._rows(key, [(begin, n)])

    def _rows(self, key, closed: list) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]] * len(closed), "begin": [b for b, _ in closed], "n": [n for _, n in closed]}, dtype="int64")

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with timers need, for streams started inside; the caller's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
