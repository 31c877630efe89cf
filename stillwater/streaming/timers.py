"""Alarm rules on streams with event-time timers: a run ends when it is silent, emits its miss and leaves the state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .alarms import rule_times

OUT = "key long, t long, rule string"
#: Fixed value: the state store that keeps timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class AlarmRules(StatefulProcessor):
    """State of a run: streak, whether its alarm has fired, the last qualifying times and its latest time; one timer, ``idle`` behind that."""

    def __init__(self, k: int, width: int, idle_ms: int) -> None:
        self.k, self.width, self.idle_ms = k, width, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "streak long, fired boolean, last array<long>, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.run.get()
        streak, fired, last, before = found if found is not None else (0, False, [], None)
        parts = list(rows)
        ok, t, seq = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("ok", "t", "seq"))
        order = np.lexsort((seq, t))  # a null number comes last
        ok, t = ok[order].astype(bool), t[order].astype(np.int64)
        episodes, windows, streak, last = rule_times(ok, t, self.k, self.width, streak, np.asarray(last or [], np.int64))
        first = [] if fired or not len(episodes) else [episodes[0]]
        latest = int(t[-1]) if before is None else max(before, int(t[-1]))
        self.run.update((streak, bool(fired or len(first)), [int(x) for x in last], latest))
        # the one timer of a run follows from its latest time, so it is neither looked up nor set again in vain
        if before is None or self._ends(before) != self._ends(latest):
            if before is not None:
                self.handle.deleteTimer(self._ends(before))
            self.handle.registerTimer(self._ends(latest))
        rule = ["episode"] * len(episodes) + ["first"] * len(first) + ["window"] * len(windows)
        if rule:
            yield pd.DataFrame({"key": np.full(len(rule), key[0], np.int64), "t": np.concatenate([episodes, np.asarray(first, np.int64), windows]), "rule": pd.Series(rule, dtype=object)})

    def _ends(self, latest: int) -> int:
        return latest // 1_000_000 + self.idle_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, fired, _, latest = self.run.get()
        self.run.clear()
        if not fired:
            yield pd.DataFrame({"key": np.array([key[0]], np.int64), "t": np.array([latest], np.int64), "rule": pd.Series(["miss"], dtype=object)})

    def close(self) -> None:
        pass


def timed_alarms(df: DataFrame, key: str, time: str, seq: str, cond: Column, k: int = 3, width: int = 0, idle: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Alarms of a stream and the misses of runs that have ended: ``key, t`` (nanoseconds), ``rule``.

    ``rule`` is episode (re-arming), first (single shot), window (``k``
    qualifying observations within ``width`` nanoseconds) or miss: the run was
    silent for ``idle`` without a first alarm, ``t`` being its last time.
    Observations that are later than ``delay`` are dropped, so a run that
    comes back after its end is a new run.  Rows with a null key or time take
    no part; a null condition fails.  Start the stream inside ``timer_store``.
    """
    at = F.col(time).cast("timestamp")
    rows = df.select(F.col(key).cast("long").alias("key"), at.alias("at"), (F.unix_micros(at) * 1000).alias("t"), F.col(seq).cast("long").alias("seq"), F.coalesce(cond, F.lit(False)).alias("ok"))
    rows = rows.dropna(subset=["key", "at"]).withWatermark("at", delay)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("key").transformWithStateInPandas(AlarmRules(k, width, idle_ms), OUT, "append", "EventTime")
