"""Alarm rules on streams; the same answers as on tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key long, t long, rule string"


def rule_times(ok: np.ndarray, t: np.ndarray, k: int, width: int, streak: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Times of episodes and of windows in new observations in order, with the streak and the last qualifying times to carry on.

    ``streak`` and ``last`` are what earlier observations left behind.
    """
    n = np.arange(len(ok))
    failed = np.maximum.accumulate(np.where(ok, -1, n)) if len(ok) else n
    run = np.where(ok, n - failed + np.where(failed < 0, streak, 0), 0)
    met = np.concatenate([last, t[ok]])
    back = np.full(len(met), np.iinfo(np.int64).min)
    if k <= len(met):
        back[k - 1 :] = met[: len(met) - k + 1]
    new = np.arange(len(met)) >= len(last)
    inside = new & (np.arange(len(met)) >= k - 1) & (met - np.where(back < 0, 0, back) <= width)
    return t[run == k], met[inside], int(run[-1]) if len(ok) else streak, met[-k:]


def _rules(k: int, width: int):
    """The new observations of a key at once: state is the streak, whether it has fired, and the last qualifying times."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, fired, last = state.get if state.exists else (0, False, [])
        rows = pd.concat(list(frames)).sort_values(["t", "seq"], kind="stable")
        episodes, windows, streak, last = rule_times(rows["ok"].to_numpy(bool), rows["t"].to_numpy(np.int64), k, width, streak, np.asarray(last, np.int64))
        first = episodes[: 0 if fired else 1]
        state.update((streak, bool(fired or len(first)), [int(x) for x in last]))
        times = {"episode": episodes, "first": first, "window": windows}  # re-armed, single shot, k within the width
        yield pd.DataFrame({"key": np.full(sum(map(len, times.values())), key[0], np.int64), "t": np.concatenate([*times.values()]), "rule": np.repeat([*times], [*map(len, times.values())])})

    return run


def alarm_stream(df: DataFrame, key: str, time: str, seq: str, cond, k: int = 3, width: int = 0) -> DataFrame:
    """Alarms of a stream: ``rule`` is first (single shot), episode (re-arming) or window (``k`` within ``width``).

    Observations of one key must not arrive before those of earlier batches;
    within a batch they are sorted by ``time`` and ``seq``.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(time).cast("long").alias("t"), F.col(seq).cast("long").alias("seq"), F.coalesce(cond, F.lit(False)).alias("ok"))
    return rows.groupBy("key").applyInPandasWithState(_rules(k, width), OUT, "streak long, fired boolean, last array<long>", "append", GroupStateTimeout.NoTimeout)


def loss_stream(df: DataFrame, key: str, time: str, dropped, delay: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Frames and drops by key and time span; late data up to ``delay`` count."""
    w = df.withWatermark(time, delay).groupBy(F.window(time, span), key)
    return w.agg(F.count("*").alias("n"), F.count_if(dropped).alias("n_drops")).select(F.col("window.start").alias("start"), key, "n", "n_drops")


def replay_safe(df: DataFrame, key: str, seq: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Drop observations that a source sends again within ``delay``; what is older leaves the state."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key, seq])


def finished_runs(stream: DataFrame, run: str, ended: Column, summary: list[Column], at: str) -> DataFrame:
    """Aggregate the finished runs of a stream, which may be done again while more records come in.

    The state of a run is its partial aggregates, to which each micro-batch
    adds; no record is read twice.  The rows of the runs that a batch touches
    and that have an end are written to the shared folder ``at`` under its
    number, so a batch that is done twice replaces itself; of the rows of a
    run the one of the latest batch counts.  Runs without an end and records
    without a run are left out; a stream without records gives an empty table.
    """
    spark = stream.sparkSession
    state = stream.filter(F.col(run).isNotNull()).groupBy(run).agg(F.bool_or(F.coalesce(ended, F.lit(False))).alias("_done"), *summary)
    schema = state.drop("_done").schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{at}/runs/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        batch.filter("_done").drop("_done").write.mode("overwrite").parquet(f"{at}/runs/batch={number}")

    q = state.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).parquet(f"{at}/runs")
    latest = rows.groupBy(run).agg(F.max("batch").alias("batch"))
    return rows.join(latest, [run, "batch"]).drop("batch")


def timeout_misses(onsets: DataFrame, alarms: DataFrame, run: str, onset: str, alarm: str, timeout: str, delay: str = "1 hour") -> DataFrame:
    """Onsets (``run, onset, t_miss``) that no alarm of their run follows within ``timeout``, for streams and tables alike.

    A stream gives a miss once both watermarks (``delay`` behind the latest onset
    and alarm) have passed its end, ``t_miss``; only then its state goes.  An alarm at the
    onset or at the end itself counts, one before the onset does not.  Rows
    with a null run or time take no part.
    """
    o = onsets.select(F.col(run).alias("run"), F.col(onset).alias("onset")).dropna().withWatermark("onset", delay)
    a = alarms.select(F.col(run).alias("of"), F.col(alarm).alias("alarm")).dropna().withWatermark("alarm", delay)
    end = F.col("onset") + F.expr(f"interval {timeout}")
    met = o.join(a, (F.col("run") == F.col("of")) & (F.col("alarm") >= F.col("onset")) & (F.col("alarm") <= end), "left_outer")
    return met.filter(F.col("of").isNull()).select("run", "onset", end.alias("t_miss"))
