"""The given tables seen as runs, frames and corpora."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Reference instant in nanoseconds: 2024-01-15 UTC.
ONSET_NS = 1705276800000000000
THRESHOLD, K = 60.0, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, rows: int = 250_000) -> int:
    """As many partitions as it takes for each to have about ``rows`` rows of a table."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows))


def spread(df: DataFrame, key: list[str], rows: int = 250_000) -> DataFrame:
    """A table's rows brought together by key, over as many partitions as it takes for each to have about ``rows``; what one task holds doesn't grow with the table."""
    return df.repartition(partitions(df, rows), *key)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a run in time order; configuration, model and scenario form a balanced design."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    return e.select(
        u.alias("run_id"),
        F.col("event_id").alias("frame_idx"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t_post"),
        "value",
        F.col("event_type").alias("cls"),
        "props",
        (u % 5).cast("int").alias("config"),
        (F.floor(u / 5) % 3).cast("int").alias("model"),
        F.floor(u / 15).cast("int").alias("scenario"),
    )


def with_onset(df: DataFrame) -> DataFrame:
    """Attach each run's onset: its first observation at or after the reference instant, null if there is none."""
    seen = F.min(F.when(F.col("t_post") >= ONSET_NS, F.col("t_post")))
    return df.withColumn("t_onset", seen.over(Window.partitionBy("run_id")))


def runs(spark: SparkSession, sf_dir: str, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """One row a run: alarm, false alarm before the onset, times in hours, censored duration."""
    from ..operators.sequence import first_fire, with_streak

    f = with_streak(with_onset(frames(spark, sf_dir)), ["run_id"], ["t_post", "frame_idx"], F.col("value") >= threshold)
    r = first_fire(f, ["run_id", "config", "model", "scenario"], "t_post", "t_onset", k)
    h = lambda x: F.round((F.col(x) - F.col("t_onset")) / F.lit(3.6e12), 6)
    hit = F.col("t_fire").isNotNull()
    out = r.withColumns({"hit": hit, "ttd": h("t_fire"), "followup": h("t_last"), "t_first": h("t_first_detection"), "t_single": h("t_single_shot")})
    return out.withColumns({"accum": F.round(F.col("ttd") - F.when(hit, F.col("t_first")), 6), "duration": F.when(hit, F.col("ttd")).otherwise(F.col("followup"))})


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score sequences: a clip is a supplier, a model a return flag, the score 0 to 10."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("clip"), F.col("l_returnflag").alias("model"), F.round(F.col("l_discount") * 100).cast("int").alias("score"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


CORPUS_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
