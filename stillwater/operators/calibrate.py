"""False-alarm curves and the thresholds that keep a rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate_curve(counts: DataFrame, hours: DataFrame, by: list[str]) -> DataFrame:
    """Alarms per hour for each group and threshold; thresholds without alarms stay in as zero."""
    return counts.join(F.broadcast(hours), by).withColumn("far_h", F.try_divide(F.col("n_episodes"), F.col("hours")))


def calibrate(curve: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """For each target the smallest threshold whose rate is at or below it; no row where none is.  The curve may rise again."""
    ok = curve.join(F.broadcast(targets), F.col("far_h") <= F.col("target"))
    best = F.min(F.struct("threshold", "far_h", "n_episodes"))
    return ok.groupBy(*by, "target").agg(best.alias("b")).select(*by, "target", "b.threshold", F.col("b.far_h").alias("achieved"), F.col("b.n_episodes").alias("n_episodes"))


def matched(curve: DataFrame, by: list[str], value: str, targets: DataFrame) -> DataFrame:
    """For each target the threshold whose value is nearest, the smallest among equals."""
    near = curve.crossJoin(F.broadcast(targets)).groupBy(*by, "target").agg(F.min(F.struct(F.abs(F.col(value) - F.col("target")).alias("d"), "threshold", F.col(value).alias("v"))).alias("b"))
    return near.select(*by, "target", "b.threshold", F.col("b.v").alias(value))


def replicate_weights(keys: DataFrame, key: Column, reps: int) -> DataFrame:
    """Bootstrap weights: for each replicate a Poisson(1) draw for each key, from a hash, so that all uses share the draws."""
    rows = keys.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("rep").cast("string"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    # distribution function of Poisson(1) at 0, 1, ...
    steps, term, total = [], 0.36787944117144233, 0.0
    for i in range(9):
        total += term
        steps.append(total)
        term /= i + 1
    return rows.withColumn("weight", sum(((u >= F.lit(s)).cast("int") for s in steps), F.lit(0)))
