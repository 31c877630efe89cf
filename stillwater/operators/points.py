"""Operating points: thresholds as a table, runs judged at all of them at once, and the tables that set them side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequence import first_fire, with_streak


def share_thresholds(rows: DataFrame, by: list[str], score: str, grid: list[int], targets: dict[str, float]) -> DataFrame:
    """For each group and named target the smallest threshold of the grid that at most that share of the rows reaches.

    Rows are counted by the highest threshold they reach, so the grid meets one row for each group and step.
    """
    spark = rows.sparkSession
    reached = rows.select(*by, F.array_max(F.filter(F.array(F.lit(-1), *map(F.lit, grid)), lambda t: t <= F.col(score))).alias("step"))
    counts = reached.groupBy(*by, "step").agg(F.count("*").alias("n"))
    steps = counts.select(*by, "step", "n", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    share = steps.groupBy(*by, "threshold").agg((F.sum(F.when(F.col("step") >= F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    points = F.broadcast(spark.createDataFrame(list(targets.items()), "point string, target double"))
    return share.join(points, F.col("share") <= F.col("target")).groupBy(*by, "point").agg(F.min("threshold").alias("threshold"))


def complete(points: DataFrame, of: str, n: int) -> DataFrame:
    """The operating points that all ``n`` values of ``of`` have; the others are left out whole."""
    full = points.groupBy("point").agg(F.count_distinct(of).alias("_n")).filter(F.col("_n") >= n)
    return points.join(F.broadcast(full), "point", "left_semi")


def runs_at_points(rows: DataFrame, points: DataFrame, on: list[str], run: list[str], order: list[str], score: str, time: str, onset: str, k: int) -> DataFrame:
    """One row for each run and operating point: the thresholds are met by ``on`` (a model, or a model and a configuration) in a broadcast join."""
    met = rows.join(F.broadcast(points), on)
    streaks = with_streak(met, [*run, "point"], order, F.col(score) >= F.col("threshold"))
    return first_fire(streaks, [*run, "point"], time, onset, k)


def side_by_side(rows: DataFrame, by: list[str], points: list[str], value: Column) -> DataFrame:
    """One row a group, one column for each operating point."""
    return rows.groupBy(*by).pivot("point", points).agg(value)


def point_target(point: str) -> Column:
    """The number in the name of an operating point: ``op60`` is 60.0."""
    return F.regexp_replace(point, "^[a-z]+", "").cast("double")


def layers_and_pooled(rows: DataFrame, layer: str, order: list[str], mixed: dict[str, list[str]]) -> DataFrame:
    """The rows once under their layer, once under POOLED and once under each mixed layer that has it, with the layer's place in ``order``."""
    labelled = rows.withColumn("layer", F.col(layer))
    for name, of in mixed.items():
        labelled = labelled.unionByName(rows.filter(F.col(layer).isin(of)).withColumn("layer", F.lit(name)))
    labelled = labelled.unionByName(rows.withColumn("layer", F.lit("POOLED")))
    return labelled.withColumn("place", F.array_position(F.array(*map(F.lit, [*order, *mixed, "POOLED"])), F.col("layer")))


def onset_reason(start: Column, n: Column, least: int, tail: int) -> Column:
    """Why an onset can't be used: null if it can."""
    return F.when(start.isNull(), "no onset").when(start < least, "too early").when(start >= n - tail, "too late")


def keyed_agreement(a: DataFrame, b: DataFrame, on: list[str], by: list[str], x: str, y: str, limit: float) -> DataFrame:
    """Score agreement of two sources that share keys: rows, mean and largest absolute difference, and whether the largest is below ``limit``."""
    d = F.abs(F.col(x) - F.col(y))
    out = a.join(b, on).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(d), 9).alias("mean_abs"), F.round(F.max(d), 9).alias("max_abs"))
    return out.withColumn("passed", F.col("max_abs") < limit)
