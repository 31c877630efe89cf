"""Rules over ordered observations of a key: streaks, alarms, episodes, thresholds all at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .survival import running


def with_streak(df: DataFrame, key: list[str], order: list[str], cond: Column, out: str = "streak", among: Column | None = None) -> DataFrame:
    """Count the consecutive rows that meet ``cond`` up to each row; 0 where it fails.  A null condition fails.

    With ``among`` (never null) the rows that don't meet it have 0 and break no streak.
    """
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    number = F.row_number() if among is None else F.count_if(among)
    among = F.lit(True) if among is None else among
    df = df.withColumn("_q", F.coalesce(cond, F.lit(False))).withColumn("_n", number.over(w))
    failed = F.coalesce(F.max(F.when(among & ~F.col("_q"), F.col("_n"))).over(w), F.lit(0))
    return df.withColumn(out, F.when(among, F.col("_n") - failed).otherwise(0).cast("long")).drop("_q", "_n")


def episodes(df: DataFrame, key: list[str], order: list[str], cond: Column, k: int) -> DataFrame:
    """Maximal streaks of length ``k`` or more for each key, zeros included: ``n_episodes``."""
    return with_streak(df, key, order, cond).groupBy(*key).agg(F.count_if(F.col("streak") == k).alias("n_episodes"))


def first_fires(time: str, onset: str, k: int) -> list[Column]:
    """The aggregates of ``first_fire``."""
    fired = F.col("streak") >= k
    return [
        F.min(F.when(fired & (F.col(time) >= F.col(onset)), F.col(time))).alias("t_fire"),
        F.coalesce(F.bool_or(fired & (F.col(time) < F.col(onset))), F.lit(False)).alias("fp_pre"),
        F.min(F.when(F.col("streak") == k, F.col(time))).alias("t_single_shot"),
        F.min(F.when((F.col("streak") >= 1) & (F.col(time) >= F.col(onset)), F.col(time))).alias("t_first_detection"),
        F.max(onset).alias("t_onset"),
        F.max(time).alias("t_last"),
        F.count_if(F.col(time) >= F.col(onset)).alias("n_post"),
        F.count_if((F.col(time) >= F.col(onset)) & (F.col("streak") >= 1)).alias("n_qualifying_post"),
    ]


def first_fire(df: DataFrame, key: list[str], time: str, onset: str, k: int) -> DataFrame:
    """Alarm of each key from a ``streak`` column: first time at or after the onset, and whether one fired before it."""
    return df.groupBy(*key).agg(*first_fires(time, onset, k))


def windowed_fire(df: DataFrame, key: list[str], order: list[str], time: str, onset: str, cond: Column, k: int, width: int) -> DataFrame:
    """First time at or after the onset with ``k`` qualifying rows within ``width`` (inclusive); earlier rows count."""
    w = Window.partitionBy(*key).orderBy(*order)
    hit = df.filter(cond).withColumn("_from", F.lag(time, k - 1).over(w)).filter((F.col(time) - F.col("_from") <= width) & (F.col(time) >= F.col(onset)))
    return df.select(*key).distinct().join(hit.groupBy(*key).agg(F.min(time).alias("t_window")), key, "left")


def rolling_min(df: DataFrame, key: list[str], order: list[str], score: str, k: int, out: str = "level") -> DataFrame:
    """The highest threshold at which a row fires: the least of the last ``k`` scores, null for the first rows.

    A row has ``k`` scores above t in a row exactly if this value is t or more, so
    one pass answers every threshold.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(out, F.when(F.row_number().over(w) >= k, F.min(score).over(w.rowsBetween(-(k - 1), 0))))


def episodes_by_threshold(df: DataFrame, by: list[str], key: list[str], order: list[str], score: str, k: int, grid: DataFrame) -> DataFrame:
    """Episodes for every threshold of ``grid`` (column ``threshold``, whole numbers) from one pass over the rows.

    A row whose level rises from a to b opens one episode at each threshold in
    (a, b].  These intervals are counted by their ends first, so the join with
    the grid sees few rows: pairs of distinct levels, not observations.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    level = F.coalesce("level", F.lit(-1))
    prev = F.coalesce(F.lag("level").over(w), F.lit(-1))
    steps = rolling_min(df, key, order, score, k).withColumn("_before", prev).withColumn("_level", level)
    rises = steps.filter(F.col("_level") > F.col("_before")).groupBy(*by, "_before", "_level").agg(F.count("*").alias("_n"))
    groups = df.select(*by).distinct().crossJoin(F.broadcast(grid))
    t = F.col("threshold")
    counted = rises.join(F.broadcast(grid), (t > F.col("_before")) & (t <= F.col("_level"))).groupBy(*by, "threshold").agg(F.sum("_n").alias("n_episodes"))
    return groups.join(counted, [*by, "threshold"], "left").fillna(0, ["n_episodes"])


def alarms_by_threshold(df: DataFrame, key: list[str], order: list[str], score: str, time: str, onset: str, k: int, grid: DataFrame) -> DataFrame:
    """Hit, false alarm and time of the alarm of each key for every threshold, from one pass.

    Only rows where the running maximum of the level breaks its record matter
    for the time of the alarm; these few meet the grid.
    """
    level = rolling_min(df, key, order, score, k)
    per_key = level.groupBy(*key).agg(F.max(F.when(F.col(time) >= F.col(onset), F.col("level"))).alias("_hit"), F.max(F.when(F.col(time) < F.col(onset), F.col("level"))).alias("_fp"))
    w = Window.partitionBy(*key).orderBy(*order)
    after = level.filter((F.col(time) >= F.col(onset)) & F.col("level").isNotNull())
    best = F.max("level").over(w.rowsBetween(Window.unboundedPreceding, -1))
    records = after.withColumn("_best", F.coalesce(best, F.lit(-1))).filter(F.col("level") > F.col("_best"))
    t = F.col("threshold")
    fired = records.join(F.broadcast(grid), (t > F.col("_best")) & (t <= F.col("level"))).select(*key, "threshold", F.col(time).alias("t_fire"))
    every = per_key.crossJoin(F.broadcast(grid))
    return every.join(fired, [*key, "threshold"], "left").select(*key, "threshold", F.coalesce(F.col("_hit") >= t, F.lit(False)).alias("hit"), F.coalesce(F.col("_fp") >= t, F.lit(False)).alias("fp_pre"), "t_fire")


def every_nth(df: DataFrame, key: list[str], order: list[str], step: int) -> DataFrame:
    """Every ``step``-th row of each key, from the first: a lower frame rate."""
    if step == 1:
        return df
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w) - 1).filter(F.col("_n") % step == 0).drop("_n")


def matched(df: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Left join by columns of the same name, where nulls are equal; the table's copies of them are dropped."""
    right = table.withColumnsRenamed({c: f"_on_{c}" for c in on})
    return df.join(right, [df[c].eqNullSafe(right[f"_on_{c}"]) for c in on], "left").drop(*(f"_on_{c}" for c in on))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal content the first stays: adds ``kept`` and the number of rows alike as ``n_alike``.

    The first of each content is an aggregate, so copies of one content are
    never in one task; only rows that are equal in ``order`` too are numbered.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("n_alike"))
    alike = Window.partitionBy(*key, *order).orderBy(*order)
    found = matched(df, first, key).withColumn("kept", F.col("_first").eqNullSafe(F.struct(*order)) & (F.row_number().over(alike) == 1))
    return found.select(*df.columns, "kept", "n_alike")


def average_ranks(df: DataFrame, by: list[str], col: str, out: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean.

    The window runs over the distinct values with their counts; the rows meet
    their rank in a join.
    """
    counts = df.groupBy(*by, col).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(col))
    ranks = counts.select(*by, col, (upto - (F.col("_n") - 1) / 2).alias(out))
    return matched(df, ranks, [*by, col])


def ecdf(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Share of rows at or below each value."""
    return df.withColumn("share", F.cume_dist().over(Window.partitionBy(*by).orderBy(col)))


def evenly_spaced(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """``k`` rows of each group at even distances, all if there are no more; the middle one for k = 1."""
    w = Window.partitionBy(*by)
    rows = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    # round half to even, as the positions are defined
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(float(max(k - 1, 1)))).cast("long"))
    at = at if k > 1 else F.array(F.floor((F.col("_n") - 1) / 2))
    return rows.filter((F.col("_n") <= k) | F.array_contains(at, F.col("_i").cast("long"))).drop("_i", "_n")


def stride_slice(df: DataFrame, order: list[str], index: int, stride: int, by: list[str]) -> DataFrame:
    """Rows index, index + stride, ... of each group in the given order (unique in a group), numbered over range partitions."""
    rows = running(df.withColumn("_n", F.lit(1).cast("long")), by, order, ["_n"])
    return rows.filter((F.col("_n") > index) & ((F.col("_n") - 1 - index) % stride == 0)).drop("_n")


def regime_from_first(df: DataFrame, by: list[str], time: str, event: Column, before: str, after: str) -> DataFrame:
    """Tag rows of a group from its first event onwards as ``after``, earlier ones (all, without an event) as ``before``."""
    first = F.min(F.when(event, F.col(time))).over(Window.partitionBy(*by))
    return df.withColumn("regime", F.when(F.col(time) >= first, after).otherwise(before))


def holm(df: DataFrame, by: list[str], p: str, ties: list[str]) -> DataFrame:
    """Step-down adjusted p values and Bonferroni's, within each group of tests; null p values are not tests."""
    w = Window.partitionBy(*by)
    order = w.orderBy(F.asc_nulls_last(p), *ties)
    df = df.withColumn("_m", F.count(p).over(w)).withColumn("_step", (F.col("_m") - F.row_number().over(order) + 1) * F.col(p))
    upto = F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"p_holm": F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), upto)), "p_bonferroni": F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_m")))}).drop("_m", "_step")
