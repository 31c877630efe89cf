"""Runs beside their traces, their repetitions and their baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def switched(sources: dict[str, DataFrame], chosen: DataFrame, by: list[str]) -> DataFrame:
    """Of several score sources the rows of the one that ``chosen`` (``by`` and ``variant``, a row for each group) names for their group.

    ``variant`` tells the source; groups that ``chosen`` doesn't have are left out.
    """
    tagged = [df.withColumn("variant", F.lit(name)) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, tagged).join(chosen, [*by, "variant"])


def traces_of_runs(traces: DataFrame, runs: DataFrame, run: str, *columns: str) -> DataFrame:
    """The traces of the runs given, with the named columns of the run; traces of other runs go."""
    return traces.join(runs.select(run, *columns), run)


def beside(frozen: DataFrame, rerun: DataFrame, run: str, frames: str, columns: list[str]) -> DataFrame:
    """Runs that both tables have with at least one frame on either side; the rerun's columns end in ``_rerun``."""
    again = rerun.filter(F.col(frames) > 0).select(run, *(F.col(c).alias(f"{c}_rerun") for c in columns))
    return frozen.filter(F.col(frames) > 0).join(again, run)


def own_only(seen: Column, own: Column) -> Column:
    """Whether an array names nothing but ``own``: null (unknown) for a null array, a null ``own`` or a null among the rest, true for an empty array."""
    return ~F.exists(seen, lambda x: x != own)


def robust(rows: DataFrame, by: list[str], shift: str, baseline: Column, side: str, significant: str) -> DataFrame:
    """For each group, whether every shift keeps the baseline's side and its significance, and how many shifts there are."""
    base = rows.filter(F.col(shift) == baseline).select(*by, F.col(side).alias("_side"), F.col(significant).alias("_significant"))
    moved = rows.filter(F.col(shift) != baseline).join(base, by)
    kept = F.col(side).eqNullSafe(F.col("_side")) & F.col(significant).eqNullSafe(F.col("_significant"))
    return moved.groupBy(*by).agg(F.count("*").alias("n_shifts"), F.bool_and(kept).alias("robust"))
