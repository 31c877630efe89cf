"""Data-quality audits: reconciliation, completeness, disjointness, agreement of score sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(a: DataFrame, b: DataFrame, key: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """Compare two tables by key: ``status`` ok, mismatch, missing (only in a) or extra (only in b); nulls equal each other."""
    left = a.select(*key, *(F.col(v).alias(f"{v}_a") for v in values), F.lit(True).alias("_a"))
    right = b.select(*key, *(F.col(v).alias(f"{v}_b") for v in values), F.lit(True).alias("_b"))
    same = F.lit(True)
    for v in values:
        x, y = F.col(f"{v}_a"), F.col(f"{v}_b")
        close = x.eqNullSafe(y) if not tolerance else x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        same = same & close
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(same, "ok").otherwise("mismatch")
    return left.join(right, key, "full_outer").withColumn("status", status).drop("_a", "_b")


def require_equal(diff: DataFrame) -> None:
    """Stop with the first rows of a reconciliation that are not ok."""
    if bad := diff.filter("status <> 'ok'").take(10):
        raise ValueError(f"tables differ, first rows: {bad}")


def join_equal_counts(a: DataFrame, b: DataFrame, key: list[str], n: str) -> DataFrame:
    """Two tables of the same cells side by side, columns of the second suffixed ``_b``; cells that one lacks or whose ``n`` differs are an error."""
    right = b.select(*key, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in key), F.lit(True).alias("_b"))
    met = a.withColumn("_a", F.lit(True)).join(right, key, "full_outer")
    if bad := met.filter(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col(n).eqNullSafe(F.col(f"{n}_b"))).select(*key, n, f"{n}_b").take(5):
        raise ValueError(f"cells with unequal counts: {bad}")
    return met.drop("_a", "_b", f"{n}_b")


def overlap(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys that both tables have; empty if they are disjoint."""
    return a.select(*on).distinct().join(b.select(*on), on, "left_semi")


def completeness(expected: DataFrame, facts: DataFrame, key: list[str], expected_n: str, share: float = 0.99) -> DataFrame:
    """Status of each expected key: missing, short (fewer than the share of its rows) or complete."""
    found = facts.groupBy(*key).agg(F.count("*").alias("n_found"))
    out = expected.select(*key, expected_n).join(found, key, "left").fillna(0, ["n_found"])
    return out.withColumn("status", F.when(F.col("n_found") == 0, "missing").when(F.col("n_found") < share * F.col(expected_n), "short").otherwise("complete"))


def positional_agreement(a: DataFrame, b: DataFrame, by: list[str], order: list[str], score: str, levels: list[float]) -> DataFrame:
    """Compare two ordered score sequences place by place up to the shorter one."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = a.withColumn("_n", F.row_number().over(w)).select(*by, "_n", F.col(score).alias("_a"))
    y = b.withColumn("_n", F.row_number().over(w)).select(*by, "_n", F.col(score).alias("_b"))
    d = F.abs(F.col("_a") - F.col("_b"))
    agree = [F.avg(((F.col("_a") >= t) == (F.col("_b") >= t)).cast("int")).alias(f"agree_{i}") for i, t in enumerate(levels)]
    return x.join(y, [*by, "_n"]).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), *agree)


def drift(actual: Column, expected: Column) -> Column:
    """From two version maps the entries that differ; entries that were not expected are unknown and left out."""
    both = F.map_zip_with(actual, expected, lambda _, x, y: F.when(y.isNotNull() & ~x.eqNullSafe(y), F.struct(x.alias("actual"), y.alias("expected"))))
    return F.map_filter(both, lambda _, v: v.isNotNull())


def exclude(df: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Drop the rows of listed cells; a listed cell that matches nothing is an error."""
    lost = cells.join(df.select(*on).distinct(), on, "left_anti").take(5)
    if lost:
        raise ValueError(f"excluded cells that match no row: {lost}")
    return df.join(F.broadcast(cells.select(*on).distinct()), on, "left_anti")


def new_keys(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key has not been written yet."""
    return df.join(done.select(*on), on, "left_anti")


def copy_pairs(manifest: DataFrame, content: list[str], name: str) -> DataFrame:
    """The two names ``a < b`` of every content that exactly two entries have; nulls are no content."""
    some = manifest.dropna(subset=[*content, name])
    return some.groupBy(*content).agg(F.count("*").alias("_n"), F.min(name).alias("a"), F.max(name).alias("b")).filter("_n = 2 and a < b").select("a", "b")


def trace_identity(traces: DataFrame, pairs: DataFrame, name: str, by: list[str], order: list[str], score: str) -> DataFrame:
    """Traces of two copies frame by frame: ``a, b, by, n_a, n_b, identical, worst``.

    Frames meet by their place in the trace; ``worst`` is the largest
    difference of the places that both have.  Traces are identical if they
    are as long and nowhere differ (two null scores are equal).  Pairs of
    which a copy has no trace are left out.
    """
    side = lambda c: pairs.select(F.col(c).alias(name)).distinct()
    wanted = traces.join(side("a").unionByName(side("b")).distinct(), name, "left_semi")
    w = Window.partitionBy(*by, name)
    ranked = wanted.withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)}).select(*by, name, "_i", "_n", F.col(score).alias("_s"))
    x = pairs.join(ranked.withColumnsRenamed({name: "a", "_n": "n_a", "_s": "_sa"}), "a")
    y = ranked.withColumnsRenamed({name: "b", "_n": "n_b", "_s": "_sb"})
    met = x.join(y, [*by, "b", "_i"])
    out = met.groupBy("a", "b", *by).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.bool_and(F.col("_sa").eqNullSafe(F.col("_sb"))).alias("_same"), F.max(F.abs(F.col("_sa") - F.col("_sb"))).alias("worst"))
    return out.withColumn("identical", F.col("_same") & (F.col("n_a") == F.col("n_b"))).drop("_same")


def copy_disagreement(decisions: DataFrame, pairs: DataFrame, name: str, by: list[str], value: str) -> DataFrame:
    """Decisions of two copies under the same conditions: ``a, b, by, disagree``."""
    x = pairs.join(decisions.select(*by, F.col(name).alias("a"), F.col(value).alias("_va")), "a")
    return x.join(decisions.select(*by, F.col(name).alias("b"), F.col(value).alias("_vb")), ["b", *by]).select("a", "b", *by, (~F.col("_va").eqNullSafe(F.col("_vb"))).alias("disagree"))
