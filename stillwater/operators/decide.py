"""Decisions on top of statistics and between sources: adjusted p values, agreement of annotators and traces, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bonferroni(df: DataFrame, p: str, alpha: float = 0.05, every_row: bool = False) -> DataFrame:
    """Add ``p_bonferroni`` and ``significant`` over all rows of a table of tests.

    Null p values are not tests; with ``every_row`` they count as comparisons
    all the same, and are not significant.
    """
    tests = F.broadcast(df.agg((F.count("*") if every_row else F.count(p)).alias("_m")))  # one row
    out = df.crossJoin(tests).withColumn("p_bonferroni", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.col("_m"))))
    significant = F.col("p_bonferroni") < alpha
    return out.withColumn("significant", F.coalesce(significant, F.lit(False)) if every_row else significant).drop("_m")


def serial_client(df: DataFrame, transfer: str, infer: str, post: str, period: str | Column) -> DataFrame:
    """Add ``cycle`` and ``predicted``, the share of frames that a client without a queue loses; null parts count 0."""
    cycle = sum((F.coalesce(c, F.lit(0.0)) for c in (infer, post)), F.coalesce(transfer, F.lit(0.0)))
    span = F.col(period) if isinstance(period, str) else period
    return df.withColumn("cycle", cycle).withColumn("predicted", F.when(F.col("cycle") > span, 1 - span / F.col("cycle")).otherwise(0.0))


def annotator_agreement(a: DataFrame, b: DataFrame, key: str, usable: str, onset: str, by: list[str], within: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Two annotators on common keys: agreement on usability, and of those usable to both the onset differences ``b - a``.

    ``median_abs`` is the upper median: the element at place n // 2 from 0.
    """
    x = a.select(key, *by, F.col(usable).alias("_ua"), F.col(onset).alias("_oa"))
    y = b.select(key, F.col(usable).alias("_ub"), F.col(onset).alias("_ob"))
    met = x.join(y, key).withColumn("_both", F.col("_ua") & F.col("_ub"))
    d = F.when(F.col("_both"), F.col("_ob") - F.col("_oa"))
    met = met.withColumns({"_d": d, "_abs": F.abs(d)})
    # upper median by counts of equal differences, so a group is never held whole
    counts = met.filter(F.col("_abs").isNotNull()).groupBy(*by, "_abs").agg(F.count("*").alias("_n"))
    run, whole = Window.partitionBy(*by).orderBy("_abs"), Window.partitionBy(*by)
    counts = counts.withColumns({"_to": F.sum("_n").over(run), "_all": F.sum("_n").over(whole)})
    median = counts.filter(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min("_abs").alias("median_abs"))
    near = [F.avg((F.col("_abs") <= w).cast("int")).alias(f"within_{w}") for w in within]
    out = met.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col("_ua") == F.col("_ub")).cast("int")).alias("same_usable"),
        F.count_if("_both").alias("n_both"),
        F.avg("_abs").alias("mean_abs"),
        F.max("_abs").alias("max_abs"),
        F.avg("_d").alias("bias"),
        *near,
    )
    return out.join(median, by, "left")


def align(a: DataFrame, b: DataFrame, by: list[str], order: list[str], score: str, offsets: range, threshold: float) -> DataFrame:
    """Lay sequence ``b`` on ``a`` at the offset with the smallest mean absolute difference; the nearest to 0, then the smaller, among equals.

    Returns ``offset, n, mae, r, agree`` for each key; each row of ``b`` meets one row of ``a`` for each offset.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    x = a.withColumn("_i", F.row_number().over(w)).select(*by, "_i", F.col(score).alias("_a"))
    y = b.withColumn("_i", F.row_number().over(w)).select(*by, F.col("_i").alias("_j"), F.col(score).alias("_b"))
    y = y.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).withColumn("_i", F.col("_j") + F.col("offset"))
    same = ((F.col("_a") >= threshold) == (F.col("_b") >= threshold)).cast("int")
    each = x.join(y, [*by, "_i"]).groupBy(*by, "offset").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("_a") - F.col("_b"))), 9).alias("mae"), F.corr("_a", "_b").alias("r"), F.avg(same).alias("agree"))
    best = F.min(F.struct("mae", F.abs("offset").alias("far"), "offset", "n", "r", "agree"))
    return each.groupBy(*by).agg(best.alias("b")).select(*by, "b.offset", "b.n", "b.mae", "b.r", "b.agree")


def first_category(text: str | Column, rules: dict[str, str], other: str = "other") -> Column:
    """The name of the first pattern that a log's text contains; null text has none of them."""
    out = F.lit(other)
    for name, pattern in reversed(rules.items()):
        out = F.when(F.regexp_like(text, F.lit(pattern)), name).otherwise(out)
    return out


def first_line_category(lines: DataFrame, by: list[str], text: str, rules: dict[str, str], other: str = "other") -> DataFrame:
    """The category of each log: the first rule whose pattern some line contains; logs are lines, so one of any length is spread."""
    names = [*rules, other]
    at = F.lit(len(rules))
    for i, pattern in reversed([*enumerate(rules.values())]):
        at = F.when(F.regexp_like(text, F.lit(pattern)), i).otherwise(at)
    found = lines.groupBy(*by).agg(F.count("*").alias("n_lines"), F.min(at).alias("_at"))
    return found.select(*by, "n_lines", F.get(F.array(*map(F.lit, names)), F.col("_at")).alias("category"))


def failed_runs(runs: DataFrame, records: DataFrame, key: list[str], bad: Column) -> DataFrame:
    """Whether any record of a run is bad (null is not); a run without a record has failed, records of other runs don't count."""
    found = records.groupBy(*key).agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("failed"), F.count("*").alias("n_records"))
    out = runs.select(*key).distinct().join(found, key, "left")
    return out.select(*key, F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("failed", F.lit(True)).alias("failed"))


def start_rates(df: DataFrame, by: list[str], time_s: Column) -> DataFrame:
    """Starts per hour between the first and the last start of each group; null for a single start."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), (F.max(time_s) - F.min(time_s)).alias("span_s"))
    return out.withColumn("per_hour", F.when(F.col("span_s") > 0, F.col("n") * 3600.0 / F.col("span_s")))


def moved_rows(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Two versions of a curve by key: old and new value and whether the row moved; two nulls are equal."""
    met = a.select(*key, F.col(value).alias("old")).join(b.select(*key, F.col(value).alias("new")), key)
    return met.withColumn("moved", ~F.col("old").eqNullSafe(F.col("new")))


def homogeneous(df: DataFrame, by: list[str], columns: list[str], ended: Column) -> DataFrame:
    """Gate of a frozen data set: how many values each column has (nulls count as one), groups without an end, and whether all is uniform."""
    values = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n_{c}") for c in columns]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(ended, F.lit(False))).alias("n_open"), *values)
    ok = F.col("n_open") == 0
    for c in columns:
        ok = ok & (F.col(f"n_{c}") == 1)
    return out.withColumn("passed", ok)


def one_sided_pair_p(t_low: Column, t_high: Column, two_sided_low: Column, two_sided_high: Column) -> Column:
    """p of the two one-sided tests: the larger of the tails above ``t_low`` and below ``t_high``, from their two-sided tails."""
    low = F.when(t_low > 0, two_sided_low / 2).otherwise(1 - two_sided_low / 2)
    high = F.when(t_high < 0, two_sided_high / 2).otherwise(1 - two_sided_high / 2)
    return F.greatest(low, high)


def tier(df: DataFrame, duration: str, least: float, below: float, within: dict[str, list]) -> DataFrame:
    """Rows of a tier: ``least <= duration < below`` and each column of ``within`` among its values; a value that no row has is an error."""
    for column, values in within.items():
        found = {r[0] for r in df.filter(F.col(column).isin(values)).select(column).distinct().collect()}  # at most the values asked for
        if lost := [v for v in values if v not in found]:
            raise ValueError(f"unknown {column}: {lost}")
        df = df.filter(F.col(column).isin(values))
    return df.filter((F.col(duration) >= least) & (F.col(duration) < below))


def by_stem(a: DataFrame, b: DataFrame, name_a: str, name_b: str, suffix: str = r"\.[^./]*$") -> DataFrame:
    """Join two lists of names that are equal without their suffix: an equality in place of a prefix test."""
    x = a.withColumn("stem", F.regexp_replace(name_a, suffix, ""))
    y = b.withColumn("stem", F.regexp_replace(name_b, suffix, ""))
    return x.join(y, "stem")


def regime_shift(df: DataFrame, cell: list[str], regime: str, metric: str, before: str, after: str) -> DataFrame:
    """Mean of a metric in two regimes of each cell and their difference; cells that lack one of them are left out."""
    one = lambda r: F.when(F.col(regime) == r, F.col(metric))
    out = df.groupBy(*cell).agg(F.count(one(before)).alias("n_before"), F.count(one(after)).alias("n_after"), F.avg(one(before)).alias("mean_before"), F.avg(one(after)).alias("mean_after"))
    return out.filter("n_before > 0 and n_after > 0").withColumn("shift", F.col("mean_after") - F.col("mean_before"))


def by_prefix(names: DataFrame, stems: DataFrame, name: str, stem: str) -> DataFrame:
    """Every name with every stem that it begins with: an equality on prefixes in place of a test of all pairs.

    A name is cut to the lengths that stems have (found by an aggregate) and
    meets the stems by value.  Empty and null stems match nothing.
    """
    some = stems.filter(F.length(stem) > 0)
    lengths = F.broadcast(some.agg(F.sort_array(F.collect_set(F.length(stem))).alias("_lengths")))  # one row, as many numbers as lengths
    cut = names.crossJoin(lengths).withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length(name)))).drop("_lengths")
    return cut.withColumn("_cut", F.substring(F.col(name), F.lit(1), F.col("_n"))).join(some, F.col("_cut") == F.col(stem)).drop("_cut", "_n")
