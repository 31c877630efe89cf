"""Bootstrap by draws with replacement: the draws are a table of weights that every cell shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .survival import cut, rmst, running, weighted_kaplan_meier


def resample(keys: DataFrame, key: str, reps: int) -> DataFrame:
    """``rep, key, weight``: how often each replicate draws a key, as many draws with replacement as there are keys.

    A draw is a hash of replicate and number modulo the number of keys; it
    meets the key of that rank.  Keys that a replicate does not draw have no
    row.  Ranks come from range partitions, draws from a range of numbers, so
    neither is ever in one task.
    """
    spark = keys.sparkSession
    ranked = cut(running(keys.select(key).distinct().withColumn("_rank", F.lit(1).cast("long")), [], key, ["_rank"]))
    n = ranked.count()
    draws = spark.range(0, n * reps).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), (F.col("id") % max(n, 1)).alias("_draw"))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("rep").cast("string"), F.col("_draw").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = draws.groupBy("rep", (u % max(n, 1) + 1).alias("_rank")).agg(F.count("*").alias("weight"))
    return drawn.join(ranked, "_rank").select("rep", key, "weight")


def replicate_rates(counts: DataFrame, amounts: DataFrame, weights: DataFrame, by: list[str], level: str, clip: str) -> DataFrame:
    """Count over amount of every replicate for each group and level: ``by, level, rep, n, amount``.

    ``counts`` has ``n`` by group, clip and level, ``amounts`` has ``amount``
    by group and clip.  Amounts and the counts of all levels are added up in
    one pass over the weights, so rows don't multiply with the levels.
    """
    grid = sorted(r[0] for r in counts.select(level).distinct().collect())  # the grid of levels
    if not grid:
        return amounts.join(weights, clip).join(counts.select(level, "n"), F.lit(False)).select(*by, "rep", "amount", level, "n")
    # one row a group and clip with all its levels, so a weight is met once for each group
    wide = counts.groupBy(*by, clip).agg(*(F.sum(F.when(F.col(level) == x, F.col("n"))).alias(f"_n{i}") for i, x in enumerate(grid)))
    added = F.sum(F.col("amount") * F.col("weight")).alias("amount"), *(F.coalesce(F.sum(F.col(f"_n{i}") * F.col("weight")), F.lit(0).cast("long")).alias(f"_n{i}") for i in range(len(grid)))
    rates = amounts.join(wide, [*by, clip], "left").join(weights, clip).groupBy(*by, "rep").agg(*added)
    return rates.select(*by, "rep", "amount", F.inline(F.array(*(F.struct(F.lit(x).alias(level), F.col(f"_n{i}").alias("n")) for i, x in enumerate(grid)))))


def limits(rates: DataFrame, by: list[str], value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile limits ``lo, hi`` of a value over replicates; null values are left out."""
    return rates.groupBy(*by).agg(F.percentile(value, low).alias("lo"), F.percentile(value, high).alias("hi"))


def width_comparison(a: DataFrame, b: DataFrame, by: list[str], far: str = "far_h", low_rate: float = 30.0) -> DataFrame:
    """How the relative widths of two sets of limits (``far, lo, hi``) compare: b against a, over all rows and those whose rate in b is low.

    Only rows with a rate above 0 in both count.  Returns ``subset, n,
    width_a, width_b`` (medians), ``change_pct`` (median), ``wider_pct``.
    """
    w = lambda df, name: df.filter(F.col(far) > 0).select(*by, ((F.col("hi") - F.col("lo")) / F.col(far)).alias(name), F.col(far).alias(f"_{name}"))
    met = w(a, "wa").join(w(b, "wb"), by)
    both = met.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(F.col("_wb") <= low_rate, F.lit("low"))))).filter(F.col("subset").isNotNull())
    # a row for each group and threshold
    return both.groupBy("subset").agg(
        F.count("*").alias("n"),
        F.median("wa").alias("width_a"),
        F.median("wb").alias("width_b"),
        F.median(100 * (F.try_divide(F.col("wb"), F.col("wa")) - 1)).alias("change_pct"),
        (100 * F.avg((F.col("wb") > F.col("wa")).cast("int"))).alias("wider_pct"),
    )


def matched_thresholds(pairs: DataFrame, weights: DataFrame, published: DataFrame, by: list[str], level: str, clip: str) -> DataFrame:
    """In every replicate the least level at which source b has no more counts than source a has at its published level.

    ``pairs`` has ``na, nb`` by group, clip and level, ``published`` has the
    level of each group and ``target``.  Both sources have the same footage,
    so counts compare as rates do.  Returns ``by, target, published, rep,
    matched``; ``matched`` is null where no level will do.
    """
    curve = pairs.join(weights, clip).groupBy(*by, "rep", level).agg(F.sum(F.col("na") * F.col("weight")).alias("na"), F.sum(F.col("nb") * F.col("weight")).alias("nb"))
    points = F.broadcast(published.withColumnRenamed(level, "published"))  # a row for each group and target
    met = curve.join(points, by)
    most = F.max(F.when(F.col(level) == F.col("published"), F.col("na")))
    line = F.collect_list(F.struct(F.col(level).alias("level"), F.col("nb").alias("n")))  # as long as the grid of levels
    curves = met.groupBy(*by, "target", "published", "rep").agg(most.alias("most"), line.alias("line"))
    fit = F.array_min(F.transform(F.filter("line", lambda x: x.n <= F.col("most")), lambda x: x.level))
    return curves.select(*by, "target", "published", "rep", fit.alias("matched"))


def rmst_limits(df: DataFrame, by: list[str], time: str, event: str, cluster: str, tau: float, reps: int) -> DataFrame:
    """Restricted means with percentile limits from resampled clusters: ``by, rmst, lo, hi, n``.

    All replicates are life tables with the drawn weights, made in one pass;
    a replicate that draws no run of a group has no mean there.
    """
    weights = resample(df.filter(F.col(cluster).isNotNull()), cluster, reps)
    one = rmst(weighted_kaplan_meier(df, by, time, event), by, tau)
    drawn = weighted_kaplan_meier(df.join(weights, cluster), [*by, "rep"], time, event, "weight")
    means = rmst(drawn, [*by, "rep"], tau)
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return one.join(limits(means, by, "rmst"), by, "left").join(n, by)
