"""Group summaries and tests from sufficient statistics; the tail probability comes last, on one row a test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normality as normal
from ..functions import tails
from ..functions.expressions import wilson
from .sequence import average_ranks, matched
from .survival import cut, running


def exact_quantiles(df: DataFrame, by: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """Quantiles of each group with linear interpolation, one column a level: ``{"median": 0.5}``.

    Values are counted first and the counts added up over range partitions,
    so a group may have any number of different values.  Null values do not
    count; a group without a value has no row.  Null groups are groups.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_to"))
    upto = running(counts, by, "_v", ["_to"])
    met = matched(upto, upto.groupBy(*by).agg(F.max("_to").alias("_all")), by)
    at = {c: (F.col("_all") - 1) * q for c, q in levels.items()}
    reach = lambda place: F.min(F.when(F.col("_to") > place, F.col("_v")))
    ends = met.groupBy(*by, "_all").agg(*(f(reach(r(p))) for c, p in at.items() for r, f in ((F.floor, lambda x, c=c: x.alias(f"_lo_{c}")), (F.ceil, lambda x, c=c: x.alias(f"_hi_{c}")))))
    between = {c: F.when(F.col(f"_lo_{c}") == F.col(f"_hi_{c}"), F.col(f"_lo_{c}").cast("double")).otherwise((F.ceil(p) - p) * F.col(f"_lo_{c}") + (p - F.floor(p)) * F.col(f"_hi_{c}")) for c, p in at.items()}
    return ends.select(*by, *(v.alias(c) for c, v in between.items()))


def with_quantiles(df: DataFrame, by: list[str], aggregates: list[Column], value: str, levels: dict[str, float]) -> DataFrame:
    """Aggregates of each group and quantiles of a value beside them, null for a group without one; the rows are made once."""
    rows = cut(df)
    return matched(rows.groupBy(*by).agg(*aggregates), exact_quantiles(rows, by, value, levels), by)


def summarize(df: DataFrame, by: list[str], metric: str, hit: str) -> DataFrame:
    """Runs, hits, miss rate, and mean, sd (0 for one value), median, p90, limits of a metric; null metrics count in the miss rate only."""
    aggregates = [
        F.count("*").alias("n"),
        F.count_if(hit).alias("hits"),
        (1 - F.avg(F.col(hit).cast("int"))).alias("miss_rate"),
        F.avg(metric).alias("mean"),
        F.when(F.count(metric) > 0, F.coalesce(F.stddev_samp(metric), F.lit(0.0))).alias("sd"),
        F.min(metric).alias("low"),
        F.max(metric).alias("high"),
    ]
    return with_quantiles(df.select(*by, metric, hit), by, aggregates, metric, {"median": 0.5, "p90": 0.9})


def with_t_interval(df: DataFrame, n: str = "n", sd: str = "sd") -> DataFrame:
    """Half-width ``ci95`` of the t interval of a mean; null for fewer than two values."""
    return df.withColumn("ci95", F.when(F.col(n) > 1, tails.t_high()(F.col(n).cast("double")) * F.col(sd) / F.sqrt(F.col(n))))


def cell_half_widths(df: DataFrame, by: list[str], metrics: list[str], keep: int = 2) -> DataFrame:
    """The t interval of every metric in every cell, one row a metric: ``n, mean, half_width, half_width_pct`` (null for a mean of 0).

    Null values are left out; a cell needs ``keep`` values of a metric.
    """
    long = df.select(*by, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(by, metrics, "metric", "value").filter(F.col("value").isNotNull())
    s = long.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).filter(F.col("n") >= keep)
    half = F.col("ci95")
    return with_t_interval(s).select(*by, "metric", "n", "mean", half.alias("half_width"), F.when(F.col("mean") != 0, 100 * half / F.col("mean")).alias("half_width_pct"))


def label_pairs(df: DataFrame, label: str, on: list[str], metric: str) -> DataFrame:
    """Paired values of every two labels (``a < b``) on the same cell: ``a, b, x, y``; nulls drop out."""
    rows = df.filter(F.col(metric).isNotNull()).select(*on, F.col(label).alias("l"), F.col(metric).alias("v"))
    x, y = rows.withColumnsRenamed({"l": "a", "v": "x"}), rows.withColumnsRenamed({"l": "b", "v": "y"})
    return x.join(y, on).filter(F.col("a") < F.col("b"))


def paired_t(pairs: DataFrame) -> DataFrame:
    """t and Cohen's d of the differences of each pair of labels, wins and losses for the sign test; t is null below three pairs."""
    d = F.col("y") - F.col("x")
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    ok = (F.col("n") >= 3) & (F.col("sd") > 0)
    return out.withColumns({"d_z": F.when(ok, F.col("mean_diff") / F.col("sd")), "t": F.when(ok, F.col("mean_diff") / F.col("sd") * F.sqrt("n"))})


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Signed-rank sums of each pair of labels with the normal approximation ``z`` and effect ``r``; zero differences drop out."""
    d = pairs.withColumn("_d", F.col("y") - F.col("x")).filter(F.col("_d") != 0).withColumn("_abs", F.abs("_d"))
    s = average_ranks(d, ["a", "b"], "_abs", "_rank").groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0)).alias("w_plus"))
    n = F.col("n")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return s.withColumn("z", z).withColumn("r", F.abs("z") / F.sqrt("n"))


def anova(df: DataFrame, by: list[str], group: str, metric: str) -> DataFrame:
    """One-way F from group counts, means and squares; groups with one value are left out, fewer than two groups give no row."""
    g = df.filter(F.col(metric).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(metric).alias("m"), F.var_samp(metric).alias("v")).filter("n > 1")
    w = Window.partitionBy(*by)
    g = g.withColumn("_grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    out = g.groupBy(*by).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("_grand"), F.lit(2.0))).alias("ssb"), F.sum((F.col("n") - 1) * F.col("v")).alias("ssw"), (F.max("m") - F.min("m")).alias("spread")).filter("k >= 2")
    return out.withColumn("f", F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))))


def chi_square(df: DataFrame, factor: str, outcome: str, yates: bool = False) -> DataFrame:
    """Independence of a factor and an outcome: one row ``chi2, dof, n``.

    ``yates`` draws every count towards its expectation by one half at most if
    there is one degree of freedom.  With one level of either there is
    nothing to test: dof is 0 and chi2 is null.
    """
    cells = df.groupBy(F.col(factor).alias("f"), F.col(outcome).alias("o")).agg(F.count("*").alias("n"))
    # the table has a row for each factor level and outcome, not for each observation
    grid = cells.select("f").distinct().crossJoin(cells.select("o").distinct())
    t = grid.join(cells, ["f", "o"], "left").fillna(0, ["n"])
    t = t.withColumns({"_r": F.sum("n").over(Window.partitionBy("f")), "_c": F.sum("n").over(Window.partitionBy("o"))})
    total = F.broadcast(cells.agg(F.sum("n").alias("_t")))
    e = F.col("_r") * F.col("_c") / F.col("_t")
    square = lambda gap: F.sum(F.pow(gap, F.lit(2.0)) / e)
    gap = F.abs(F.col("n") - e)
    dof = (F.countDistinct("f") - 1) * (F.countDistinct("o") - 1)
    chi2 = F.when(dof == 1, square(gap - F.least(gap, F.lit(0.5)))).otherwise(square(gap)) if yates else square(gap)
    return t.crossJoin(total).agg(F.when(dof > 0, chi2).alias("chi2"), dof.alias("dof"), F.max("_t").alias("n"))


def failure_shares(df: DataFrame, by: list[str], failed: str) -> DataFrame:
    """Share of failures with Wilson limits in percent."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("k"))
    k, n = F.col("k"), F.col("n")
    return out.withColumns({"share": 100.0 * k / n, "low": 100 * wilson(k, n, tails.Z95, -1), "high": 100 * wilson(k, n, tails.Z95, 1)})


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks within each group."""
    ranked = average_ranks(average_ranks(df, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def tost(df: DataFrame, by: list[str], z: str, margin: float = 1.0) -> DataFrame:
    """The two one-sided t statistics of a standardised difference against plus and minus the margin."""
    out = df.groupBy(*by).agg(F.count(z).alias("n"), F.avg(z).alias("mean"), F.stddev_samp(z).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.withColumns({"t_low": F.try_divide(F.col("mean") + margin, se), "t_high": F.try_divide(F.col("mean") - margin, se)})


def mcnemar(pairs: DataFrame, a_hit: str, b_hit: str, by: list[str]) -> DataFrame:
    """Discordant pairs with the continuity-corrected chi-square."""
    out = pairs.groupBy(*by).agg(F.count_if(F.col(a_hit) & ~F.col(b_hit)).alias("only_a"), F.count_if(~F.col(a_hit) & F.col(b_hit)).alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    return out.withColumn("chi2", F.try_divide(F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)).cast("double"), F.lit(2.0)), n))


def normality(diffs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Shapiro-Wilk of each group: ``n, w, p``; p is 0 for equal values, both are null outside of 3 to 5,000 values.

    Only groups in that range are ordered, so a window holds 5,000 rows at
    most; scores of the ranks are added up in Spark and the statistic is made
    on one row a group.
    """
    v = F.col(value)
    size = diffs.groupBy(*by).agg(F.count(v).alias("n"), (F.var_pop(v) * F.count(v)).alias("_ss"), (F.max(v) - F.min(v)).alias("_span"), F.max(F.abs(v)).alias("_most"))
    fit = size.filter(F.col("n").between(normal.LEAST, normal.MOST))
    w = Window.partitionBy(*by).orderBy("_v")
    rows = diffs.filter(v.isNotNull()).select(*by, v.cast("double").alias("_v")).join(fit.select(*by, "n"), by)
    rows = rows.withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_m", tails.blom_score()(F.col("_i").cast("double"), F.col("n").cast("double")))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("_v")))
    sums = rows.groupBy(*by).agg(F.sum(F.col("_m") * F.col("_v")).alias("_mx"), F.sum(F.col("_m") * F.col("_m")).alias("_mm"), at(1).alias("_e1"), at(2).alias("_e2"), at(F.col("n") - 1).alias("_e3"), at(F.col("n")).alias("_e4"))
    out = size.join(sums, by, "left")
    constant = F.col("_span") <= 1e-8 + 1e-5 * F.col("_most")
    out = out.withColumn("w", F.when(~constant, tails.shapiro_w()(F.array(F.col("n").cast("double"), "_mx", "_mm", "_e1", "_e2", "_e3", "_e4", "_ss"))))
    p = F.when(F.col("w").isNotNull(), tails.shapiro_p()(F.col("w"), F.col("n").cast("double")))
    return out.withColumn("p", F.when(constant & F.col("_mx").isNotNull(), 0.0).otherwise(p)).select(*by, "n", "w", "p")


def signed_rank_tests(pairs: DataFrame) -> DataFrame:
    """Two-sided signed-rank test of each pair of labels: ``n`` differences that are not 0, ``w`` (the smaller rank sum), effect ``r``, ``p``, ``exact``.

    p is exact up to 50 untied differences without zeros, normal beyond; if
    all differences are 0, w is null, p is 1 and r is 0.
    """
    d = pairs.withColumn("_d", F.col("y") - F.col("x")).withColumn("_abs", F.abs("_d"))
    zeros = d.groupBy("a", "b").agg(F.count_if(F.col("_d") == 0).alias("zeros"))
    some = d.filter(F.col("_d") != 0)
    ties = some.groupBy("a", "b", "_abs").agg(F.count("*").alias("t")).groupBy("a", "b").agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    ranked = average_ranks(some, ["a", "b"], "_abs", "_rank")
    s = ranked.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0)).alias("plus"), F.sum("_rank").alias("all")).join(ties, ["a", "b"])
    out = zeros.join(s, ["a", "b"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "w": F.least(F.col("plus"), F.col("all") - F.col("plus"))})
    exact = (F.col("n") <= normal.EXACT) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    p = F.when(exact, tails.signed_rank_p()(F.col("n").cast("double"), "w")).otherwise(tails.signed_rank_normal()(F.col("n").cast("double"), "w", "ties"))
    z = (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt(F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24)
    none = F.col("n") == 0
    return out.select("a", "b", "n", "w", F.when(none, 0.0).otherwise(F.abs(z) / F.sqrt("n")).alias("r"), F.when(none, 1.0).otherwise(p).alias("p"), F.coalesce(exact, F.lit(False)).alias("exact"))


def gated_tests(df: DataFrame, label: str, on: list[str], metric: str, alpha: float = 0.05) -> DataFrame:
    """Every two labels compared on the same cells: the t test where the differences pass for normal, signed ranks elsewhere.

    Pairs of labels with fewer than three cells in common have the status
    ``insufficient`` and no p.  Bonferroni counts all pairs of labels.
    """
    from .decide import bonferroni

    rows = df.filter(F.col(label).isNotNull())
    names = rows.select(F.col(label).alias("l")).distinct()
    all_pairs = F.broadcast(names.select(F.col("l").alias("a"))).join(F.broadcast(names.select(F.col("l").alias("b"))), F.col("a") < F.col("b"))  # pairs of label names
    pairs = label_pairs(rows, label, on, metric)
    gate = normality(pairs.withColumn("_d", F.col("x") - F.col("y")), ["a", "b"], "_d").select("a", "b", F.col("p").alias("shapiro_p"))
    t = paired_t(pairs).select("a", "b", F.col("n").alias("n_pairs"), (-F.col("mean_diff")).alias("mean_diff"), (-F.col("t")).alias("t"), (-F.col("d_z")).alias("d_z"))
    w = signed_rank_tests(pairs).select("a", "b", "w", "r", F.col("p").alias("p_w"))
    met = all_pairs.join(t, ["a", "b"], "left").join(gate, ["a", "b"], "left").join(w, ["a", "b"], "left").fillna(0, ["n_pairs"])
    few = F.col("n_pairs") < 3
    by_t = F.coalesce(F.col("shapiro_p") > alpha, F.lit(False)) & F.col("t").isNotNull()
    p = F.when(~few, F.when(by_t, tails.t_p()("t", F.col("n_pairs") - 1.0)).otherwise(F.col("p_w")))
    out = met.select(
        "a",
        "b",
        "n_pairs",
        F.when(few, "insufficient").when(by_t, "paired-t").otherwise("signed-ranks").alias("test"),
        *(F.when(~few, F.col(c)).alias(c) for c in ("mean_diff", "shapiro_p")),
        F.when(~few, F.when(by_t, F.col("t")).otherwise(F.col("w"))).alias("statistic"),
        p.alias("p"),
        F.when(~few, F.when(by_t, F.col("d_z")).otherwise(F.col("r"))).alias("effect"),
    )
    return bonferroni(out, "p", alpha, every_row=True)
