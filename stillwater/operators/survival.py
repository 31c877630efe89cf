"""Censored time-to-event statistics on counts by time, so that work on single rows is one aggregation."""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import tails


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, in the folder of ``spark.checkpoint.dir``; only a local session gets one of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def life_table(df: DataFrame, by: list[str], time: str, event: str, weight: str | None = None) -> DataFrame:
    """``time, d, c, n``: events, censored and at risk at each time of each group; rows with null or non-positive time are left out.

    ``weight`` says how often a row counts.  The numbers at risk are running
    sums over range partitions, so a group may have any number of times.
    """
    ok = df.filter(F.col(time).isNotNull() & (F.col(time) > 0))
    n = F.lit(1) if weight is None else F.col(weight)
    t = ok.groupBy(*by, F.col(time).alias("time")).agg(F.sum(F.when(F.col(event), n).otherwise(0)).alias("d"), F.sum(F.when(F.col(event), 0).otherwise(n)).alias("c"))
    t = t.withColumns({"n": F.col("d") + F.col("c"), "_back": -F.col("time")})
    return running(t, by, "_back", ["n"]).drop("_back")


def weighted_kaplan_meier(df: DataFrame, by: list[str], time: str, event: str, weight: str | None = None) -> DataFrame:
    """``time, d, c, n``, survival ``s_before`` and ``s`` before and after each time, and the sum ``greenwood``."""
    t = life_table(df, by, time, event, weight)
    some = F.col("d") < F.col("n")
    log, part = F.when(some, F.log1p(-F.col("d") / F.col("n"))).otherwise(0.0), F.when(some, F.col("d") / (F.col("n") * (F.col("n") - F.col("d")))).otherwise(0.0)
    t = t.withColumns({"_own": log, "_log": log, "greenwood": part, "_over": (~some).cast("long"), "_last": ~some})
    t = running(t, by, "time", ["_log", "greenwood", "_over"])
    before = F.when(F.col("_over") - F.col("_last").cast("int") > 0, 0.0).otherwise(F.exp(F.col("_log") - F.col("_own")))
    return t.withColumns({"s_before": before, "s": F.when(F.col("_over") > 0, 0.0).otherwise(F.exp("_log"))}).drop("_own", "_log", "_over", "_last")


def kaplan_meier(df: DataFrame, by: list[str], time: str, event: str) -> DataFrame:
    """Survival ``s`` after each time with the sum ``greenwood`` and log-log limits ``s_lo, s_hi``."""
    t = weighted_kaplan_meier(df, by, time, event)
    inner = (F.col("s") > 0) & (F.col("s") < 1)
    v = F.when(inner, 1.959963984540054 * F.sqrt("greenwood") / F.log("s"))
    return t.withColumns({"s_lo": F.when(inner, F.pow("s", F.exp(-v))), "s_hi": F.when(inner, F.pow("s", F.exp(v)))})


def quantile(km: DataFrame, by: list[str], level: float, out: str) -> DataFrame:
    """First time at which survival is down to ``level``; null if it never is."""
    return km.groupBy(*by).agg(F.min(F.when(F.col("s") <= level + 1e-12, F.col("time"))).alias(out))


def rmst(km: DataFrame, by: list[str], tau: float) -> DataFrame:
    """Area under the survival curve up to ``tau``: each step down counts with its time, what is left with ``tau``."""
    upto = F.col("time") <= tau
    steps = F.sum(F.when(upto, F.col("time") * (F.col("s_before") - F.col("s"))).otherwise(0.0))
    left = F.coalesce(F.min(F.when(upto, F.col("s"))), F.lit(1.0))
    return km.groupBy(*by).agg((steps + tau * left).alias("rmst"))


def log_rank(df: DataFrame, group: str, time: str, event: str) -> DataFrame:
    """All pairs of groups: observed, expected, variance and chi-square with one degree of freedom."""
    ok = df.filter(F.col(time).isNotNull() & (F.col(time) > 0))
    t = ok.groupBy(F.col(group).alias("g"), F.col(time).alias("time")).agg(F.count_if(event).alias("d"), F.count("*").alias("m"))
    names = t.select("g").distinct()
    pairs = names.select(F.col("g").alias("a")).join(names.select(F.col("g").alias("b")), F.col("a") < F.col("b"))
    pairs = F.broadcast(pairs)  # pairs of group names
    cells = t.join(pairs, (F.col("g") == F.col("a")) | (F.col("g") == F.col("b")))
    one = F.col("g") == F.col("a")
    at = cells.groupBy("a", "b", "time").agg(F.sum("d").alias("d"), F.sum("m").alias("m"), F.sum(F.when(one, F.col("d")).otherwise(0)).alias("d1"), F.sum(F.when(one, F.col("m")).otherwise(0)).alias("m1"))
    at = running(at.withColumns({"n": F.col("m"), "n1": F.col("m1"), "_back": -F.col("time")}), ["a", "b"], "_back", ["n", "n1"])
    e = F.col("d") * F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, e * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    out = at.groupBy("a", "b").agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    return out.withColumn("chi2", F.try_divide(F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)), F.col("variance")))


def running(df: DataFrame, group: list[str], order: str | list[str], columns: list[str]) -> DataFrame:
    """Replace ``columns`` by their sums from the first row of each group on, in the order of ``order`` (unique in a group).

    Rows are range-partitioned, so a group may fill many partitions; what
    comes before a partition is added from a table with a row for each
    partition and group in it.
    """
    order = [order] if isinstance(order, str) else order
    keys = [*group, *order]
    rows = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*group, "_part")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.groupBy(*group, "_part").agg(*(F.sum(c).alias(c) for c in columns))
    met = met.select(*group, "_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    met = met.withColumnsRenamed({c: f"_of_{c}" for c in group}).withColumnRenamed("_part", "_in")
    here = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    rows = rows.withColumns({c: F.sum(c).over(w.orderBy(*order)) for c in columns}).join(met, [F.col("_part") == F.col("_in"), *here])
    return rows.select(*(((F.col(c) + F.col(f"_{c}")).alias(c) if c in columns else F.col(c)) for c in df.columns))


def _efron(at_risk: np.ndarray, dead: np.ndarray, x: np.ndarray, beta: np.ndarray, most: int = 500_000):
    """For pieces of the events of some times: ``of`` (the time of each), ``f``, ``a0`` and mean covariates; rows of the arguments are times, columns patterns ``x``."""
    rate = np.exp(x @ beta)
    r, q, d = at_risk * rate, dead * rate, dead.sum(1)
    ends = np.cumsum(d)
    for start in range(0, int(ends[-1]) if len(ends) else 0, most):
        i = np.arange(start, min(start + most, int(ends[-1])))
        of = np.searchsorted(ends, i, "right")
        f = (i - (ends[of] - d[of])) / d[of]
        left = r[of] - f[:, None] * q[of]
        a0 = left.sum(1)
        yield of, f, a0, left, left @ x / a0[:, None]


@dataclass
class CoxFit:
    """A fitted proportional hazards model; ``times`` has counts at risk and of events by pattern for each time of each stratum."""

    covariates: list[str]
    x: np.ndarray
    times: DataFrame
    beta: np.ndarray
    cov: np.ndarray
    se: np.ndarray
    n_events: int
    converged: bool

    def rows(self) -> list[dict]:
        """A dict for each covariate with limits, p value and a flag for separation (the hazard's upper limit is next to none)."""
        out = []
        for c, b, v in zip(self.covariates, self.beta, self.se):
            if not self.converged:
                out.append({"covariate": c, **dict.fromkeys(("coef", "hr", "se", "z")), "n_events": self.n_events, "converged": False, **dict.fromkeys(("hr_lo", "hr_hi", "p", "separated"))})
                continue
            low, high = (float(np.exp(min(b + s * tails.Z95 * v, 700.0))) for s in (-1, 1))
            out.append({"covariate": c, "coef": float(b), "hr": float(np.exp(b)), "se": float(v), "z": float(b / v), "n_events": self.n_events, "converged": True, "hr_lo": low, "hr_hi": high, "p": math.erfc(abs(b / v) / math.sqrt(2)), "separated": high < SEPARATED})
        return out


#: A hazard ratio whose upper limit is below this has no event in its group to rest on.
SEPARATED = 1e-3


def dummies(df: DataFrame, col: str, reference: object) -> tuple[DataFrame, list[str]]:
    """A 0/1 column for each value of a category but the reference, in order of the values; the categories are a dimension."""
    levels = sorted((r[0] for r in df.select(col).distinct().collect() if r[0] is not None and r[0] != reference), key=str)
    names = [f"{col}_{v}" for v in levels]
    return df.withColumns({n: (F.col(col) == F.lit(v)).cast("int") for n, v in zip(names, levels)}), names


def _table(b: pa.RecordBatch, k: int):
    return (b.column(b.schema.get_field_index(c)).flatten().to_numpy().reshape(-1, k) for c in ("at_risk", "dead"))


def fit_cox(df: DataFrame, covariates: list[str], time: str, event: str, cluster: str | None = None, strata: list[str] | None = None, max_steps: int = 30) -> CoxFit | None:
    """Proportional hazards with Efron's ties for 0/1 covariates; sandwich errors by cluster if given.

    Spark compresses the rows to a table of times with counts at risk and of
    events by covariate pattern, the risk sets being running sums.  Each
    Newton step is an aggregation over this table, which gives the driver the
    gradient and the Hessian only; score residuals are added up by cluster in
    Spark too.  The patterns (for dummies as many as categories) are held by
    the driver.  None without rows; ``converged`` is False if the steps did
    not settle.
    """
    spark = df.sparkSession
    ok = df.filter(F.col(time).isNotNull() & (F.col(time) > 0))
    names = sorted((tuple(r) for r in ok.select(*covariates).distinct().collect()), key=str)
    if not names:
        return None
    x, p, k = np.array(names, float), len(covariates), len(names)
    code = F.broadcast(spark.createDataFrame([(*r, i) for i, r in enumerate(names)], [*(f"_x{i}" for i in range(p)), "_pattern"]))
    on = [F.col(c).eqNullSafe(F.col(f"_x{i}")) for i, c in enumerate(covariates)]
    group = F.struct(*(F.col(c) for c in strata)) if strata else F.lit(0)
    rows = ok.join(code, on).select(group.alias("_s"), F.col(time).alias("_t"), F.col("_pattern"), F.coalesce(F.col(event), F.lit(False)).alias("_e"), *([F.col(cluster).alias("_c")] if cluster else []))
    rows = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")))
    risk, dead = [f"n{i}" for i in range(k)], [f"d{i}" for i in range(k)]
    one = lambda i, e=F.lit(True): F.sum(F.when((F.col("_pattern") == i) & e, F.col("_n")).otherwise(0))
    times = rows.groupBy("_s", "_t").agg(*(one(i).alias(risk[i]) for i in range(k)), *(one(i, F.col("_e")).alias(dead[i]) for i in range(k)))
    times = running(times.withColumn("_back", -F.col("_t")), ["_s"], "_back", risk)
    times = cut(times.select("_s", "_t", F.array(*risk).alias("at_risk"), F.array(*dead).alias("dead")))
    events = int(rows.agg(F.coalesce(F.sum(F.when(F.col("_e"), F.col("_n"))), F.lit(0))).first()[0])

    def derive(beta):
        def run(batches):
            total = np.zeros(p + p * p)
            for b in batches:
                n, d = _table(b, k)
                total[:p] += d.sum(0) @ x
                for _, _, a0, left, mean in _efron(n, d, x, beta):
                    total[:p] -= mean.sum(0)
                    second = np.einsum("k,ki,kj->ij", (left / a0[:, None]).sum(0), x, x)
                    total[p:] += (second - mean.T @ mean).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

        found = times.filter(F.aggregate("dead", F.lit(0).cast("long"), lambda a, v: a + v) > 0).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(p + p * p)
        for r in found:
            total[r["i"]] = r["v"]
        return total[:p], total[p:].reshape(p, p)

    def meat(beta):
        """The sum over clusters of the outer products of their score residuals."""
        add = [f"h{i}" for i in range(p + 1)]  # hazard steps up to a time, for those alive after it: 1 / a0 and mean / a0
        tied = [f"e{i}" for i in range(2 * p + 1)]  # what those steps lack for the tied, and the mean of the means

        def steps(batches):
            for b in batches:
                n, d = _table(b, k)
                out = np.zeros((len(n), 3 * p + 2))
                for of, f, a0, _, mean in _efron(n, d, x, beta):
                    h = np.column_stack([1 / a0, mean / a0[:, None]])
                    np.add.at(out, of, np.column_stack([h, f[:, None] * h, mean / d.sum(1)[of][:, None]]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v) for v in out.T)], ["_s", "_t", *add, *tied])

        schema = StructType([*times.schema.fields[:2], *(StructField(c, DoubleType()) for c in (*add, *tied))])
        hazard = running(times.mapInArrow(steps, schema), ["_s"], "_t", add)
        per = rows.join(hazard, ["_s", "_t"])
        e = F.col("_e").cast("int")
        rate = F.get(F.array(*(F.lit(float(v)) for v in np.exp(x @ beta))), F.col("_pattern"))
        u = []
        for i in range(p):
            v = F.get(F.array(*(F.lit(float(v)) for v in x[:, i])), F.col("_pattern"))
            gone = v * (F.col("h0") - e * F.col("e0")) - (F.col(f"h{i + 1}") - e * F.col(f"e{i + 1}"))
            u.append(F.sum(F.col("_n") * (e * (v - F.col(f"e{p + 1 + i}")) - rate * gone)).alias(f"u{i}"))
        by = per.groupBy("_c").agg(*u)
        sums = by.agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(p) for j in range(p))).first()
        return np.array(sums, float).reshape(p, p)

    beta, converged = np.zeros(p), False
    for _ in range(max_steps):
        grad, hess = derive(beta)
        try:
            step = np.linalg.solve(hess, grad)
        except np.linalg.LinAlgError:
            break
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            converged = True
            break
    cov = np.full((p, p), np.nan)
    if converged:
        cov = np.linalg.inv(derive(beta)[1])
    robust = cov @ meat(beta) @ cov if cluster and converged else cov
    return CoxFit(covariates, x, times, beta, cov, np.sqrt(np.diag(robust)), events, converged)


def cox(df: DataFrame, covariates: list[str], time: str, event: str, cluster: str | None = None, strata: list[str] | None = None, max_steps: int = 30) -> list[dict]:
    """The rows of ``fit_cox``: a dict for each covariate, none for a table without rows."""
    fit = fit_cox(df, covariates, time, event, cluster, strata, max_steps)
    return fit.rows() if fit else []


def schoenfeld(fit: CoxFit) -> DataFrame:
    """Residuals of the events: ``stratum, time, rank, n`` and one ``r_<covariate>`` each; ``n`` events of a time and pattern share a row.

    A residual is the covariate less its mean over those at risk, for tied
    events the mean of Efron's means.  ``rank`` is the rank of the time among
    all events, ties sharing their mean.
    """
    x, beta, k = fit.x, fit.beta, len(fit.x)
    total = F.aggregate("dead", F.lit(0).cast("long"), lambda a, v: a + v)
    at = fit.times.groupBy("_t").agg(F.sum(total).alias("_d")).filter("_d > 0").withColumn("_upto", F.col("_d"))
    at = running(at, [], "_t", ["_upto"]).select("_t", (F.col("_upto") - (F.col("_d") - 1) / 2).alias("_rank"))
    names = [f"r_{c}" for c in fit.covariates]

    def run(batches):
        for b in batches:
            n, d = _table(b, k)
            mean = np.zeros((len(d), x.shape[1]))
            for of, _, _, _, m in _efron(n, d, x, beta):
                np.add.at(mean, of, m / d.sum(1)[of][:, None])
            row, pattern = np.nonzero(d)
            r = x[pattern] - mean[row]
            keep = [b.column(b.schema.get_field_index(c)).take(pa.array(row)) for c in ("_s", "_t", "_rank")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(d[row, pattern].astype(np.int64)), *(pa.array(v) for v in r.T)], ["stratum", "time", "rank", "n", *names])

    met = fit.times.join(at, "_t").filter(total > 0)
    kind = {f.name: f.dataType for f in met.schema.fields}
    schema = StructType([StructField("stratum", kind["_s"]), StructField("time", kind["_t"]), StructField("rank", DoubleType()), StructField("n", LongType()), *(StructField(c, DoubleType()) for c in names)])
    return met.mapInArrow(run, schema)


def ph_test(fit: CoxFit) -> DataFrame:
    """Whether hazards stay proportional: scaled residuals against the ranks of the event times, ``covariate, chi2, p, p_holm``.

    The residuals are scaled by the covariance of the fit and tested with its
    errors (by cluster, if it has one).  Sums over the residuals are made in Spark.
    """
    spark, names = fit.times.sparkSession, [f"r_{c}" for c in fit.covariates]
    schema = "covariate string, chi2 double, p double, p_holm double"
    if not fit.converged or not fit.n_events:
        return spark.createDataFrame([(c, None, None, None) for c in fit.covariates], schema)
    n, g = F.col("n"), F.col("rank")
    s = schoenfeld(fit).agg(F.sum(n * g).alias("g"), F.sum(n * g * g).alias("gg"), *(F.sum(n * F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(names)), *(F.sum(n * g * F.col(f"`{c}`")).alias(f"t{i}") for i, c in enumerate(names))).first()
    mean = s["g"] / fit.n_events
    spread = s["gg"] - fit.n_events * mean**2
    u = np.array([s[f"t{i}"] - mean * s[f"s{i}"] for i in range(len(names))])
    chi2 = fit.n_events * (u @ fit.cov) ** 2 / (fit.se**2 * spread) if spread > 0 else np.zeros(len(names))
    p = [tails.chi2_sf(float(v), 1) for v in chi2]
    order = sorted(range(len(p)), key=p.__getitem__)
    adjusted, most = {}, 0.0
    for i, j in enumerate(order):
        adjusted[j] = most = max(most, min(1.0, (len(p) - i) * p[j]))
    return spark.createDataFrame([(c, float(chi2[i]), p[i], adjusted[i]) for i, c in enumerate(fit.covariates)], schema)
