"""The registered queries of the library with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: Common table expressions for the SQL side: f, observations; s, with streaks; r, runs.
FRAMES = """
f as (
    select user_id as run_id, event_id as frame_idx, epoch_us(ts) * 1000 as t_post, value, event_type as cls, props,
           cast(user_id % 5 as int) as config, cast((user_id // 5) % 3 as int) as model, cast(user_id // 15 as int) as scenario
    from events
),
o as (select run_id, min(t_post) filter (where t_post >= 1705276800000000000) as t_onset from f group by run_id),
fo as (select * from f join o using (run_id))"""
STREAKS = (
    FRAMES
    + """,
s0 as (select *, case when value >= 60 then 1 else 0 end as q from fo),
s1 as (select *, sum(1 - q) over (partition by run_id order by t_post, frame_idx) as brk from s0),
s as (
    select *, case when q = 1 then sum(q) over (partition by run_id, brk order by t_post, frame_idx) else 0 end as streak from s1
)"""
)
RUNS = (
    STREAKS
    + """,
r0 as (
    select run_id, config, model, scenario, max(t_onset) as t_onset,
           min(t_post) filter (where streak >= 3 and t_post >= t_onset) as t_fire,
           coalesce(bool_or(streak >= 3 and t_post < t_onset), false) as fp_pre,
           min(t_post) filter (where streak = 3) as t_single_shot,
           min(t_post) filter (where streak >= 1 and t_post >= t_onset) as t_first_detection, max(t_post) as t_last,
           count(*) filter (where t_post >= t_onset) as n_post,
           count(*) filter (where t_post >= t_onset and streak >= 1) as n_qualifying_post
    from s group by run_id, config, model, scenario
),
r1 as (
    select *, t_fire is not null as hit, round((t_fire - t_onset) / 3.6e12, 6) as ttd, round((t_last - t_onset) / 3.6e12, 6) as followup,
           round((t_first_detection - t_onset) / 3.6e12, 6) as t_first, round((t_single_shot - t_onset) / 3.6e12, 6) as t_single
    from r0
),
r as (
    select *, round(ttd - case when hit then t_first end, 6) as accum, case when hit then ttd else followup end as duration from r1
)"""
)
CORPUS = """
c as (
    select l_suppkey as clip, l_returnflag as model, cast(round(l_discount * 100) as int) as score,
           l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity
    from lineitem
)"""


def t_tail(t: str, df: str) -> str:
    """SQL of the two-sided tail of Student's t at a whole number of degrees of freedom: finite sums of powers of a cosine."""
    cos, angle = f"(1 / sqrt(1 + ({t}) ** 2 / {df}))", f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, cast({df} // 2 as bigint)), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * {cos} ** (2 * j)))"
    odd = f"({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, cast(({df} - 1) // 2 as bigint)), lambda j: exp(lgamma(j + 1) + lgamma(0.5) - lgamma(j + 1.5)) / 2 * {cos} ** (2 * j + 1))), 0)) * 2 / pi()"
    return f"(1 - case when {df} % 2 = 0 then {even} else {odd} end)"


def t_quantile(df: str) -> str:
    """SQL of the 97.5 percent quantile of Student's t, by halving between 0 and 1,000."""
    tail = t_tail("(s[1] + s[2]) / 2", df)
    return f"list_reduce(list_transform(range(0, 60), lambda i: [0.0, 1000.0]), lambda s, x: case when {tail} > 0.05 then [(s[1] + s[2]) / 2, s[2]] else [s[1], (s[1] + s[2]) / 2] end)[1]"


def poisson_upto(n: str, mean: str) -> str:
    """SQL of the chance of at most ``n`` events, 0 for fewer than none."""
    return f"coalesce(list_sum(list_transform(range(0, {n} + 1), lambda j: exp(j * ln({mean}) - ({mean}) - lgamma(j + 1)))), 0)"


def poisson_limit(n: str, chance: str) -> str:
    """SQL of the Poisson mean at which at most ``n`` events have the given chance, by halving."""
    return f"list_reduce(list_transform(range(0, 70), lambda i: [0::double, 2 * {n} + 20::double]), lambda s, x: case when {poisson_upto(n, '(s[1] + s[2]) / 2')} > {chance} then [(s[1] + s[2]) / 2, s[2]] else [s[1], (s[1] + s[2]) / 2] end)[1]"


def sign_tail(wins: str, losses: str) -> str:
    """SQL of the exact two-sided sign test of up to 33 differences."""
    n, k = f"({wins} + {losses})", f"cast(least({wins}, {losses}) as bigint)"
    choose = f"cast(factorial(cast({n} as int)) // (factorial(cast(j as int)) * factorial(cast({n} - j as int))) as double)"
    return f"least(1, coalesce(2 * list_sum(list_transform(range(0, {k} + 1), lambda j: {choose})) / 2.0 ** {n}, 1))"


def chi2_tail(x: str, df: str, terms: str = "400") -> str:
    """SQL of the upper tail of chi-square, by the series of the incomplete gamma function; 400 terms do for ``x`` up to 500, ``400 + x`` for any."""
    return f"greatest(0, 1 - case when ({x}) > 0 then list_sum(list_transform(range(0, {terms}), lambda j: exp(({df} / 2.0 + j) * ln(({x}) / 2) - ({x}) / 2 - lgamma({df} / 2.0 + j + 1)))) else 0 end)"


def any_chi2_tail(x: str, df: str) -> str:
    """``chi2_tail`` with as many terms as the statistic needs."""
    return chi2_tail(x, df, f"400 + try_cast(ceil({x}) as bigint)")


def f_tail(f: str, d1: str, d2: str) -> str:
    """SQL of the upper tail of F at whole degrees of freedom: a finite sum, which at an odd first one begins with the tail of t."""
    a, x = f"({d2} / 2.0)", f"({d2} / ({d2} + {d1} * ({f})))"
    even = f"coalesce(list_sum(list_transform(range(0, cast({d1} // 2 as bigint)), lambda j: exp({a} * ln({x}) + j * ln(1 - {x}) + lgamma({a} + j) - lgamma({a}) - lgamma(j + 1)))), 0)"
    odd = f"coalesce(list_sum(list_transform(range(0, cast({d1} // 2 as bigint)), lambda j: exp({a} * ln({x}) + (j + 0.5) * ln(1 - {x}) + lgamma({a} + j + 0.5) - lgamma({a}) - lgamma(j + 1.5)))), 0)"
    return f"case when ({f}) <= 0 then 1 when {d1} % 2 = 0 then {even} else {t_tail(f'sqrt({d1} * ({f}))', d2)} + {odd} end"


def register(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["alarm_by_config"](spark, sf_dir)


def _load() -> None:
    from . import alarms, audits, cells, decisions, hazards, inference, logs, points, reruns, resampling  # noqa: F401
