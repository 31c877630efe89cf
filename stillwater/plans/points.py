"""Queries at several operating points, by layer and between two score sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import points as P
from .registry import FRAMES, RUNS, register
from .views import frames, runs, spread, table, with_onset

GRID = list(range(1000, 10000, 500))
TARGETS = {"op5": 0.05, "op20": 0.2, "op50": 0.5}

_POINTS = f"""{FRAMES}, p0 as (select *, cast(round(value * 100) as int) as score from fo),
    g as (select unnest(range(1000, 10000, 500)) as threshold), tg(point, target) as (values ('op5', 0.05), ('op20', 0.2), ('op50', 0.5)),
    sh as (select model, g.threshold, avg((score >= g.threshold)::int) as share from p0, g where t_post < t_onset group by model, g.threshold),
    pt as (select model, point, cast(min(threshold) as int) as threshold from sh join tg on share <= target group by model, point)"""
_AT = f"""{_POINTS}, q0 as (select p0.*, point, threshold, case when score >= threshold then 1 else 0 end as q from p0 join pt using (model)),
    q1 as (select *, sum(1 - q) over (partition by run_id, point order by t_post, frame_idx) as brk from q0),
    q2 as (select *, case when q = 1 then sum(q) over (partition by run_id, point, brk order by t_post, frame_idx) else 0 end as streak from q1),
    ra as (select run_id, config, model, point, coalesce(bool_or(streak >= 3 and t_post >= t_onset), false) as hit,
           coalesce(bool_or(streak >= 3 and t_post < t_onset), false) as fp_pre from q2 group by run_id, config, model, point)"""


def _scored(spark, sf_dir):
    return with_onset(frames(spark, sf_dir)).withColumn("score", F.round(F.col("value") * 100).cast("int"))


def _points(spark, sf_dir):
    before = _scored(spark, sf_dir).filter(F.col("t_post") < F.col("t_onset"))
    return P.share_thresholds(before, ["model"], "score", GRID, TARGETS)


def _at_points(spark, sf_dir):
    found = P.runs_at_points(_scored(spark, sf_dir), _points(spark, sf_dir), ["model"], ["run_id", "config", "model"], ["t_post", "frame_idx"], "score", "t_post", "t_onset", 3)
    return found.withColumn("hit", F.col("t_fire").isNotNull())


@register(f"with {_POINTS} select model, point, cast(replace(point, 'op', '') as double) as target_pct, threshold from pt")
def threshold_table(spark, sf_dir):
    return _points(spark, sf_dir).select("model", "point", P.point_target("point").alias("target_pct"), "threshold")


@register(f"with {_POINTS} select point, model, threshold from pt where point in (select point from pt group by point having count(distinct model) >= 3)")
def complete_points(spark, sf_dir):
    return P.complete(_points(spark, sf_dir), "model", 3).select("point", "model", "threshold")


@register(f"with {_AT} select point, config, count(*) as n_runs, count(*) filter (where hit) as n_hits, count(*) filter (where fp_pre) as n_false from ra group by point, config")
def runs_at_points(spark, sf_dir):
    return _at_points(spark, sf_dir).groupBy("point", "config").agg(F.count("*").alias("n_runs"), F.count_if("hit").alias("n_hits"), F.count_if("fp_pre").alias("n_false"))


@register(f"""with {_AT}, h as (select model, point, round(100 * avg(hit::int), 6) as pct from ra group by model, point)
    select model, max(pct) filter (where point = 'op5') as op5, max(pct) filter (where point = 'op20') as op20, max(pct) filter (where point = 'op50') as op50 from h group by model""")
def points_side_by_side(spark, sf_dir):
    return P.side_by_side(_at_points(spark, sf_dir), ["model"], list(TARGETS), F.round(100 * F.avg(F.col("hit").cast("int")), 6))


@register(f"""with {_AT}, h as (select config, model, avg(fp_pre::int) as share from ra where point = 'op20' group by config, model)
    select config, round(avg(share), 6) as mean_share from h group by config""")
def mean_false_share(spark, sf_dir):
    by_model = _at_points(spark, sf_dir).filter("point = 'op20'").groupBy("config", "model").agg(F.avg(F.col("fp_pre").cast("int")).alias("share"))
    return by_model.groupBy("config").agg(F.round(F.avg("share"), 6).alias("mean_share"))


@register(f"""with {RUNS} select config, count(*) as n_hits, round(avg(ttd), 6) as mean_ttd, round(avg(t_first), 6) as mean_first, round(avg(accum), 6) as mean_accum from r where hit and n_post > 0 group by config""")
def decomposition_means(spark, sf_dir):
    """Hits of valid runs only: the mean delay and its two parts."""
    valid = runs(spark, sf_dir).filter(F.col("hit") & (F.col("n_post") > 0))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return valid.groupBy("config").agg(F.count("*").alias("n_hits"), mean("ttd", "mean_ttd"), mean("t_first", "mean_first"), mean("accum", "mean_accum"))


@register(f"""with {RUNS} select scenario, count(*) as n_runs, count(ttd) as n_hits, case when count(ttd) > 0 then 'ttd' else 'followup' end as source,
    round(case when count(ttd) > 0 then avg(ttd) else avg(followup) end, 4) as mean_h, round(case when count(ttd) > 0 then median(ttd) else median(followup) end, 4) as median_h from r group by scenario""")
def describe_scenarios(spark, sf_dir):
    """Mean and median delay; of scenarios without a hit, those of the follow-up."""
    some = F.count("ttd") > 0
    pick = lambda f, name: F.round(F.when(some, f("ttd")).otherwise(f("followup")), 4).alias(name)
    return runs(spark, sf_dir).groupBy("scenario").agg(F.count("*").alias("n_runs"), F.count("ttd").alias("n_hits"), F.when(some, "ttd").otherwise("followup").alias("source"), pick(F.avg, "mean_h"), pick(F.median, "median_h"))


@register(f"""with {RUNS}, m as (select *, case model when 0 then 'small' when 1 then 'medium' else 'large' end as size from r),
    l as (select size as layer, hit, case size when 'small' then 1 when 'medium' then 2 else 3 end as place from m
          union all by name select 'compact' as layer, hit, 4 as place from m where size in ('small', 'medium') union all by name select 'POOLED' as layer, hit, 5 as place from m)
    select layer, cast(place as bigint) as place, count(*) as n_runs, round(100 * avg(hit::int), 6) as hit_pct from l group by layer, place""")
def layers_and_pooled(spark, sf_dir):
    m = runs(spark, sf_dir).withColumn("size", F.element_at(F.array(F.lit("small"), F.lit("medium"), F.lit("large")), F.col("model") + 1)).select("size", "hit")
    rows = P.layers_and_pooled(m, "size", ["small", "medium", "large"], {"compact": ["small", "medium"]})
    return rows.groupBy("layer", "place").agg(F.count("*").alias("n_runs"), F.round(100 * F.avg(F.col("hit").cast("int")), 6).alias("hit_pct")).orderBy("place")


@register(f"""with {FRAMES}, n as (select run_id, count(*) as n, count(*) filter (where t_post < t_onset) as before, any_value(t_onset) as t from fo group by run_id),
    w as (select case when t is null then 'no onset' when before < 4 then 'too early' when before >= n - 3 then 'too late' end as reason from n)
    select coalesce(reason, 'usable') as reason, count(*) as n_runs from w group by 1""")
def onset_feasibility(spark, sf_dir):
    f = with_onset(frames(spark, sf_dir)).groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("t_post") < F.col("t_onset")).alias("before"), F.max("t_onset").alias("t"))
    start = F.when(F.col("t").isNotNull(), F.col("before"))
    return f.groupBy(F.coalesce(P.onset_reason(start, F.col("n"), 4, 3), F.lit("usable")).alias("reason")).agg(F.count("*").alias("n_runs"))


def _sources(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_returnflag"]
    li = spread(table(spark, sf_dir, "lineitem").select(*key, "l_discount", "l_tax"), key).groupBy(*key).agg(F.max("l_discount").alias("x"), F.max("l_tax").alias("y"))
    return li.select(*key, "x"), li.select(*key, "y")


_PAIRS = "li as (select l_orderkey, l_linenumber, l_returnflag, max(l_discount) as x, max(l_tax) as y from lineitem group by all)"


@register(f"with {_PAIRS} select l_returnflag as model, count(*) as n, round(avg(abs(x - y)), 9) as mean_abs, round(max(abs(x - y)), 9) as max_abs, round(max(abs(x - y)), 9) < 0.095 as passed from li group by l_returnflag")
def keyed_score_agreement(spark, sf_dir):
    a, b = _sources(spark, sf_dir)
    return P.keyed_agreement(a, b, ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_returnflag"], "x", "y", 0.095).withColumnRenamed("l_returnflag", "model")


@register(f"with {_PAIRS} select l_orderkey, l_linenumber, l_returnflag, round(x - y, 9) as d from li order by round(abs(x - y), 9) desc, l_orderkey, l_linenumber, l_returnflag limit 25")
def largest_disagreements(spark, sf_dir):
    """The limit is the report's: the largest differences first."""
    a, b = _sources(spark, sf_dir)
    met = a.join(b, ["l_orderkey", "l_linenumber", "l_returnflag"]).withColumn("d", F.round(F.col("x") - F.col("y"), 9))
    return met.orderBy(F.round(F.abs(F.col("x") - F.col("y")), 9).desc(), "l_orderkey", "l_linenumber", "l_returnflag").limit(25).select("l_orderkey", "l_linenumber", "l_returnflag", "d")
