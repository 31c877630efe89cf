"""Queries on switched score sources, traces of runs, reruns, foreign processes and the robustness of a verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reruns as R
from ..operators.sequence import with_streak
from .registry import RUNS, STREAKS, register
from .views import frames, runs, table, with_onset

#: Score source of each model and configuration: N takes the tax, but not where the line is F.
CHOSEN = [("A", "F", "discount"), ("R", "F", "discount"), ("N", "F", "discount"), ("N", "O", "tax")]
#: Shifts of the onset in hours.
SHIFTS = [-48, -24, 0, 24, 48]


@register("""with u as (select l_returnflag as model, l_linestatus as config, cast(round(l_discount * 100) as int) as score, 'discount' as variant from lineitem
    union all select l_returnflag, l_linestatus, cast(round(l_tax * 100) as int), 'tax' from lineitem),
    m(model, config, variant) as (values ('A', 'F', 'discount'), ('R', 'F', 'discount'), ('N', 'F', 'discount'), ('N', 'O', 'tax'))
    select model, config, variant, count(*) as n, count(*) filter (where score >= 5) as n_over, cast(sum(score) as bigint) as total from u join m using (model, config, variant) group by all""")
def source_switch(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    source = lambda c: li.select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("config"), F.round(F.col(c) * 100).cast("int").alias("score"))
    chosen = F.broadcast(spark.createDataFrame(CHOSEN, "model string, config string, variant string"))
    rows = R.switched({"discount": source("l_discount"), "tax": source("l_tax")}, chosen, ["model", "config"])
    return rows.groupBy("model", "config", "variant").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 5).alias("n_over"), F.sum("score").alias("total"))


@register(f"""with {RUNS} select f.config, count(distinct f.run_id) as n_runs, count(*) as n_frames, count(*) filter (where f.t_post >= r.t_fire) as n_after
    from f join r on f.run_id = r.run_id where r.n_post > 0 group by f.config""")
def traces_of_runs(spark, sf_dir):
    """Frames of valid runs, and how many come at the alarm or later."""
    valid = runs(spark, sf_dir).filter("n_post > 0")
    met = R.traces_of_runs(frames(spark, sf_dir).select("run_id", "config", "t_post"), valid, "run_id", "t_fire")
    by_run = met.groupBy("config", "run_id").agg(F.count("*").alias("n"), F.count_if(F.col("t_post") >= F.col("t_fire")).alias("after"))
    return by_run.groupBy("config").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_frames"), F.sum("after").alias("n_after"))


@register(f"""with a as (with {RUNS} select * from r), b as (with {RUNS.replace("value >= 60", "value >= 40")} select * from r)
    select a.config, count(*) as n_runs, count(*) filter (where a.hit and b.hit) as n_both, count(*) filter (where b.hit and not a.hit) as n_gained,
    count(*) filter (where a.hit and not b.hit) as n_lost, cast(sum(round((b.ttd - a.ttd) * 1e6)) as bigint) as moved_uh
    from a join b using (run_id) where a.n_post > 0 and b.n_post > 0 group by a.config""")
def frozen_and_rerun(spark, sf_dir):
    """Runs at the frozen threshold beside the same runs at a lower one; the move of the delay is summed in whole microhours."""
    met = R.beside(runs(spark, sf_dir), runs(spark, sf_dir, threshold=40.0), "run_id", "n_post", ["hit", "ttd"])
    moved = F.round((F.col("ttd_rerun") - F.col("ttd")) * 1e6).cast("long")
    both, gained, lost = F.col("hit") & F.col("hit_rerun"), ~F.col("hit") & F.col("hit_rerun"), F.col("hit") & ~F.col("hit_rerun")
    return met.groupBy("config").agg(F.count("*").alias("n_runs"), F.count_if(both).alias("n_both"), F.count_if(gained).alias("n_gained"), F.count_if(lost).alias("n_lost"), F.sum(moved).alias("moved_uh"))


@register("""with l as (select l_orderkey, min(l_linestatus) as lo, max(l_linestatus) as hi from lineitem group by l_orderkey),
    m as (select o_orderpriority, lo = o_orderstatus and hi = o_orderstatus as clean from orders left join l on l_orderkey = o_orderkey)
    select o_orderpriority, count(*) as n_runs, count(*) filter (where clean) as n_clean, count(*) filter (where clean is null) as n_unknown, count(*) filter (where clean) >= 30 as enough
    from m group by o_orderpriority""")
def foreign_process_filter(spark, sf_dir):
    """Orders as runs, the states of their lines as processes seen: clean if there is no state but the order's own."""
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_linestatus").alias("seen"))
    met = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(seen, "o_orderkey", "left")
    judged = met.withColumn("clean", R.own_only(F.col("seen"), F.col("o_orderstatus")))
    out = judged.groupBy("o_orderpriority").agg(F.count("*").alias("n_runs"), F.count_if("clean").alias("n_clean"), F.count_if(F.col("clean").isNull()).alias("n_unknown"))
    return out.withColumn("enough", F.col("n_clean") >= 30)


@register(f"""with {STREAKS}, e as (select run_id, config, max(t_onset) as t_onset, max(t_post) filter (where streak >= 3) as t_end from s group by run_id, config),
    h as (select config, h.shift, count(*) as n, count(*) filter (where t_end >= t_onset + h.shift * 3600000000000) as x
          from e, (select unnest([-48, -24, 0, 24, 48]) as shift) h where t_onset is not null group by config, h.shift),
    v as (select a.config, a.shift, sign(a.x * b.n - b.x * a.n) as side,
          pow(a.x / a.n - b.x / b.n, 2) > 3.841459 * ((a.x + b.x) / (a.n + b.n)) * (1 - (a.x + b.x) / (a.n + b.n)) * (1 / a.n + 1 / b.n) as significant
          from h a join h b on a.shift = b.shift and b.config = 0 where a.config > 0)
    select m.config, count(*) as n_shifts, bool_and(m.side = z.side and m.significant = z.significant) as robust
    from v m join v z on m.config = z.config and z.shift = 0 where m.shift <> 0 group by m.config""")
def shift_robustness(spark, sf_dir):
    """Hit shares against configuration 0 with the onset moved: whether each move keeps the side of 1 and the significance of the ratio.

    A run hits at a shift if its last time in alarm is not before the moved onset, so one row a run meets the shifts.
    """
    f = with_streak(with_onset(frames(spark, sf_dir)), ["run_id"], ["t_post", "frame_idx"], F.col("value") >= 60)
    ends = f.groupBy("run_id", "config").agg(F.max("t_onset").alias("t_onset"), F.max(F.when(F.col("streak") >= 3, F.col("t_post"))).alias("t_end")).filter("t_onset is not null")
    at = ends.select("config", "t_onset", "t_end", F.explode(F.array(*map(F.lit, SHIFTS))).alias("shift"))
    moved = F.col("t_onset") + F.col("shift").cast("long") * F.lit(3600000000000)
    h = at.groupBy("config", "shift").agg(F.count("*").alias("n"), F.count_if(F.col("t_end") >= moved).alias("x"))
    b = h.filter("config = 0").select("shift", F.col("n").alias("m"), F.col("x").alias("y"))
    p, q = F.col("x") / F.col("n"), F.col("y") / F.col("m")
    pooled = (F.col("x") + F.col("y")) / (F.col("n") + F.col("m"))
    significant = F.pow(p - q, F.lit(2)) > 3.841459 * pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("m"))
    v = h.filter("config > 0").join(b, "shift").select("config", "shift", F.signum(F.col("x") * F.col("m") - F.col("y") * F.col("n")).alias("side"), significant.alias("significant"))
    return R.robust(v, ["config"], "shift", F.lit(0), "side", "significant")
