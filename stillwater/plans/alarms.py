"""Queries on alarm rules, thresholds and false-alarm rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import tails
from ..operators import calibrate as C
from ..operators import compare as T
from ..operators import sequence as S
from .registry import CORPUS, FRAMES, RUNS, STREAKS, poisson_limit, register
from .views import CORPUS_ORDER, corpus, frames, runs, table, with_onset

#: The order of a corpus sequence in SQL.
SEQ = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
#: Episodes of at least three scores at or above each threshold 1 to 10, one pass for each.
EPISODES = f"""{CORPUS},
g as (select cast(unnest(range(1, 11)) as int) as threshold),
e0 as (select c.*, threshold, case when score >= threshold then 1 else 0 end as q from c cross join g),
e1 as (select *, sum(1 - q) over (partition by model, clip, threshold order by {SEQ}) as brk from e0),
e2 as (select model, threshold, clip, brk, sum(q) as n from e1 group by all),
e as (select model, threshold, count(*) filter (where n >= 3) as n_episodes from e2 group by model, threshold)"""
HOURS = "h as (select model, sum(l_quantity) / 60.0 as hours from c group by model)"


def grid(spark: SparkSession, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "threshold int")


@register(f"with {RUNS} select config, count(*) as n, count(*) filter (where hit) as hits, count(*) filter (where fp_pre) as fp, round(median(ttd), 6) as median_ttd from r group by config")
def alarm_by_config(spark, sf_dir):
    aggregates = [F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.count_if("fp_pre").alias("fp")]
    out = T.with_quantiles(runs(spark, sf_dir).select("config", "hit", "fp_pre", "ttd"), ["config"], aggregates, "ttd", {"median_ttd": 0.5})
    return out.withColumn("median_ttd", F.round("median_ttd", 6))


@register(f"with {RUNS} select run_id, config, model, scenario, hit, fp_pre, ttd, followup, t_first, t_single, accum, duration, n_post, n_qualifying_post from r")
def run_table(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", "config", "model", "scenario", "hit", "fp_pre", "ttd", "followup", "t_first", "t_single", "accum", "duration", "n_post", "n_qualifying_post")


@register(f"with {STREAKS} select run_id, frame_idx, streak from s")
def streaks(spark, sf_dir):
    return S.with_streak(frames(spark, sf_dir), ["run_id"], ["t_post", "frame_idx"], F.col("value") >= 60).select("run_id", "frame_idx", "streak")


@register(f"""with {FRAMES},
    q as (select *, lag(t_post, 2) over (partition by run_id order by t_post, frame_idx) as t0 from fo where value >= 60)
    select run_id, t_window from (select distinct run_id from f) left join
    (select run_id, min(t_post) as t_window from q where t_post - t0 <= 86400000000000 and t_post >= t_onset group by run_id) using (run_id)""")
def alarm_in_window(spark, sf_dir):
    return S.windowed_fire(with_onset(frames(spark, sf_dir)), ["run_id"], ["t_post", "frame_idx"], "t_post", "t_onset", F.col("value") >= 60, 3, 86_400_000_000_000)


@register(f"""with {RUNS},
    q as (select *, lag(t_post, 2) over (partition by run_id order by t_post, frame_idx) as t0 from fo where value >= 60),
    w as (select run_id, true as win from q where t_post - t0 <= 86400000000000 and t_post >= t_onset group by run_id)
    select config, round(100 * avg(hit::int), 6) as consecutive, round(100 * avg((n_qualifying_post > 0)::int), 6) as single, round(100 * avg(coalesce(win, false)::int), 6) as in_window from r left join w using (run_id) group by config""")
def rule_ablation(spark, sf_dir):
    win = alarm_in_window(spark, sf_dir)
    pct = lambda c, name: F.round(100 * F.avg(c.cast("int")), 6).alias(name)
    return runs(spark, sf_dir).join(win, "run_id", "left").groupBy("config").agg(pct(F.col("hit"), "consecutive"), pct(F.col("n_qualifying_post") > 0, "single"), pct(F.col("t_window").isNotNull(), "in_window"))


@register(f"""with {RUNS}, p as (select config, 100.0 * avg(hit::int) as rate, median(accum) as residual from r group by config)
    select round(max(rate) - min(rate), 6) as gap, round(max(rate) filter (where config = 0) - max(rate) filter (where config = 4), 6) as first_minus_last, round(min(residual), 6) as least_residual, round(max(residual), 6) as most_residual from p""")
def config_gap(spark, sf_dir):
    p = T.with_quantiles(runs(spark, sf_dir).select("config", "hit", "accum"), ["config"], [(100.0 * F.avg(F.col("hit").cast("int"))).alias("rate")], "accum", {"residual": 0.5})
    at = lambda k: F.max(F.when(F.col("config") == k, F.col("rate")))
    return p.agg(F.round(F.max("rate") - F.min("rate"), 6).alias("gap"), F.round(at(0) - at(4), 6).alias("first_minus_last"), F.round(F.min("residual"), 6).alias("least_residual"), F.round(F.max("residual"), 6).alias("most_residual"))


@register(f"""with {RUNS}, p as (select config, 100.0 * avg(hit::int) as rate from r group by config)
    select string_agg(cast(config as varchar), ' > ' order by rate desc, config) as ranking from p""")
def config_ranking(spark, sf_dir):
    p = runs(spark, sf_dir).groupBy("config").agg(F.avg(F.col("hit").cast("int")).alias("rate"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("rate")).alias("r"), F.col("config").cast("string").alias("c"))))
    return p.agg(F.array_join(F.transform(order, lambda x: x.c), " > ").alias("ranking"))


@register(f"with {EPISODES} select * from e")
def episode_curve(spark, sf_dir):
    """Every threshold from one pass over the scores."""
    return S.episodes_by_threshold(corpus(spark, sf_dir), ["model"], ["model", "clip"], CORPUS_ORDER, "score", 3, grid(spark, range(1, 11))).select("model", "threshold", "n_episodes")


@register(f"""with {CORPUS}, d as (select *, cast(floor(l_extendedprice / 600) as int) as price from c), g as (select cast(unnest(range(1, 181)) as int) as threshold),
    e0 as (select model, clip, threshold, {SEQ}, case when price >= threshold then 1 else 0 end as q from d cross join g),
    e1 as (select *, sum(1 - q) over (partition by model, clip, threshold order by {SEQ}) as brk from e0), e2 as (select model, threshold, clip, brk, sum(q) as n from e1 group by all)
    select model, threshold, count(*) filter (where n >= 3) as n_episodes from e2 group by model, threshold""")
def episode_curve_fine(spark, sf_dir):
    """The sweep at its full width: 180 thresholds from one pass over the scores."""
    c = corpus(spark, sf_dir).withColumn("price", F.floor(F.col("l_extendedprice") / 600).cast("int"))
    return S.episodes_by_threshold(c, ["model"], ["model", "clip"], CORPUS_ORDER, "price", 3, grid(spark, range(1, 181))).select("model", "threshold", "n_episodes")


@register(f"""with {CORPUS}, q as (select *, case when score >= 7 then 1 else 0 end as q from c),
    b as (select *, sum(1 - q) over (partition by model, clip order by {SEQ}) as brk from q),
    i as (select model, clip, brk, sum(q) as n from b group by all)
    select model, clip, count(*) filter (where n >= 3) as n_episodes from i group by model, clip""")
def episodes_by_clip(spark, sf_dir):
    return S.episodes(corpus(spark, sf_dir), ["model", "clip"], CORPUS_ORDER, F.col("score") >= 7, 3)


@register(f"""with {FRAMES}, g as (select cast(unnest([30, 50, 60, 80]) * 100 as int) as threshold),
    s0 as (select fo.*, threshold, case when cast(round(value * 100) as int) >= threshold then 1 else 0 end as q from fo cross join g),
    s1 as (select *, sum(1 - q) over (partition by run_id, threshold order by t_post, frame_idx) as brk from s0),
    s as (select *, case when q = 1 then sum(q) over (partition by run_id, threshold, brk order by t_post, frame_idx) else 0 end as streak from s1)
    select run_id, threshold, coalesce(bool_or(streak >= 3 and t_post >= t_onset), false) as hit, coalesce(bool_or(streak >= 3 and t_post < t_onset), false) as fp_pre,
           min(t_post) filter (where streak >= 3 and t_post >= t_onset) as t_fire from s group by run_id, threshold""")
def alarm_sweep(spark, sf_dir):
    f = with_onset(frames(spark, sf_dir)).withColumn("score", F.round(F.col("value") * 100).cast("int"))
    return S.alarms_by_threshold(f, ["run_id"], ["t_post", "frame_idx"], "score", "t_post", "t_onset", 3, grid(spark, [3000, 5000, 6000, 8000]))


_SWEEP = f"""{FRAMES}, g as (select cast(unnest(range(10, 100, 10)) * 100 as int) as threshold),
    s0 as (select fo.*, threshold, case when cast(round(value * 100) as int) >= threshold then 1 else 0 end as q from fo cross join g),
    s1 as (select *, sum(1 - q) over (partition by run_id, threshold order by t_post, frame_idx) as brk from s0),
    s as (select *, case when q = 1 then sum(q) over (partition by run_id, threshold, brk order by t_post, frame_idx) else 0 end as streak from s1),
    x as (select run_id, model, threshold, coalesce(bool_or(streak >= 3 and t_post >= t_onset), false) as hit, coalesce(bool_or(streak >= 3 and t_post < t_onset), false) as fp_pre,
          min(t_post - t_onset) filter (where streak >= 3 and t_post >= t_onset) as ttd from s group by run_id, model, threshold),
    y as (select model, threshold, round(100 * avg(hit::int), 6) as hit_pct, round(100 * avg(fp_pre::int), 6) as fp_pct, round(median(ttd) / 3.6e12, 6) as median_ttd from x group by model, threshold)"""


def _sweep(spark, sf_dir):
    f = with_onset(frames(spark, sf_dir)).withColumn("score", F.round(F.col("value") * 100).cast("int"))
    a = S.alarms_by_threshold(f, ["run_id", "model", "t_onset"], ["t_post", "frame_idx"], "score", "t_post", "t_onset", 3, grid(spark, [100 * t for t in range(10, 100, 10)]))
    a = a.select("model", "threshold", "hit", "fp_pre", (F.col("t_fire") - F.col("t_onset")).alias("delay"))
    aggregates = [F.round(100 * F.avg(F.col(c).cast("int")), 6).alias(n) for c, n in (("hit", "hit_pct"), ("fp_pre", "fp_pct"))]
    out = T.with_quantiles(a, ["model", "threshold"], aggregates, "delay", {"median_ttd": 0.5})
    return out.withColumn("median_ttd", F.round(F.col("median_ttd") / F.lit(3.6e12), 6))


@register(f"with {_SWEEP} select * from y")
def sweep_rates(spark, sf_dir):
    return _sweep(spark, sf_dir)


@register(f"""with {_SWEEP}, t as (select unnest([5.0, 20.0, 60.0]) as target),
    z as (select *, row_number() over (partition by model, target order by abs(fp_pct - target), threshold) as k from y cross join t)
    select model, cast(target as double) as target, threshold, fp_pct from z where k = 1""")
def matched_threshold(spark, sf_dir):
    targets = spark.createDataFrame([(5.0,), (20.0,), (60.0,)], "target double")
    return C.matched(_sweep(spark, sf_dir), ["model"], "fp_pct", targets)


def _curve(spark, sf_dir):
    hours = corpus(spark, sf_dir).groupBy("model").agg((F.sum("l_quantity") / 60.0).alias("hours"))
    return C.rate_curve(episode_curve(spark, sf_dir), hours, ["model"])


@register(f"with {EPISODES}, {HOURS} select model, threshold, n_episodes, round(n_episodes / hours, 6) as far_h from e join h using (model)")
def far_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select("model", "threshold", "n_episodes", F.round("far_h", 6).alias("far_h"))


@register(f"""with {EPISODES}, {HOURS}, t as (select cast(unnest([0.05, 0.2, 0.5]) as double) as target)
    select model, target, min(threshold) as threshold, round(min_by(n_episodes / hours, threshold), 6) as achieved, min_by(n_episodes, threshold) as n_episodes
    from e join h using (model) join t on n_episodes / hours <= target group by model, target""")
def far_calibration(spark, sf_dir):
    targets = spark.createDataFrame([(0.05,), (0.2,), (0.5,)], "target double")
    return C.calibrate(_curve(spark, sf_dir), ["model"], targets).withColumn("achieved", F.round("achieved", 6))


@register(f"""with {EPISODES}, {HOURS}, l as (select n_episodes, case when n_episodes > 0 then {poisson_limit("(n_episodes - 1)", "0.975")} else 0 end as low, {poisson_limit("n_episodes", "0.025")} as high from (select distinct n_episodes from e))
    select model, threshold, n_episodes / hours as far_h, round(low / hours, 6) as low, round(high / hours, 6) as high from e join h using (model) join l using (n_episodes)""")
def far_intervals(spark, sf_dir):
    """Exact Poisson limits of each rate."""
    n, h = F.col("n_episodes").cast("double"), F.col("hours")
    return _curve(spark, sf_dir).select("model", "threshold", "far_h", F.round(tails.garwood_low()(n) / h, 6).alias("low"), F.round(tails.garwood_high()(n) / h, 6).alias("high"))


@register(f"""with {RUNS}, n as (select model, config, sum(fp_pre::int) / 360.0 as lam from r group by model, config)
    select model, config, round(avg(1 - exp(-lam * followup)), 6) as chance, round(avg(hit::int), 6) as hit_share from r join n using (model, config) group by model, config""")
def chance_level(spark, sf_dir):
    r = runs(spark, sf_dir)
    n = r.groupBy("model", "config").agg((F.sum(F.col("fp_pre").cast("int")) / 360.0).alias("lam"))
    p = X.chance_of_hit(F.col("lam"), F.col("followup") * F.lit(3.6e6))
    return r.join(n, ["model", "config"]).groupBy("model", "config").agg(F.round(F.avg(p), 6).alias("chance"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_share"))


@register(f"""with {STREAKS}, d as (select unnest([-48, -24, 0, 24, 48]) as shift_h)
    select shift_h, count(distinct run_id) as n, count(distinct run_id) filter (where streak >= 3 and t_post >= t_onset + shift_h * 3600000000000) as hits from s cross join d group by shift_h""")
def onset_shift(spark, sf_dir):
    shifts = spark.createDataFrame([(h,) for h in (-48, -24, 0, 24, 48)], "shift_h int")
    s = S.with_streak(with_onset(frames(spark, sf_dir)), ["run_id"], ["t_post", "frame_idx"], F.col("value") >= 60)
    # the last firing frame of a run decides every shift
    last = s.groupBy("run_id").agg(F.max(F.when(F.col("streak") >= 3, F.col("t_post") - F.col("t_onset"))).alias("last"))
    hit = F.coalesce(F.col("last") >= F.col("shift_h").cast("long") * 3_600_000_000_000, F.lit(False))
    return last.crossJoin(F.broadcast(shifts)).groupBy("shift_h").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))


@register(f"""with {FRAMES}, p as (select config, count(*) / 720.0 as rate from f group by config), t as (select cast(unnest([0.1, 0.5, 2.0]) as double) as dwell)
    select config, dwell, cast(greatest(1, ceil(round(dwell * rate, 6))) as bigint) as k, round(greatest(1, ceil(round(dwell * rate, 6))) / rate, 6) as realised, dwell < (select round(1 / min(rate), 3) from p) as too_short from p cross join t""")
def dwell_rules(spark, sf_dir):
    rates = frames(spark, sf_dir).groupBy("config").agg((F.count("*") / 720.0).alias("rate"))
    t = spark.createDataFrame([(0.1,), (0.5,), (2.0,)], "dwell double")
    k = X.dwell_frames(F.col("dwell"), F.col("rate"))
    least = F.broadcast(rates.agg(F.round(1 / F.min("rate"), 3).alias("_least")))
    return rates.crossJoin(F.broadcast(t)).crossJoin(least).select("config", "dwell", k.alias("k"), F.round(k / F.col("rate"), 6).alias("realised"), (F.col("dwell") < F.col("_least")).alias("too_short"))


@register(f"""with {CORPUS}, n as (select *, row_number() over (partition by model, clip order by {SEQ}) - 1 as k from c), v as (select *, (k % 3 = 0) as keep from n),
    q as (select *, case when score >= 5 then 1 else 0 end as q from v where keep),
    b as (select *, sum(1 - q) over (partition by model, clip order by {SEQ}) as brk from q), i as (select model, clip, brk, sum(q) as n from b group by all)
    select model, count(*) filter (where n >= 2) as n_episodes from i group by model""")
def lower_frame_rate(spark, sf_dir):
    low = S.every_nth(corpus(spark, sf_dir), ["model", "clip"], CORPUS_ORDER, 3)
    return S.episodes(low, ["model", "clip"], CORPUS_ORDER, F.col("score") >= 5, 2).groupBy("model").agg(F.sum("n_episodes").alias("n_episodes"))


@register(f"""with {FRAMES}, j as (select run_id, cast(json_extract_string(props, '$.k') as bigint) as k, t_post from f)
    select run_id, count(*) as n_frames, round(avg((k * 1000000) / 1e6), 6) as acquisition_ms, round(avg(((100 - k) * 500000) / 1e6), 6) as inference_ms,
           round(median((k * 1000000 + (100 - k) * 500000) / 1e6), 6) as median_ms, max(k * 1000000 + (100 - k) * 500000) as longest_ns from j group by run_id""")
def latency_parts(spark, sf_dir):
    """Stage latencies from stamps in whole nanoseconds; the stamps are made from the property ``k``."""
    k = F.get_json_object("props", "$.k").cast("long")
    f = frames(spark, sf_dir).withColumns({"t_capture": F.col("t_post") - k * 1_000_000 - (100 - k) * 500_000, "t_infer": F.col("t_post") - (100 - k) * 500_000})
    acq, inf, both = X.ms(F.col("t_infer"), F.col("t_capture")), X.ms(F.col("t_post"), F.col("t_infer")), X.ms(F.col("t_post"), F.col("t_capture"))
    return f.groupBy("run_id").agg(F.count("*").alias("n_frames"), F.round(F.avg(acq), 6).alias("acquisition_ms"), F.round(F.avg(inf), 6).alias("inference_ms"), F.round(F.median(both), 6).alias("median_ms"), F.max(F.col("t_post") - F.col("t_capture")).alias("longest_ns"))


@register(f"""with {FRAMES} select run_id, count(distinct frame_idx) as n_frames, count(*) filter (where cls = 'error') as n_drops,
    round(count(*) filter (where cls = 'error') / greatest(1, count(*)), 6) as drop_rate from f group by run_id""")
def loss_accounting(spark, sf_dir):
    d = F.count_if(F.col("cls") == "error")
    return frames(spark, sf_dir).groupBy("run_id").agg(F.countDistinct("frame_idx").alias("n_frames"), d.alias("n_drops"), F.round(X.drop_rate(d, F.count("*") - d), 6).alias("drop_rate"))


@register(f"""with {FRAMES}, e as (select *, row_number() over (partition by run_id order by t_post, frame_idx) - 1 as i, count(*) over (partition by run_id) as n from f),
    p as (select distinct run_id, n, cast(round_even(j * (n - 1) / 6.0, 0) as bigint) as i from e cross join (select unnest(range(0, 7)) as j) where n > 7)
    select run_id, frame_idx from e where n <= 7 or exists (select 1 from p where p.run_id = e.run_id and p.i = e.i)""")
def evenly_spaced_frames(spark, sf_dir):
    return S.evenly_spaced(frames(spark, sf_dir), ["run_id"], ["t_post", "frame_idx"], 7).select("run_id", "frame_idx")


@register(f"""with {FRAMES}, e as (select *, row_number() over (partition by config order by run_id, t_post, frame_idx) - 1 as i from f)
    select config, run_id, frame_idx from e where i >= 3 and (i - 3) % 11 = 0""")
def manifest_slice(spark, sf_dir):
    return S.stride_slice(frames(spark, sf_dir), ["run_id", "t_post", "frame_idx"], 3, 11, ["config"]).select("config", "run_id", "frame_idx")


@register(f"""with {FRAMES}, m as (select run_id, min(t_post) filter (where cls = 'error' and value >= 90) as t0 from f group by run_id)
    select run_id, case when t_post >= t0 then 'after' else 'before' end as regime, count(*) as n from f join m using (run_id) group by 1, 2""")
def regimes(spark, sf_dir):
    f = S.regime_from_first(frames(spark, sf_dir), ["run_id"], "t_post", (F.col("cls") == "error") & (F.col("value") >= 90), "before", "after")
    return f.groupBy("run_id", "regime").agg(F.count("*").alias("n"))


@register(f"""with {FRAMES} select run_id, cls, frame_idx, round(cume_dist() over (partition by run_id order by value), 9) as share from f""")
def value_ecdf(spark, sf_dir):
    return S.ecdf(frames(spark, sf_dir), ["run_id"], "value").select("run_id", "cls", "frame_idx", F.round("share", 9).alias("share"))


@register(f"""with {FRAMES}, d as (select distinct config, model from f), p as (select unnest(['none', 'lan', '4g']) as profile), m as (
    select config, model, profile, row_number() over (order by config, profile, model) - 1 as cell from d cross join p)
    select config, model, profile, cell, 42 + cell as seed, case when profile = 'none' then cast(config as varchar) else config || '-' || profile end as label from m""")
def experiment_matrix(spark, sf_dir):
    """All cells in a fixed order with index, seed and label; a table of dimensions."""
    dims = frames(spark, sf_dir).select("config", "model").distinct()
    m = dims.crossJoin(F.broadcast(spark.createDataFrame([("none",), ("lan",), ("4g",)], "profile string")))
    m = m.withColumn("cell", (F.row_number().over(Window.orderBy("config", "profile", "model")) - 1).cast("long"))
    return m.withColumns({"seed": 42 + F.col("cell"), "label": X.config_label(F.col("config").cast("string"), F.col("profile"))})
