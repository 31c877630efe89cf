"""Queries on bootstraps: draws with replacement that all cells share, made in one pass for all replicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..operators import resample as B
from ..operators import sequence as S
from ..operators.survival import cut
from .alarms import EPISODES, HOURS, SEQ, grid
from .registry import CORPUS, FRAMES, RUNS, register
from .views import CORPUS_ORDER, corpus, frames, runs, table, with_onset

#: Replicates of a bootstrap; of the matched thresholds.
REPLICATES, MATCHED = 1000, 300


def drawn(name: str, keys: str, key: str, reps: int) -> str:
    """Common table expressions of draws with replacement: ``name`` has rep, key and weight."""
    return f"""
{name}_k as (select {key}, row_number() over (order by {key}) - 1 as rk, count(*) over () as nk from (select distinct {key} from {keys})),
{name}_d as (
    select rep, ('0x' || substr(md5(rep || '-' || i), 1, 8))::bigint % nk as rk, count(*) as weight
    from (select distinct nk from {name}_k) m, (select unnest(range(0, {reps})) as rep) r, lateral (select unnest(range(0, m.nk)) as i) group by 1, 2
),
{name} as (select rep, {key}, weight from {name}_d join {name}_k using (rk))"""


#: Episodes of at least three scores by clip for each threshold 1 to 10, of a score column.
def by_clip(name: str, score: str) -> str:
    return f"""
{name}_0 as (select c.*, threshold, case when {score} >= threshold then 1 else 0 end as q from c cross join (select cast(unnest(range(1, 11)) as int) as threshold)),
{name}_1 as (select *, sum(1 - q) over (partition by model, clip, threshold order by {SEQ}) as brk from {name}_0),
{name}_2 as (select model, clip, threshold, brk, sum(q) as n from {name}_1 group by all),
{name} as (select model, clip, threshold, count(*) filter (where n >= 3) as n from {name}_2 group by model, clip, threshold)"""


def _episodes(spark, df, score: str, out: str = "n"):
    e = S.episodes_by_threshold(df, ["model", "clip"], ["model", "clip"], CORPUS_ORDER, score, 3, grid(spark, range(1, 11)))
    return e.withColumnRenamed("n_episodes", out)


def _amounts(c):
    return c.groupBy("model", "clip").agg(F.sum("l_quantity").alias("amount"))


@register(f"""with {CORPUS}, {by_clip("e", "score")}, {drawn("w", "c", "clip", REPLICATES)},
    q as (select model, clip, sum(l_quantity) as amount from c group by 1, 2),
    x as (select model, rep, sum(n * weight) * 60.0 / sum(amount * weight) as far from q join e using (model, clip) join w using (clip) where threshold = 7 group by model, rep)
    select model, round(quantile_cont(far, 0.025), 6) as low, round(quantile_cont(far, 0.975), 6) as high from x group by model""")
def far_bootstrap(spark, sf_dir):
    """Limits of the rate at one threshold: 1,000 replicates of clips, drawn with replacement once for all models."""
    c = corpus(spark, sf_dir)
    n = S.episodes(c, ["model", "clip"], CORPUS_ORDER, F.col("score") >= 7, 3).withColumnsRenamed({"n_episodes": "n"}).withColumn("threshold", F.lit(7))
    rates = B.replicate_rates(n, _amounts(c), B.resample(c, "clip", REPLICATES), ["model"], "threshold", "clip")
    found = B.limits(rates.withColumn("far", F.col("n") * 60.0 / F.col("amount")), ["model"], "far")
    return found.select("model", F.round("lo", 6).alias("low"), F.round("hi", 6).alias("high"))


_KEPT = """
kept as (select clip from (select s_suppkey as clip, row_number() over (partition by s_nationkey, floor(s_acctbal / 1000) order by s_suppkey) as k from supplier) where k = 1),
cd as (select * from c where clip in (select clip from kept))"""


def _limits_sql(name: str, rows: str, weights: str) -> str:
    return f"""
{name}_q as (select model, clip, sum(l_quantity) as amount from {rows} group by 1, 2),
{name}_a as (select model, rep, sum(amount * weight) as amount from {name}_q join {weights} using (clip) group by 1, 2),
{name}_n as (select model, threshold, rep, sum(n * weight) as n from e join {weights} using (clip) where clip in (select clip from {rows}) group by 1, 2, 3),
{name}_l as (select model, threshold, quantile_cont(n * 60.0 / amount, 0.025) as lo, quantile_cont(n * 60.0 / amount, 0.975) as hi from {name}_n join {name}_a using (model, rep) group by 1, 2),
{name}_f as (select model, threshold, sum(n) * 60.0 / max(amount) as far from e join (select model, sum(amount) as amount from {name}_q group by 1) using (model) where clip in (select clip from {rows}) group by 1, 2),
{name} as (select model, threshold, far, (hi - lo) / far as width from {name}_f join {name}_l using (model, threshold) where far > 0)"""


@register(f"""with {CORPUS}, {_KEPT}, {by_clip("e", "score")}, {drawn("wa", "c", "clip", REPLICATES)}, {drawn("wb", "cd", "clip", REPLICATES)}, {_limits_sql("a", "c", "wa")}, {_limits_sql("b", "cd", "wb")},
    m as (select a.width as wa, b.width as wb, b.far from a join b using (model, threshold)),
    s as (select 'all' as subset, * from m union all select 'low', * from m where far <= 0.5)
    select subset, count(*) as n, round(median(wa), 6) as width_a, round(median(wb), 6) as width_b, round(median(100 * (wb / wa - 1)), 6) as change_pct, round(100 * avg((wb > wa)::int), 6) as wider_pct from s group by subset""")
def bootstrap_widths(spark, sf_dir):
    """How much wider the limits get once copies of clips are left out: all thresholds, and those of a low rate."""
    c = corpus(spark, sf_dir)
    manifest = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"), "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("content"))
    kept = S.keep_first(manifest, ["s_nationkey", "content"], ["clip"]).filter("kept").select("clip")

    # counts by clip don't depend on which other clips stay
    n_all, amount_all = cut(_episodes(spark, c, "score")), cut(_amounts(c))

    def curve(n, amount):
        rates = B.replicate_rates(n, amount, B.resample(amount, "clip", REPLICATES), ["model"], "threshold", "clip")
        found = B.limits(rates.withColumn("far", F.col("n") * 60.0 / F.col("amount")), ["model", "threshold"], "far")
        whole = amount.groupBy("model").agg(F.sum("amount").alias("amount"))
        far = n.groupBy("model", "threshold").agg(F.sum("n").alias("n")).join(F.broadcast(whole), "model")  # a row a model
        return far.select("model", "threshold", (F.col("n") * 60.0 / F.col("amount")).alias("far_h")).join(found, ["model", "threshold"])

    out = B.width_comparison(curve(n_all, amount_all), curve(*(x.join(kept, "clip", "left_semi") for x in (n_all, amount_all))), ["model", "threshold"], low_rate=0.5)
    return out.select("subset", "n", *(F.round(x, 6).alias(x) for x in ("width_a", "width_b", "change_pct", "wider_pct")))


_OTHER = CORPUS.replace("cast(round(l_discount * 100) as int) as score", "cast(round(l_discount * 100) as int) as score, cast(round(l_tax * 100) as int) as other")


@register(f"""with {_OTHER}, {FRAMES}, {by_clip("ea", "score")}, {by_clip("eb", "other")}, {drawn("w", "c", "clip", MATCHED)}, {HOURS},
    t as (select cast(unnest([0.05, 0.2, 0.5]) as double) as target),
    full_a as (select model, threshold, sum(n) as n from ea group by 1, 2),
    pub as (select model, target, min(threshold) as published from full_a join h using (model) join t on n / hours <= target group by 1, 2),
    s0 as (select fo.*, threshold, case when cast(round(value * 100) as int) >= 1000 * threshold then 1 else 0 end as q from fo cross join (select cast(unnest(range(1, 11)) as int) as threshold)),
    s1 as (select *, sum(1 - q) over (partition by run_id, threshold order by t_post, frame_idx) as brk from s0),
    s2 as (select *, case when q = 1 then sum(q) over (partition by run_id, threshold, brk order by t_post, frame_idx) else 0 end as streak from s1),
    hr as (select threshold, 100 * avg(hit::int) as hit_pct from (select run_id, threshold, coalesce(bool_or(streak >= 3 and t_post >= t_onset), false) as hit from s2 group by 1, 2) group by 1),
    x as (select model, rep, threshold, sum(ea.n * weight) as na, sum(eb.n * weight) as nb from ea join eb using (model, clip, threshold) join w using (clip) group by 1, 2, 3),
    m as (select x.model, target, published, x.rep, min(x.threshold) filter (where x.nb <= p.na) as matched from x join pub using (model) join x p on p.model = x.model and p.rep = x.rep and p.threshold = published group by 1, 2, 3, 4),
    y as (select m.*, hit_pct from m left join hr on hr.threshold = matched)
    select model, target, published, round(max(ph.hit_pct), 6) as published_hit, count(matched) as n, median(matched) as thr_med, round(quantile_cont(matched, 0.05), 6) as thr_lo, round(quantile_cont(matched, 0.95), 6) as thr_hi,
           round(median(y.hit_pct), 6) as hit_med, round(quantile_cont(y.hit_pct, 0.05), 6) as hit_lo, round(quantile_cont(y.hit_pct, 0.95), 6) as hit_hi
    from y left join hr ph on ph.threshold = published group by model, target, published""")
def matched_bootstrap(spark, sf_dir):
    """Thresholds of a second score source that match the first one's rate, and the hit shares there, over 300 replicates of clips."""
    li = table(spark, sf_dir, "lineitem").withColumn("other", F.round(F.col("l_tax") * 100).cast("int"))
    c = li.select(F.col("l_suppkey").alias("clip"), F.col("l_returnflag").alias("model"), F.round(F.col("l_discount") * 100).cast("int").alias("score"), "other", *CORPUS_ORDER, "l_quantity")
    pairs = _episodes(spark, c, "score", "na").join(_episodes(spark, c, "other", "nb"), ["model", "clip", "threshold"])
    hours = c.groupBy("model").agg((F.sum("l_quantity") / 60.0).alias("hours"))
    whole = pairs.groupBy("model", "threshold").agg(F.sum("na").alias("n_episodes"))
    targets = spark.createDataFrame([(0.05,), (0.2,), (0.5,)], "target double")
    published = C.calibrate(C.rate_curve(whole, hours, ["model"]), ["model"], targets).select("model", "target", "threshold")
    f = with_onset(frames(spark, sf_dir)).withColumn("score", F.round(F.col("value") * 100).cast("int"))
    a = S.alarms_by_threshold(f, ["run_id"], ["t_post", "frame_idx"], "score", "t_post", "t_onset", 3, grid(spark, [1000 * t for t in range(1, 11)]))
    hits = F.broadcast(a.groupBy((F.col("threshold") / 1000).cast("int").alias("level")).agg((100 * F.avg(F.col("hit").cast("int"))).alias("hit_pct")))  # ten thresholds
    found = B.matched_thresholds(pairs, B.resample(c, "clip", MATCHED), published, ["model"], "threshold", "clip")
    met = found.join(hits, F.col("matched") == F.col("level"), "left").drop("level")
    met = met.join(hits.withColumnRenamed("hit_pct", "published_hit"), F.col("published") == F.col("level"), "left")
    six = lambda c, name: F.round(c, 6).alias(name)
    at = lambda c, p, name: six(F.percentile(c, p), name)
    return met.groupBy("model", "target", "published").agg(
        six(F.max("published_hit"), "published_hit"),
        F.count("matched").alias("n"),
        *(at("matched", p, f"thr_{k}") for p, k in ((0.5, "med"), (0.05, "lo"), (0.95, "hi"))),
        *(at("hit_pct", p, f"hit_{k}") for p, k in ((0.5, "med"), (0.05, "lo"), (0.95, "hi"))),
    )


@register(f"""with {RUNS}, {drawn("w", "r", "scenario", REPLICATES)},
    b as (select config, -1 as rep, duration, hit, 1 as weight from r union all select config, rep, duration, hit, weight from r join w using (scenario)),
    l0 as (select config, rep, duration as time, sum(case when hit then weight else 0 end) as d, sum(weight) as m from b where duration > 0 group by 1, 2, 3),
    l as (select config, rep, time, d, sum(m) over (partition by config, rep order by time desc) as n from l0),
    k as (select config, rep, time, exp(sum(case when d < n then ln(1 - d / n) else 0 end) over (partition by config, rep order by time)) * (case when max(case when d = n then 1 else 0 end) over (partition by config, rep order by time) = 1 then 0 else 1 end) as s from l),
    a as (select config, rep, time, s, coalesce(lead(time) over (partition by config, rep order by time), 168.0) as nxt from k where time < 168),
    x as (select config, rep, coalesce(min(time), 168) + coalesce(sum(s * (nxt - time)), 0) as rmst from (select distinct config, rep from k) left join a using (config, rep) group by 1, 2)
    select config, round(max(rmst) filter (where rep < 0), 6) as rmst, round(quantile_cont(rmst, 0.025) filter (where rep >= 0), 6) as lo, round(quantile_cont(rmst, 0.975) filter (where rep >= 0), 6) as hi, max(n) as n
    from x join (select config, count(*) as n from r group by 1) using (config) group by config""")
def restricted_mean_limits(spark, sf_dir):
    """Restricted means by configuration with limits from 1,000 replicates of scenarios."""
    out = B.rmst_limits(runs(spark, sf_dir), ["config"], "duration", "hit", "scenario", 168.0, REPLICATES)
    return out.select("config", *(F.round(c, 6).alias(c) for c in ("rmst", "lo", "hi")), "n")
