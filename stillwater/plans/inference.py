"""Queries on summaries, tests and survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tails
from ..operators import compare as T
from ..operators import sequence as Q
from ..operators import survival as V
from .registry import FRAMES, RUNS, register, sign_tail, t_quantile, t_tail
from .views import frames, runs, table


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@register(f"""with {RUNS} select config, model, count(*) as n, count(*) filter (where hit) as hits, round(1 - avg(hit::int), 6) as miss_rate, round(avg(ttd), 4) as mean,
    round(case when count(ttd) > 0 then coalesce(stddev_samp(ttd), 0) end, 6) as sd, round(median(ttd), 6) as median, round(quantile_cont(ttd, 0.9), 6) as p90, min(ttd) as low, max(ttd) as high from r group by config, model""")
def run_summary(spark, sf_dir):
    return rounded(T.summarize(runs(spark, sf_dir), ["config", "model"], "ttd", "hit"), "miss_rate", "sd", "median", "p90").withColumn("mean", F.round("mean", 4))


@register(f"""with {RUNS}, g as (select config, model, count(ttd) as n, avg(ttd) as mean, stddev_samp(ttd) as sd from r group by config, model), q as (select n, {t_quantile("(n - 1)")} as t from (select distinct n from g where n > 1))
    select config, model, n, round(mean, 4) as mean, round(sd, 6) as sd, round(t * sd / sqrt(n), 6) as ci95 from g left join q using (n)""")
def mean_intervals(spark, sf_dir):
    """t intervals of the mean time to alarm."""
    s = runs(spark, sf_dir).groupBy("config", "model").agg(F.count("ttd").alias("n"), F.avg("ttd").alias("mean"), F.stddev_samp("ttd").alias("sd"))
    return rounded(T.with_t_interval(s), "sd", "ci95").withColumn("mean", F.round("mean", 4))


@register(f"""with {RUNS}, p as (select x.config as a, y.config as b, y.ttd - x.ttd as d from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config < y.config where x.ttd is not null and y.ttd is not null)
    select a, b, count(*) as n, round(avg(d), 6) as mean_diff, round(case when count(*) >= 3 then avg(d) / stddev_samp(d) * sqrt(count(*)) end, 6) as t, count(*) filter (where d > 0) as wins, count(*) filter (where d < 0) as losses from p group by a, b""")
def paired_differences(spark, sf_dir):
    p = T.paired_t(T.label_pairs(runs(spark, sf_dir), "config", ["model", "scenario"], "ttd"))
    return rounded(p, "mean_diff", "t").select("a", "b", "n", "mean_diff", "t", "wins", "losses")


@register(f"""with {RUNS}, d as (select x.config as a, y.config as b, y.ttd - x.ttd as d from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config < y.config where x.ttd is not null and y.ttd is not null),
    t as (select a, b, count(*) as n, avg(d) / stddev_samp(d) * sqrt(count(*)) as t, count(*) filter (where d > 0) as wins, count(*) filter (where d < 0) as losses from d group by a, b),
    p as (select *, case when n >= 3 then {t_tail("t", "(n - 1)")} end as p, {sign_tail("wins", "losses")} as p_sign from t),
    k as (select *, row_number() over (order by p nulls last, a, b) as i, count(p) over () as m from p)
    select a, b, n, round(p, 6) as p, round(p_sign, 6) as p_sign, round(case when p is not null then least(1.0, max((m - i + 1) * p) over (order by p nulls last, a, b rows unbounded preceding)) end, 6) as p_holm, round(case when p is not null then least(1.0, m * p) end, 6) as p_bonferroni from k""")
def paired_p_values(spark, sf_dir):
    """p of the t test and of the exact sign test with Holm's and Bonferroni's adjustment."""
    p = T.paired_t(T.label_pairs(runs(spark, sf_dir), "config", ["model", "scenario"], "ttd"))
    p = p.withColumns({"p": tails.t_p()(F.col("t"), (F.col("n") - 1).cast("double")), "p_sign": tails.sign_p()(F.col("wins").cast("double"), F.col("losses").cast("double")), "_all": F.lit(1)})
    return rounded(Q.holm(p, ["_all"], "p", ["a", "b"]), "p", "p_sign", "p_holm", "p_bonferroni").select("a", "b", "n", "p", "p_sign", "p_holm", "p_bonferroni")


@register(f"""with {RUNS}, sh as (select config, avg(fp_pre::int) as p from r group by config), k as (select *, row_number() over (order by p, config) as i, count(*) over () as m from sh)
    select config, round(p, 6) as p, round(least(1.0, max((m - i + 1) * p) over (order by p, config rows unbounded preceding)), 6) as p_holm, round(least(1.0, m * p), 6) as p_bonferroni from k""")
def step_down(spark, sf_dir):
    s = runs(spark, sf_dir).groupBy("config").agg(F.avg(F.col("fp_pre").cast("int")).alias("p")).withColumn("_all", F.lit(1))
    return rounded(Q.holm(s, ["_all"], "p", ["config"]), "p", "p_holm", "p_bonferroni").drop("_all")


@register(f"""with {RUNS}, p as (select x.config as a, y.config as b, y.ttd - x.ttd as d from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config < y.config where x.ttd is not null and y.ttd is not null),
    k as (select *, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2.0 as rk from p where d <> 0),
    w as (select a, b, count(*) as n, sum(case when d > 0 then rk else 0 end) as w_plus from k group by a, b)
    select a, b, n, w_plus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) as z from w""")
def signed_ranks(spark, sf_dir):
    out = T.wilcoxon(T.label_pairs(runs(spark, sf_dir), "config", ["model", "scenario"], "ttd"))
    return rounded(out, "z").select("a", "b", "n", "w_plus", "z")


@register(f"""with {RUNS}, g as (select model, config, count(*) as n, avg(ttd) as m, var_samp(ttd) as v from r where ttd is not null group by 1, 2 having count(*) > 1),
    t as (select *, sum(n * m) over (partition by model) / sum(n) over (partition by model) as gm from g)
    select model, count(*) as k, sum(n) as n, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) as f, round(max(m) - min(m), 6) as spread from t group by model having count(*) >= 2""")
def variance_analysis(spark, sf_dir):
    return rounded(T.anova(runs(spark, sf_dir), ["model"], "config", "ttd"), "f", "spread").select("model", "k", "n", "f", "spread")


@register("""with c as (select o_orderpriority as f, o_orderstatus as o, count(*) as n from orders group by 1, 2), t as (select *, sum(n) over (partition by f) as r, sum(n) over (partition by o) as k, sum(n) over () as total from c)
    select round(sum((n - r * k / total) ** 2 / (r * k / total)), 6) as chi2, (count(distinct f) - 1) * (count(distinct o) - 1) as dof, max(total) as n from t""")
def independence(spark, sf_dir):
    return rounded(T.chi_square(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus"), "chi2")


@register("select o_orderpriority as f, o_orderstatus as o, count(*) as n from orders group by 1, 2")
def crosstab(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("f"), F.col("o_orderstatus").alias("o")).agg(F.count("*").alias("n"))


@register("""with c as (select source, count(*) as n, count(*) filter (where toxic = 1) as k from documents join labels using (doc_id) group by source), z as (select *, 1.959963984540054 as z, k / n as p from c)
    select source, n, k, round(100.0 * p, 6) as share, round(100 * (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as low,
           round(100 * (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as high from z""")
def failure_by_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("bad", F.col("toxic") == 1)
    return rounded(T.failure_shares(d, ["source"], "bad"), "share", "low", "high")


@register("""with k as (select l_returnflag as f, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as x,
    rank() over (partition by l_returnflag order by l_discount) + (count(*) over (partition by l_returnflag, l_discount) - 1) / 2.0 as y from lineitem) select f, round(corr(x, y), 6) as rho, count(*) as n from k group by f""")
def rank_correlation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("f"), "l_quantity", "l_discount")
    return rounded(T.spearman(li, ["f"], "l_quantity", "l_discount"), "rho")


@register(f"""with {RUNS}, m as (select config, avg(ttd) as mu, stddev_samp(ttd) as sd from r where model = 0 group by config), z as (select r.config, (ttd - mu) / sd as z from r join m using (config) where model = 1 and ttd is not null)
    select config, count(z) as n, round(avg(z), 6) as mean, round((avg(z) + 1) / (stddev_samp(z) / sqrt(count(z))), 6) as t_low, round((avg(z) - 1) / (stddev_samp(z) / sqrt(count(z))), 6) as t_high from z group by config""")
def equivalence(spark, sf_dir):
    """Standardised differences of one model against another's spread, and both one-sided statistics."""
    r = runs(spark, sf_dir)
    base = r.filter("model = 0").groupBy("config").agg(F.avg("ttd").alias("mu"), F.stddev_samp("ttd").alias("sd"))
    z = r.filter("model = 1 and ttd is not null").join(F.broadcast(base), "config").withColumn("z", (F.col("ttd") - F.col("mu")) / F.col("sd"))
    return rounded(T.tost(z, ["config"], "z"), "mean", "t_low", "t_high").select("config", "n", "mean", "t_low", "t_high")


@register(f"""with {RUNS}, p as (select x.model, x.hit as a, y.hit as b from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config = 0 and y.config = 4),
    d as (select model, count(*) filter (where a and not b) as only_a, count(*) filter (where b and not a) as only_b from p group by model)
    select model, only_a, only_b, round(case when only_a + only_b > 0 then greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b) end, 6) as chi2 from d""")
def discordant_pairs(spark, sf_dir):
    r = runs(spark, sf_dir)
    a, b = (r.filter(F.col("config") == k).select("model", "scenario", F.col("hit").alias(n)) for k, n in ((0, "a"), (4, "b")))
    return rounded(T.mcnemar(a.join(b, ["model", "scenario"]), "a", "b", ["model"]), "chi2")


@register(f"""with {RUNS}, d as (select config, model, scenario // 2 as block, ttd from r where ttd is not null), v as (select config, model, block, count(*) as n, var_samp(ttd) as v from d group by 1, 2, 3 having count(*) > 1)
    select config, round(sqrt(sum((n - 1) * v) / sum(n - 1)), 6) as sd_within from v group by config""")
def repeat_spread(spark, sf_dir):
    """Spread between repetitions within cells, pooled over the cells of a configuration."""
    d = runs(spark, sf_dir).filter("ttd is not null").groupBy("config", "model", F.floor(F.col("scenario") / 2).alias("block")).agg(F.count("*").alias("n"), F.var_samp("ttd").alias("v")).filter("n > 1")
    return d.groupBy("config").agg(F.round(F.sqrt(F.sum((F.col("n") - 1) * F.col("v")) / F.sum(F.col("n") - 1)), 6).alias("sd_within"))


_LIFE = f"""{RUNS},
l0 as (select config, duration as time, count(*) filter (where hit) as d, count(*) as m from r where duration > 0 group by 1, 2),
l as (select config, time, d, sum(m) over (partition by config order by time desc) as n from l0),
k as (select config, time, d, n, exp(sum(case when d < n then ln(1 - d / n) else 0 end) over (partition by config order by time)) * (case when max(case when d = n then 1 else 0 end) over (partition by config order by time) = 1 then 0 else 1 end) as s from l)"""


@register(f"with {_LIFE} select config, time, d, n, round(s, 6) as s from k")
def survival_curve(spark, sf_dir):
    return rounded(V.kaplan_meier(runs(spark, sf_dir), ["config"], "duration", "hit"), "s").select("config", "time", "d", "n", "s")


@register(f"""with {_LIFE} select config, min(time) filter (where s <= 0.75 + 1e-12) as q25, min(time) filter (where s <= 0.5 + 1e-12) as median from k group by config""")
def survival_quantiles(spark, sf_dir):
    km = V.kaplan_meier(runs(spark, sf_dir), ["config"], "duration", "hit")
    return V.quantile(km, ["config"], 0.75, "q25").join(V.quantile(km, ["config"], 0.5, "median"), "config")


@register(f"""with {_LIFE}, a as (select config, time, s, coalesce(lead(time) over (partition by config order by time), 168.0) as nxt from k where time < 168)
    select config, round(coalesce(min(time), 168) + coalesce(sum(s * (nxt - time)), 0), 6) as rmst from (select distinct config from k) left join a using (config) group by config""")
def restricted_mean(spark, sf_dir):
    return rounded(V.rmst(V.kaplan_meier(runs(spark, sf_dir), ["config"], "duration", "hit"), ["config"], 168.0), "rmst")


@register(f"""with {RUNS}, t0 as (select config as g, duration as time, count(*) filter (where hit) as d, count(*) as m from r where duration > 0 group by 1, 2),
    p as (select x.g as a, y.g as b from (select distinct g from t0) x join (select distinct g from t0) y on x.g < y.g),
    c as (select a, b, time, sum(d) as d, sum(m) as m, sum(case when g = a then d else 0 end) as d1, sum(case when g = a then m else 0 end) as m1 from t0 join p on g = a or g = b group by 1, 2, 3),
    n as (select *, sum(m) over w as n, sum(m1) over w as n1 from c window w as (partition by a, b order by time desc)),
    lr as (select a, b, sum(d1) as observed, sum(d * n1 / n) as expected, sum(case when n > 1 then d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) else 0 end) as variance from n group by a, b)
    select a, b, observed, round(expected, 6) as expected, round(variance, 6) as variance, round((observed - expected) ** 2 / variance, 6) as chi2 from lr""")
def log_rank_pairs(spark, sf_dir):
    return rounded(V.log_rank(runs(spark, sf_dir), "config", "duration", "hit"), "expected", "variance", "chi2")


@register(f"""with {RUNS}, n as (select config, median(ttd) as naive from r group by config), q as (select config, max(followup) as longest from r group by config) select config, round(naive, 6) as naive, longest from n join q using (config)""")
def naive_medians(spark, sf_dir):
    out = T.with_quantiles(runs(spark, sf_dir).select("config", "ttd", "followup"), ["config"], [F.max("followup").alias("longest")], "ttd", {"naive": 0.5})
    return rounded(out, "naive").select("config", "naive", "longest")


@register(f"""with {_LIFE}, n as (select config, median(ttd) as naive, count(*) as n, count(*) filter (where hit) as hits from r group by config), q as (select config, min(time) filter (where s <= 0.5 + 1e-12) as km, min(time) filter (where s <= 0.1 + 1e-12) as t90 from k group by config)
    select config, n, hits, round(naive, 6) as naive_median, km as km_median, t90, round(km - naive, 6) as survivorship from n left join q using (config)""")
def survivorship(spark, sf_dir):
    """The median delay of the runs that had an alarm beside that of the survival curve, which counts those that had none."""
    r = runs(spark, sf_dir).select("config", "ttd", "hit", "duration")
    naive = T.with_quantiles(r, ["config"], [F.count("*").alias("n"), F.count_if("hit").alias("hits")], "ttd", {"naive_median": 0.5})
    km = V.kaplan_meier(r, ["config"], "duration", "hit")
    out = naive.join(V.quantile(km, ["config"], 0.5, "km_median"), "config", "left").join(V.quantile(km, ["config"], 0.1, "t90"), "config", "left")
    return rounded(out.withColumn("survivorship", F.col("km_median") - F.col("naive_median")), "naive_median", "survivorship")


@register(f"""with {_LIFE}, g as (select *, sum(case when d < n then d / (n * (n - d)) else 0 end) over (partition by config order by time) as gw from k),
    v as (select *, 1.959963984540054 * sqrt(gw) / ln(s) as v from g where s > 0 and s < 1)
    select config, time, round(s, 6) as s, round(s ** exp(-v), 6) as s_lo, round(s ** exp(v), 6) as s_hi from v""")
def survival_bands(spark, sf_dir):
    """Log-log limits of the survival curves, where these are neither 0 nor 1."""
    km = V.kaplan_meier(runs(spark, sf_dir), ["config"], "duration", "hit").filter("s_lo is not null")
    return rounded(km, "s", "s_lo", "s_hi").select("config", "time", "s", "s_lo", "s_hi")


@register()
def hazard_ratios(spark, sf_dir):
    """Proportional hazards of configurations against the first, errors by scenario; Newton steps on compressed counts."""
    r = runs(spark, sf_dir)
    names = [f"c{k}" for k in range(1, 5)]
    r = r.withColumns({n: (F.col("config") == k).cast("int") for k, n in enumerate(names, 1)})
    out = V.cox(r, names, "duration", "hit", cluster="scenario" if r.select("scenario").distinct().count() > 1 else None)
    schema = "covariate string, coef double, hr double, se double, z double, n_events int, converged boolean"
    return spark.createDataFrame([tuple(x[f.split()[0]] for f in schema.split(", ")) for x in out], schema)


@register(f"""with {FRAMES}, b as (select config, cls, count(*) as n, avg(value) as m from f group by 1, 2) select config, cls, n, round(m, 6) as mean, round(m / nullif(max(case when config = 0 then m end) over (partition by cls), 0), 6) as ratio from b""")
def ratio_to_first(spark, sf_dir):
    from pyspark.sql import Window

    b = frames(spark, sf_dir).groupBy("config", "cls").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    base = F.max(F.when(F.col("config") == 0, F.col("m"))).over(Window.partitionBy("cls"))
    return b.select("config", "cls", "n", F.round("m", 6).alias("mean"), F.round(F.try_divide(F.col("m"), base), 6).alias("ratio"))
