"""Queries on decisions: p values of the tests, agreement of annotators, traces and versions, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tails
from ..operators import calibrate as C
from ..operators import compare as T
from ..operators import decide as D
from ..operators import sequence as S
from ..operators import survival as V
from .alarms import SEQ
from .registry import CORPUS, FRAMES, RUNS, any_chi2_tail, f_tail, register, t_tail
from .views import CORPUS_ORDER, corpus, frames, runs, table


def _standardised(r):
    base = r.filter("model = 0").groupBy("config").agg(F.avg("ttd").alias("mu"), F.stddev_samp("ttd").alias("sd"))
    return r.filter("model = 1 and ttd is not null").join(F.broadcast(base), "config").withColumn("z", (F.col("ttd") - F.col("mu")) / F.col("sd"))


#: The statistics of the eight families as SQL: test, item, statistic, p.
_FAMILIES = f"""{RUNS},
dd as (select x.config as a, y.config as b, y.ttd - x.ttd as d, x.hit as ha, y.hit as hb from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config < y.config),
d as (select * from dd where d is not null),
lt as (select config as g, duration as time, count(*) filter (where hit) as d, count(*) as m from r where duration > 0 group by 1, 2),
lp as (select x.g as a, y.g as b from (select distinct g from lt) x join (select distinct g from lt) y on x.g < y.g),
lc as (select a, b, time, sum(d) as d, sum(m) as m, sum(case when g = a then d else 0 end) as d1, sum(case when g = a then m else 0 end) as m1 from lt join lp on g = a or g = b group by 1, 2, 3),
ln_ as (select *, sum(m) over w as n, sum(m1) over w as n1 from lc window w as (partition by a, b order by time desc)),
lr as (select a, b, (sum(d1) - sum(d * n1 / n)) ** 2 / sum(case when n > 1 then d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) else 0 end) as x from ln_ group by a, b),
wk as (select *, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2.0 as rk from d where d <> 0),
wx as (select a, b, (sum(case when d > 0 then rk else 0 end) - count(*) * (count(*) + 1) / 4.0) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0) as x from wk group by a, b),
pt as (select a, b, count(*) as n, case when count(*) >= 3 and stddev_samp(d) > 0 then avg(d) / stddev_samp(d) * sqrt(count(*)) end as x from d group by a, b),
ag as (select model, config, count(*) as n, avg(ttd) as m, var_samp(ttd) as v from r where ttd is not null group by 1, 2 having count(*) > 1),
am as (select *, sum(n * m) over (partition by model) / sum(n) over (partition by model) as gm from ag),
av as (select model, count(*) as k, sum(n) as n, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) as x from am group by model having count(*) >= 2),
mc as (select a, b, count(*) filter (where ha and not hb) as oa, count(*) filter (where hb and not ha) as ob from dd group by a, b),
mx as (select a, b, case when oa + ob > 0 then greatest(abs(oa - ob) - 1, 0) ** 2 / (oa + ob) end as x from mc),
oc as (select o_orderpriority as f, o_orderstatus as o, count(*) as n from orders group by 1, 2),
ot as (select *, sum(n) over (partition by f) as rs, sum(n) over (partition by o) as cs, sum(n) over () as total from oc),
ct as (select sum((n - rs * cs / total) ** 2 / (rs * cs / total)) as x, (count(distinct f) - 1) * (count(distinct o) - 1) as dof from ot),
rk as (select config, rank() over (partition by config order by ttd) + (count(*) over (partition by config, ttd) - 1) / 2.0 as x, rank() over (partition by config order by t_first) + (count(*) over (partition by config, t_first) - 1) / 2.0 as y
       from r where ttd is not null and t_first is not null),
rc as (select config, count(*) as n, corr(x, y) as rho from rk group by config),
rx as (select config, n, case when abs(rho) < 1 then rho * sqrt((n - 2) / (1 - rho * rho)) end as x from rc),
em as (select config, avg(ttd) as mu, stddev_samp(ttd) as sd from r where model = 0 group by config),
ez as (select r.config, (ttd - mu) / sd as z from r join em using (config) where model = 1 and ttd is not null),
eg as (select config, count(z) as n, (avg(z) + 1) / (stddev_samp(z) / sqrt(count(z))) as lo, (avg(z) - 1) / (stddev_samp(z) / sqrt(count(z))) as hi from ez group by config),
e2 as (select *, case when n > 1 then {t_tail("lo", "(n - 1)")} end as p_lo, case when n > 1 then {t_tail("hi", "(n - 1)")} end as p_hi from eg),
tests as (
    select 'log_rank' as test, a || '-' || b as item, x as statistic, {any_chi2_tail("x", "1")} as p from lr
    union all select 'signed_ranks', a || '-' || b, x, {any_chi2_tail("x * x", "1")} from wx
    union all select 'paired_t', a || '-' || b, x, case when x is not null then {t_tail("x", "(n - 1)")} end from pt
    union all select 'anova', cast(model as varchar), x, {f_tail("x", "(k - 1)", "(n - k)")} from av
    union all select 'mcnemar', a || '-' || b, x, case when x is not null then {any_chi2_tail("x", "1")} end from mx
    union all select 'independence', 'priority-status', x, {any_chi2_tail("x", "dof")} from ct
    union all select 'rank_correlation', cast(config as varchar), x, case when x is not null and n > 2 then {t_tail("x", "(n - 2)")} end from rx
    union all select 'equivalence', cast(config as varchar), least(lo, -hi), greatest(case when lo > 0 then p_lo / 2 else 1 - p_lo / 2 end, case when hi < 0 then p_hi / 2 else 1 - p_hi / 2 end) from e2
)"""


@register(f"""with {_FAMILIES}, b as (select *, least(1.0, p * count(p) over (partition by test)) as pb from tests)
    select test, item, round(statistic, 6) as statistic, round(p, 6) as p, round(case when p is not null then pb end, 6) as p_bonferroni, case when p is not null then pb < 0.05 end as significant from b""")
def p_values(spark, sf_dir):
    """p values with Bonferroni's adjustment within each family: log-rank, signed ranks, paired t, F, equivalence, McNemar, chi-square, rank correlation."""
    r = runs(spark, sf_dir)
    pairs = T.label_pairs(r, "config", ["model", "scenario"], "ttd")
    d = lambda c: F.col(c).cast("double")
    pair = F.concat_ws("-", "a", "b")
    lr, wx, pt = V.log_rank(r, "config", "duration", "hit"), T.wilcoxon(pairs), T.paired_t(pairs)
    av = T.anova(r, ["model"], "config", "ttd")
    hits = r.select("model", "scenario", "config", "hit")
    x, y = hits.withColumnsRenamed({"config": "a", "hit": "ha"}), hits.withColumnsRenamed({"config": "b", "hit": "hb"})
    mc = T.mcnemar(x.join(y, ["model", "scenario"]).filter("a < b"), "ha", "hb", ["a", "b"])
    ct = T.chi_square(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    rho = T.spearman(r.filter("ttd is not null and t_first is not null"), ["config"], "ttd", "t_first")
    t = F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    eq = T.tost(_standardised(r), ["config"], "z")
    two = lambda c: tails.t_p()(d(c), d("n") - 1)
    families = {
        "equivalence": eq.select(d("config").cast("int").cast("string").alias("item"), F.least(d("t_low"), -d("t_high")).alias("statistic"), D.one_sided_pair_p(d("t_low"), d("t_high"), two("t_low"), two("t_high")).alias("p")),
        "log_rank": lr.select(pair.alias("item"), d("chi2").alias("statistic"), tails.chi2_p()(d("chi2"), F.lit(1.0)).alias("p")),
        "signed_ranks": wx.select(pair.alias("item"), d("z").alias("statistic"), tails.normal_p()(d("z")).alias("p")),
        "paired_t": pt.select(pair.alias("item"), d("t").alias("statistic"), tails.t_p()(d("t"), d("n") - 1).alias("p")),
        "anova": av.select(d("model").cast("int").cast("string").alias("item"), d("f").alias("statistic"), tails.f_p()(d("f"), d("k") - 1, d("n") - d("k")).alias("p")),
        "mcnemar": mc.select(pair.alias("item"), d("chi2").alias("statistic"), tails.chi2_p()(d("chi2"), F.lit(1.0)).alias("p")),
        "independence": ct.select(F.lit("priority-status").alias("item"), d("chi2").alias("statistic"), tails.chi2_p()(d("chi2"), d("dof")).alias("p")),
        "rank_correlation": rho.select(d("config").cast("int").cast("string").alias("item"), t.alias("statistic"), tails.t_p()(t, d("n") - 2).alias("p")),
    }
    out = None
    for name, tests in families.items():
        one = D.bonferroni(tests, "p").select(F.lit(name).alias("test"), "item", *(F.round(c, 6).alias(c) for c in ("statistic", "p", "p_bonferroni")), "significant")
        out = one if out is None else out.unionByName(one)
    return out


@register(f"""with {RUNS}, p as (select x.config as a, y.config as b, x.hit as ha, y.hit as hb from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config < y.config),
    d as (select a, b, count(*) filter (where ha and not hb) as only_a, count(*) filter (where hb and not ha) as only_b from p group by a, b),
    m as (select *, case when only_a + only_b > 0 then greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b) end as chi2 from d)
    select a, b, only_a, only_b, round(chi2, 6) as chi2, chi2 > 7.879438576622417 as significant from m""")
def discordant_decisions(spark, sf_dir):
    """All ten pairs of five configurations; the level is 0.05 over ten, from the tail of the statistic."""
    hits = runs(spark, sf_dir).select("model", "scenario", "config", "hit")
    x, y = hits.withColumnsRenamed({"config": "a", "hit": "ha"}), hits.withColumnsRenamed({"config": "b", "hit": "hb"})
    out = T.mcnemar(x.join(y, ["model", "scenario"]).filter("a < b"), "ha", "hb", ["a", "b"])
    p = tails.chi2_p()(F.col("chi2").cast("double"), F.lit(1.0))
    return out.select("a", "b", "only_a", "only_b", F.round("chi2", 6).alias("chi2"), (p < 0.05 / 10).alias("significant"))


@register("""with c as (select l_returnflag, l_linestatus, l_quantity + l_discount * 1000 + l_tax * 500 as cycle from lineitem),
    p as (select *, case when cycle > 80 then 1 - 80 / cycle else 0 end as predicted, (cycle > 80)::int as late from c)
    select l_returnflag, l_linestatus, count(*) as n, round(avg(cycle), 6) as mean_cycle, round(100 * avg(predicted), 6) as predicted_pct, round(100 * (avg(late) - avg(predicted)), 6) as residual_pp from p group by all""")
def serial_client_loss(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("transfer"), (F.col("l_discount") * 1000).alias("infer"), (F.col("l_tax") * 500).alias("post"))
    p = D.serial_client(li, "transfer", "infer", "post", F.lit(80.0)).withColumn("late", (F.col("cycle") > 80).cast("int"))
    return p.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg("cycle"), 6).alias("mean_cycle"), F.round(100 * F.avg("predicted"), 6).alias("predicted_pct"), F.round(100 * (F.avg("late") - F.avg("predicted")), 6).alias("residual_pp"))


@register(f"""with {FRAMES}, u as (select run_id, config, row_number() over (partition by run_id order by t_post, frame_idx) as i, value from f),
    m as (select run_id, any_value(config) as config, min(i) filter (where value >= 60) as oa, min(i) filter (where value >= 75) as ob from u group by run_id),
    d as (select config, coalesce(oa >= 2, false) as ua, coalesce(ob >= 2, false) as ub, oa, ob from m), g as (select *, case when ua and ub then ob - oa end as d from d)
    select config, count(*) as n, round(avg((ua = ub)::int), 6) as same_usable, count(*) filter (where ua and ub) as n_both, round(avg(abs(d)), 6) as mean_abs, max(abs(d)) as max_abs, round(avg(d), 6) as bias,
           round(avg((abs(d) <= 3)::int), 6) as within_3, round(avg((abs(d) <= 5)::int), 6) as within_5, round(avg((abs(d) <= 10)::int), 6) as within_10,
           list_sort(list(abs(d)) filter (where d is not null))[count(d) // 2 + 1] as median_abs from g group by config""")
def annotator_agreement(spark, sf_dir):
    """Two rules mark each run's onset; a mark is usable from the second observation on."""
    from pyspark.sql import Window

    u = frames(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy("t_post", "frame_idx")))
    first = lambda level: F.min(F.when(F.col("value") >= level, F.col("i")))
    m = u.groupBy("run_id", "config").agg(first(60).alias("oa"), first(75).alias("ob"))
    a, b = (m.select("run_id", "config", F.col(c).alias("onset"), F.coalesce(F.col(c) >= 2, F.lit(False)).alias("usable")) for c in ("oa", "ob"))
    out = D.annotator_agreement(a, b, "run_id", "usable", "onset", ["config"])
    return out.withColumns({c: F.round(c, 6) for c in ("same_usable", "mean_abs", "bias", "within_3", "within_5", "within_10")})


@register(f"""with {FRAMES}, x as (select run_id, value, row_number() over (partition by run_id order by t_post, frame_idx) as i from f),
    y as (select run_id, value, row_number() over (partition by run_id order by i) as j from x where i > 2),
    og as (select cast(unnest(range(-3, 4)) as int) as "offset"),
    e as (select run_id, "offset", count(*) as n, round(avg(abs(x.value - y.value)), 9) as mae, avg(((x.value >= 60) = (y.value >= 60))::int) as agree from y join og on true join x using (run_id) where x.i = y.j + "offset" group by all),
    k as (select *, row_number() over (partition by run_id order by mae, abs("offset"), "offset") as place from e)
    select run_id, "offset", n, mae, round(agree, 6) as agree from k where place = 1""")
def trace_alignment(spark, sf_dir):
    """Each run against itself without its first two observations: the best offset is looked for among seven."""
    from pyspark.sql import Window

    f = frames(spark, sf_dir).select("run_id", "t_post", "frame_idx", "value")
    late = f.withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy("t_post", "frame_idx"))).filter("i > 2")
    out = D.align(f, late, ["run_id"], ["t_post", "frame_idx"], "value", range(-3, 4), 60.0)
    return out.select("run_id", "offset", "n", "mae", F.round("agree", 6).alias("agree"))


@register("""select case when regexp_matches(url, '[?].*=') then 'query' when regexp_matches(url, '#') then 'anchor' when regexp_matches(url, '/en/') then 'english' else 'other' end as category, count(*) as n from pages group by 1""")
def log_categories(spark, sf_dir):
    """Lines of text by the first pattern that they contain."""
    rules = {"query": "[?].*=", "anchor": "#", "english": "/en/"}
    return table(spark, sf_dir, "pages").groupBy(D.first_category("url", rules).alias("category")).agg(F.count("*").alias("n"))


@register(f"""with {FRAMES}, s as (select run_id, config, min(t_post) // 1000000000 as t from f group by all), g as (select config, case when t < 1704153600 then 'before' else 'after' end as regime, count(*) as n, max(t) - min(t) as span_s from s group by all)
    select config, regime, n, span_s, round(case when span_s > 0 then n * 3600.0 / span_s end, 6) as per_hour from g""")
def start_rates(spark, sf_dir):
    """Run starts per hour before and after a transition at 2024-01-02 UTC."""
    s = frames(spark, sf_dir).groupBy("run_id", "config").agg(F.floor(F.min("t_post") / 1000000000).alias("t"))
    s = s.withColumn("regime", F.when(F.col("t") < 1704153600, "before").otherwise("after"))
    return D.start_rates(s, ["config", "regime"], F.col("t")).withColumn("per_hour", F.round("per_hour", 6))


def _level(spark, sf_dir, of):
    c = corpus(spark, sf_dir).filter(of)
    return c.groupBy("model", "score").agg(F.sum("l_quantity").alias("v"))


@register(f"""with {CORPUS}, a as (select model, score, sum(l_quantity) as v from c group by all), b as (select model, score, sum(l_quantity) as v from c where l_linenumber <> 7 group by all)
    select model, count(*) as n, count(*) filter (where a.v is distinct from b.v) as n_moved from a join b using (model, score) group by model""")
def moved_curves(spark, sf_dir):
    """A curve before and after lines are taken out: how many of its points moved."""
    a, b = _level(spark, sf_dir, F.lit(True)), _level(spark, sf_dir, F.col("l_linenumber") != 7)
    return D.moved_rows(a, b, ["model", "score"], "v").groupBy("model").agg(F.count("*").alias("n"), F.count_if("moved").alias("n_moved"))


@register("""select o_orderpriority, count(*) as n, count(*) filter (where o_orderstatus <> 'F') as n_open, count(distinct o_orderstatus) + max((o_orderstatus is null)::int) as n_o_orderstatus,
    n_open = 0 and n_o_orderstatus = 1 as passed from orders group by o_orderpriority""")
def homogeneity_gate(spark, sf_dir):
    return D.homogeneous(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderstatus"], F.col("o_orderstatus") == "F")


@register(f"""with {CORPUS}, q as (select *, (score >= 7)::int as qa, (score >= 8)::int as qb from c),
    b as (select *, sum(1 - qa) over (partition by model, clip order by {SEQ}) as ba, sum(1 - qb) over (partition by model, clip order by {SEQ}) as bb from q),
    ea as (select model, count(*) filter (where n >= 3) as n from (select model, clip, ba, sum(qa) as n from b group by all) group by model),
    eb as (select model, count(*) filter (where n >= 3) as n from (select model, clip, bb, sum(qb) as n from b group by all) group by model), h as (select model, sum(l_quantity) / 60.0 as hours from c group by model)
    select model, round(ea.n / hours, 6) as far_a, round(eb.n / hours, 6) as far_b, round(case when ea.n > 0 then eb.n / ea.n end, 6) as ratio from h join ea using (model) join eb using (model)""")
def rate_ratio(spark, sf_dir):
    """False-alarm rates of the same clips under two score sources, and their ratio."""
    c = corpus(spark, sf_dir)
    hours = c.groupBy("model").agg((F.sum("l_quantity") / 60.0).alias("hours"))
    count = lambda level, name: S.episodes(c, ["model", "clip"], CORPUS_ORDER, F.col("score") >= level, 3).groupBy("model").agg(F.sum("n_episodes").alias(name))
    out = hours.join(count(7, "na"), "model").join(count(8, "nb"), "model")
    return out.select("model", F.round(F.col("na") / F.col("hours"), 6).alias("far_a"), F.round(F.col("nb") / F.col("hours"), 6).alias("far_b"), F.round(F.try_divide(F.col("nb"), F.col("na")), 6).alias("ratio"))


@register(f"""with {FRAMES} select scenario, config, round(avg(value) filter (where model = 0), 6) as m0, round(avg(value) filter (where model = 1), 6) as m1, round(avg(value) filter (where model = 2), 6) as m2 from f group by scenario, config""")
def score_pivot(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("scenario", "config").pivot("model", [0, 1, 2]).agg(F.round(F.avg("value"), 6)).withColumnsRenamed({"0": "m0", "1": "m1", "2": "m2"})


@register(f"""with {FRAMES}, m as (select distinct user_id as run_id from events), k as (select run_id, bool_or(cls = 'error' and value >= 99) as bad from f group by run_id)
    select m.run_id, coalesce(bad, true) as failed from m left join k using (run_id)""")
def any_failure(spark, sf_dir):
    """A run has failed if any of its records says so, or if it has none."""
    f = frames(spark, sf_dir)
    found = f.groupBy("run_id").agg(F.bool_or((F.col("cls") == "error") & (F.col("value") >= 99)).alias("bad"))
    return f.select("run_id").distinct().join(found, "run_id", "left").select("run_id", F.coalesce("bad", F.lit(True)).alias("failed"))


@register("select page_id % 10 as part, count(*) as n, bool_and(contains(url, '/en/')) as all_english, count(*) filter (where contains(url, '/en/')) as n_english from pages where url is not null group by 1")
def path_types(spark, sf_dir):
    """Whether all paths of a part are of one type."""
    english = F.contains("url", F.lit("/en/"))
    p = table(spark, sf_dir, "pages").filter("url is not null").groupBy((F.col("page_id") % 10).alias("part"))
    return p.agg(F.count("*").alias("n"), F.bool_and(english).alias("all_english"), F.count_if(english).alias("n_english"))


@register(f"with {CORPUS} select model, count(*) as n, round(sum(l_quantity), 6) as quantity from c where l_quantity >= 10 and l_quantity < 30 and model in ('A', 'N') group by model")
def tier_counts(spark, sf_dir):
    t = D.tier(corpus(spark, sf_dir), "l_quantity", 10, 30, {"model": ["A", "N"]})
    return t.groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@register("""with a as (select regexp_replace(url, '[?#].*$', '') as stem, count(*) as n_pages from pages where url is not null group by 1), b as (select distinct url from pages where contains(url, '?'))
    select stem, n_pages, count(*) as n_variants from b join a on stem = regexp_replace(url, '[?#].*$', '') group by stem, n_pages""")
def stem_matches(spark, sf_dir):
    """Addresses with a query and the pages that are equal to them up to it."""
    url = table(spark, sf_dir, "pages").select("url").filter("url is not null")
    stems = url.groupBy(F.regexp_replace("url", "[?#].*$", "").alias("ref")).agg(F.count("*").alias("n_pages"))
    variants = url.filter(F.contains("url", F.lit("?"))).distinct()
    return D.by_stem(stems, variants, "ref", "url", "[?#].*$").groupBy("stem", "n_pages").agg(F.count("*").alias("n_variants"))


@register(f"""with {RUNS}, st as (select run_id, min(t_post) as t from f group by run_id), x as (select r.*, case when t < 1704153600000000000 then 'one' else 'two' end as regime from r join st using (run_id)),
    g as (select config, model, count(ttd) filter (where regime = 'one') as n_before, count(ttd) filter (where regime = 'two') as n_after, floor(avg(round(ttd * 1e6)::bigint) filter (where regime = 'one'))::bigint as b, floor(avg(round(ttd * 1e6)::bigint) filter (where regime = 'two'))::bigint as a from x group by config, model)
    select config, model, n_before, n_after, b as mean_before, a as mean_after, a - b as shift from g where n_before > 0 and n_after > 0""")
def concurrency_shift(spark, sf_dir):
    """Delays of runs that started before and after a change of regime, within cells; means in whole microhours, so no tie is rounded."""
    start = frames(spark, sf_dir).groupBy("run_id").agg(F.when(F.min("t_post") < 1704153600000000000, "one").otherwise("two").alias("regime"))
    r = runs(spark, sf_dir).withColumn("delay", F.round(F.col("ttd") * 1e6).cast("long"))
    out = D.regime_shift(r.join(start, "run_id"), ["config", "model"], "regime", "delay", "one", "two")
    out = out.withColumns({c: F.floor(c) for c in ("mean_before", "mean_after")})
    return out.withColumn("shift", F.col("mean_after") - F.col("mean_before"))


#: Replicates of a full bootstrap.
REPLICATES = 1000


@register(f"""with {CORPUS}, q as (select *, case when score >= 7 then 1 else 0 end as q from c),
    b as (select *, sum(1 - q) over (partition by model, clip order by {SEQ}) as brk from q),
    i as (select model, clip, brk, sum(q) as n, sum(l_quantity) as quantity from b group by all),
    k as (select model, clip, count(*) filter (where n >= 3) as n, sum(quantity) / 60.0 as hours from i group by model, clip),
    p(i, s) as (values (0, 0.36787944117144233), (1, 0.7357588823428847), (2, 0.9196986029286058), (3, 0.9810118431238462), (4, 0.9963401531726563), (5, 0.9994058151824183), (6, 0.9999167588507119), (7, 0.9999897508033253), (8, 0.9999988747974021)),
    u as (select clip, rep, ('0x' || substr(md5(rep || '-' || clip), 1, 8))::bigint / 4294967296.0 as u from (select distinct clip from c), (select unnest(range(0, {REPLICATES})) as rep)),
    w as (select clip, rep, (select count(*) from p where u >= s) as weight from u),
    x as (select model, rep, sum(n * weight) / sum(hours * weight) as far from k join w using (clip) group by model, rep)
    select model, round(quantile_cont(far, 0.025), 6) as low, round(quantile_cont(far, 0.975), 6) as high from x group by model""")
def far_bootstrap_full(spark, sf_dir):
    """As far_bootstrap, but each clip's weight is a Poisson draw of its own; clips are counted once before they meet the draws."""
    c = corpus(spark, sf_dir)
    n = S.episodes(c, ["model", "clip"], CORPUS_ORDER, F.col("score") >= 7, 3)
    hours = c.groupBy("model", "clip").agg((F.sum("l_quantity") / 60.0).alias("hours"))
    w = C.replicate_weights(c.select("clip").distinct(), F.col("clip"), REPLICATES)
    x = n.join(hours, ["model", "clip"]).join(w, "clip").groupBy("model", "rep").agg((F.sum(F.col("n_episodes") * F.col("weight")) / F.sum(F.col("hours") * F.col("weight"))).alias("far"))
    return x.groupBy("model").agg(F.round(F.percentile("far", 0.025), 6).alias("low"), F.round(F.percentile("far", 0.975), 6).alias("high"))
