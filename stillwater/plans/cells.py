"""Queries on cells and pairs: half-widths of all metrics, gated tests, tests by layer, copies of clips, prefix matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import normality as N
from ..functions import tails
from ..operators import audit as A
from ..operators import compare as T
from ..operators import decide as D
from ..operators import points as P
from ..operators import sequence as S
from ..operators.survival import cut
from .alarms import SEQ
from .registry import CORPUS, RUNS, any_chi2_tail, chi2_tail, register, t_quantile, t_tail
from .views import CORPUS_ORDER, corpus, runs, table

METRICS = ("accum", "followup", "t_first", "ttd")


@register(f"""with {RUNS}, u as (select config, model, metric, value from (select config, model, accum, followup, t_first, ttd from r) unpivot (value for metric in (accum, followup, t_first, ttd))),
    g as (select config, model, metric, count(*) as n, avg(value) as mean, stddev_samp(value) as sd from u group by 1, 2, 3 having count(*) >= 2),
    q as (select n, {t_quantile("(n - 1)")} as t from (select distinct n from g)),
    h as (select *, t * sd / sqrt(n) as half from g join q using (n))
    select config, model, metric, n, round(mean, 4) as mean, round(half, 6) as half_width, round(case when mean <> 0 then 100 * half / mean end, 6) as half_width_pct from h""")
def cell_half_widths(spark, sf_dir):
    """Half-widths of the 95 percent t interval of every metric in every cell, absolute and in percent of the mean."""
    out = T.cell_half_widths(runs(spark, sf_dir), ["config", "model"], list(METRICS))
    return out.select("config", "model", "metric", "n", F.round("mean", 4).alias("mean"), *(F.round(c, 6).alias(c) for c in ("half_width", "half_width_pct")))


def _ways(most: int) -> str:
    """SQL of the ways to reach each rank sum of up to ``most`` ranks, as rows (n, ways)."""
    sums = most * (most + 1) // 2 + 1
    return f"""ways as (
    with recursive v(n, ways) as (
        select 0, list_transform(range(0, {sums}), lambda i: case when i = 0 then 1.0::double else 0.0 end)
        union all select n + 1, list_transform(range(0, {sums}), lambda i: ways[i + 1] + case when i > n then ways[i - n] else 0 end) from v where n < {most}
    ) select * from v
)"""


def _poly(c, x: str) -> str:
    return "(" + " + ".join(f"({v}) * ({x}) ** {i}" for i, v in enumerate(c)) + ")"


def _normal(z: str) -> str:
    """SQL of the lower tail of the normal distribution."""
    half = f"{chi2_tail(f'({z}) * ({z})', '1')} / 2"
    return f"(case when ({z}) < 0 then {half} else 1 - {half} end)"


#: Shapiro-Wilk of the differences of every pair of configurations as SQL: a, b, n, p.
_SHAPIRO = f"""
sd as (select x.config as a, y.config as b, x.ttd - y.ttd as d from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config < y.config where x.ttd is not null and y.ttd is not null),
so as (select *, row_number() over (partition by a, b order by d) as i, count(*) over (partition by a, b) as n from sd),
sq as (select n, i, list_reduce(list_transform(range(0, 60), lambda k: [-8.0::double, 8.0::double]), lambda s, k: case when {_normal("(s[1] + s[2]) / 2")} < (i - 0.375) / (n + 0.25) then [(s[1] + s[2]) / 2, s[2]] else [s[1], (s[1] + s[2]) / 2] end)[1] as m
       from (select distinct n, i from so where n between {N.LEAST} and {N.MOST})),
ss as (select a, b, max(n) as n, sum(m * d) as mx, sum(m * m) as mm, min(d) as e1, max(d) filter (where i = 2) as e2, max(d) filter (where i = n - 1) as e3, max(d) as e4,
              var_pop(d) * count(*) as ss, max(m) as m1, max(m) filter (where i = n - 1) as m2, max(abs(d)) as most from so join sq using (n, i) group by a, b),
sw0 as (select *, {_poly(N.LAST, "1 / sqrt(n)")} + m1 / sqrt(mm) as a1, {_poly(N.LAST_BUT_ONE, "1 / sqrt(n)")} + m2 / sqrt(mm) as a2 from ss),
sw as (select *, least(1, case when n = 3 then 0.5 * (e4 - e1) ** 2 / ss
           when n <= 5 then (a1 * (e4 - e1) + (mx - m1 * (e4 - e1)) / sqrt((mm - 2 * m1 ** 2) / (1 - 2 * a1 ** 2))) ** 2 / ss
           else (a1 * (e4 - e1) + a2 * (e3 - e2) + (mx - m1 * (e4 - e1) - m2 * (e3 - e2)) / sqrt((mm - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))) ** 2 / ss end) as w from sw0),
sz as (select *, case when w >= 1 then null when n <= 11 and ln(1 - w) >= {_poly(N.GAMMA, "n")} then null when n <= 11 then (-ln({_poly(N.GAMMA, "n")} - ln(1 - w)) - {_poly(N.SMALL_MEAN, "n")}) / exp({_poly(N.SMALL_SPREAD, "n")})
           else (ln(1 - w) - {_poly(N.LARGE_MEAN, "ln(n)")}) / exp({_poly(N.LARGE_SPREAD, "ln(n)")}) end as z from sw),
sp as (select a, b, n, case when e4 - e1 <= 1e-8 + 1e-5 * most then 0 when n = 3 then greatest(0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75)))) when z is null then (w >= 1)::int else 1 - {_normal("z")} end as shapiro_p from sz)"""


@register(f"""with recursive {RUNS}, {_ways(N.EXACT)}, {_SHAPIRO},
    al as (select x.config as a, y.config as b from (select distinct config from r) x join (select distinct config from r) y on x.config < y.config),
    st as (select a, b, count(*) as n_pairs, avg(d) as mean_diff, avg(d) / stddev_samp(d) as dz, avg(d) / stddev_samp(d) * sqrt(count(*)) as t, count(*) filter (where d = 0) as zeros from sd group by a, b),
    sk as (select *, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2.0 as rk, count(*) over (partition by a, b, abs(d)) as ties from sd where d <> 0),
    sr as (select a, b, count(*) as m, least(sum(case when d > 0 then rk else 0 end), sum(case when d < 0 then rk else 0 end)) as w, max(ties) as most, sum(ties * ties - 1) as tied from sk group by a, b),
    x as (select al.a, al.b, coalesce(n_pairs, 0) as n_pairs, mean_diff, dz, t, shapiro_p, w, m, most, tied, zeros, coalesce(n_pairs, 0) < 3 as few, coalesce(shapiro_p > 0.05, false) and t is not null as by_t,
                 (w - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - tied / 48.0) as z
          from al left join st using (a, b) left join sp using (a, b) left join sr using (a, b)),
    y as (select *, case when few then null when by_t then {t_tail("t", "(n_pairs - 1)")} when m is null then 1 when zeros = 0 and most = 1 and m <= {N.EXACT} then (select least(1.0, 2 * list_sum(ways[1:cast(w as int) + 1]) / 2.0 ** m) from ways where ways.n = m)
                       else {any_chi2_tail("(z * z)", "1")} end as p,
          case when few then null when by_t then dz when m is null then 0 else abs((w - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0)) / sqrt(m) end as effect from x)
    select a, b, n_pairs, case when few then 'insufficient' when by_t then 'paired-t' else 'signed-ranks' end as test, round(case when not few then mean_diff end, 6) as mean_diff, round(case when not few then shapiro_p end, 6) as shapiro_p,
           round(case when few then null when by_t then t else w end, 6) as statistic, round(p, 6) as p, round(effect, 6) as effect, round(case when p is not null then least(1.0, p * count(*) over ()) end, 6) as p_bonferroni, coalesce(p * count(*) over () < 0.05, false) as significant from y""")
def gated_pairs(spark, sf_dir):
    """All pairs of configurations by the t test or signed ranks, as a normality test of their differences decides."""
    out = T.gated_tests(runs(spark, sf_dir), "config", ["model", "scenario"], "ttd")
    return out.select("a", "b", "n_pairs", "test", *(F.round(c, 6).alias(c) for c in ("mean_diff", "shapiro_p", "statistic", "p", "effect", "p_bonferroni")), "significant")


@register(f"""with recursive {RUNS}, {_ways(30)}, p as (select x.config as a, y.config as b, y.ttd - x.ttd as d from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config < y.config where x.ttd is not null and y.ttd is not null),
    z as (select a, b, count(*) filter (where d = 0) as zeros from p group by a, b),
    k as (select *, rank() over (partition by a, b order by abs(d)) + (count(*) over (partition by a, b, abs(d)) - 1) / 2.0 as rk, count(*) over (partition by a, b, abs(d)) as t from p where d <> 0),
    w as (select a, b, count(*) as n, least(sum(case when d > 0 then rk else 0 end), sum(case when d < 0 then rk else 0 end)) as w, max(t) as most from k group by a, b)
    select a, b, w.n, w, round(abs((w - w.n * (w.n + 1) / 4.0) / sqrt(w.n * (w.n + 1) * (2 * w.n + 1) / 24.0)) / sqrt(w.n), 6) as r,
           round(case when zeros = 0 and most = 1 and w.n <= 30 then least(1.0, 2 * list_sum(ways[1:cast(w as int) + 1]) / 2.0 ** w.n) end, 6) as p_exact from w join z using (a, b) left join ways on ways.n = w.n""")
def signed_rank_exact(spark, sf_dir):
    """Signed-rank tests of all pairs of configurations; the exact p of those without ties and zeros, up to 30 differences."""
    out = T.signed_rank_tests(T.label_pairs(runs(spark, sf_dir), "config", ["model", "scenario"], "ttd")).filter("n > 0")
    exact = F.when(F.col("exact") & (F.col("n") <= 30), F.round("p", 6))
    return out.select("a", "b", "n", "w", F.round("r", 6).alias("r"), exact.alias("p_exact"))


@register("""with c as (select l_linestatus as f, l_returnflag = 'R' as o, count(*) as n from lineitem group by 1, 2), l as (select f, o from (select distinct f from c), (select distinct o from c)),
    t as (select f, o, coalesce(n, 0) as n from l left join c using (f, o)), e as (select *, sum(n) over (partition by f) * sum(n) over (partition by o) / sum(n) over () as e, sum(n) over () as total from t)
    select round(sum((abs(n - e) - least(abs(n - e), 0.5)) ** 2 / e), 6) as chi2, (count(distinct f) - 1) * (count(distinct o) - 1) as dof, cast(max(total) as bigint) as n from e""")
def independence_corrected(spark, sf_dir):
    """A table of two by two with the continuity correction."""
    li = table(spark, sf_dir, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return T.chi_square(li, "l_linestatus", "returned", yates=True).withColumn("chi2", F.round("chi2", 6))


@register(f"""with {RUNS}, p as (select x.model, x.config as a, y.config as b, x.hit as ha, y.hit as hb from r x join r y on x.model = y.model and x.scenario = y.scenario and x.config < y.config),
    l as (select cast(model as varchar) as layer, a, b, ha, hb from p union all select 'POOLED', a, b, ha, hb from p),
    d as (select layer, a, b, count(*) filter (where ha and not hb) as only_a, count(*) filter (where hb and not ha) as only_b from l group by 1, 2, 3),
    m as (select *, case when only_a + only_b > 0 then greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b) end as chi2 from d)
    select layer, a, b, only_a, only_b, round(chi2, 6) as chi2, coalesce(chi2 > 7.879438576622417, false) as significant from m""")
def tests_by_layer(spark, sf_dir):
    """Discordant decisions of all pairs of configurations within each model and over all; ten pairs in each layer."""
    hits = runs(spark, sf_dir).select("model", "scenario", "config", "hit")
    x, y = hits.withColumnsRenamed({"config": "a", "hit": "ha"}), hits.withColumnsRenamed({"config": "b", "hit": "hb"})
    met = x.join(y, ["model", "scenario"]).filter("a < b").withColumn("model", F.col("model").cast("string"))
    out = T.mcnemar(P.layers_and_pooled(met, "model", ["0", "1", "2"], {}), "ha", "hb", ["layer", "a", "b"])
    p = tails.chi2_p()(F.col("chi2").cast("double"), F.lit(1.0))
    return out.select("layer", "a", "b", "only_a", "only_b", F.round("chi2", 6).alias("chi2"), F.coalesce(p < 0.05 / 10, F.lit(False)).alias("significant"))


@register(f"""with {RUNS}, m as (select config, avg(ttd) as mu, stddev_samp(ttd) as sd from r where model = 0 group by config), z0 as (select r.config, (ttd - mu) / sd as z from r join m using (config) where model = 1 and ttd is not null),
    z as (select cast(config as varchar) as layer, z from z0 union all select 'POOLED', z from z0), g as (select layer, count(z) as n, avg(z) as mean, stddev_samp(z) as sd from z group by 1),
    t as (select *, (mean + 1) / (sd / sqrt(n)) as t_low, (mean - 1) / (sd / sqrt(n)) as t_high from g where n > 1),
    q as (select *, {t_tail("t_low", "(n - 1)")} as p2_low, {t_tail("t_high", "(n - 1)")} as p2_high from t)
    select layer, n, round(mean, 6) as mean, round(sd, 6) as sd, round(greatest(case when t_low > 0 then p2_low / 2 else 1 - p2_low / 2 end, case when t_high < 0 then p2_high / 2 else 1 - p2_high / 2 end), 6) as p,
           greatest(case when t_low > 0 then p2_low / 2 else 1 - p2_low / 2 end, case when t_high < 0 then p2_high / 2 else 1 - p2_high / 2 end) < 0.05 as equivalent from q""")
def pooled_equivalence(spark, sf_dir):
    """Two one-sided tests of the standardised differences, by configuration and over all."""
    r = runs(spark, sf_dir)
    base = r.filter("model = 0").groupBy("config").agg(F.avg("ttd").alias("mu"), F.stddev_samp("ttd").alias("sd"))
    z = r.filter("model = 1 and ttd is not null").join(F.broadcast(base), "config").select(F.col("config").cast("string").alias("config"), ((F.col("ttd") - F.col("mu")) / F.col("sd")).alias("z"))
    out = T.tost(P.layers_and_pooled(z, "config", [str(k) for k in range(5)], {}), ["layer"], "z").filter("n > 1")
    two = lambda c: tails.t_p()(F.col(c), F.col("n") - 1.0)
    out = out.withColumn("p", D.one_sided_pair_p(F.col("t_low"), F.col("t_high"), two("t_low"), two("t_high")))
    return out.select("layer", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "p")), (F.col("p") < 0.05).alias("equivalent"))


_PAIRS = f"""{CORPUS}, g as (select s_suppkey as clip, s_nationkey as source, cast(floor(s_acctbal / 1000) as bigint) as content from supplier),
    pr as (select source, content, min(clip) as a, max(clip) as b from g group by 1, 2 having count(*) = 2),
    s as (select *, row_number() over (partition by model, clip order by {SEQ}) as i from c)"""


def _copies(spark, sf_dir):
    m = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"), "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("content"))
    return A.copy_pairs(m, ["s_nationkey", "content"], "clip")


@register(f"""with {_PAIRS}, n as (select model, clip, count(*) as n from s group by 1, 2), q as (select a, b, x.model, x.n as na, y.n as nb from pr join n x on x.clip = a join n y on y.clip = b and y.model = x.model),
    m as (select a, b, q.model, na, nb, count(*) as met, count(*) filter (where x.score = y.score) as same, max(abs(x.score - y.score)) as worst
          from q join s x on x.clip = a and x.model = q.model join s y on y.clip = b and y.model = q.model and y.i = x.i group by all)
    select model, count(*) as n, count(*) filter (where na = nb and same = na) as n_identical, max(worst) filter (where na = nb and same < na) as worst, count(*) filter (where na <> nb) as n_other_length from m group by model""")
def trace_identity(spark, sf_dir):
    """Whether the second copy of a clip is the same observation again: traces of pairs of copies frame by frame, by model."""
    met = A.trace_identity(corpus(spark, sf_dir), _copies(spark, sf_dir), "clip", ["model"], CORPUS_ORDER, "score")
    return met.groupBy("model").agg(F.count("*").alias("n"), F.count_if("identical").alias("n_identical"), F.max(F.when((F.col("n_a") == F.col("n_b")) & ~F.col("identical"), F.col("worst"))).alias("worst"), F.count_if(F.col("n_a") != F.col("n_b")).alias("n_other_length"))


@register(f"""with {_PAIRS}, st as (select unnest([1, 3]) as stride), t as (select cast(unnest(range(1, 11)) as int) as threshold),
    k as (select s.*, stride, threshold, case when score >= threshold then 1 else 0 end as q from s cross join st cross join t where (i - 1) % stride = 0),
    b as (select *, sum(1 - q) over (partition by model, clip, stride, threshold order by i) as brk from k),
    e0 as (select model, clip, stride, threshold, brk, sum(q) as n from b group by all), e as (select model, clip, stride, threshold, count(*) filter (where n >= 3) as n from e0 group by 1, 2, 3, 4)
    select x.threshold, count(*) as n, count(*) filter (where x.n <> y.n) as n_disagree from pr join e x on x.clip = a join e y on y.clip = b and y.model = x.model and y.stride = x.stride and y.threshold = x.threshold group by x.threshold""")
def trace_decisions(spark, sf_dir):
    """Alarm decisions of the two copies of a clip at every threshold and frame rate: how many disagree."""
    pairs = cut(_copies(spark, sf_dir))
    # only clips that have a copy are looked at, once for both sides of the pairs
    copied = pairs.select(F.explode(F.array("a", "b")).alias("clip")).distinct()
    c = corpus(spark, sf_dir).join(copied, "clip", "left_semi")
    grid = spark.createDataFrame([(t,) for t in range(1, 11)], "threshold int")
    rates = [S.episodes_by_threshold(S.every_nth(c, ["model", "clip"], CORPUS_ORDER, n), ["model", "clip"], ["model", "clip"], CORPUS_ORDER, "score", 3, grid).withColumn("stride", F.lit(n)) for n in (1, 3)]
    found = A.copy_disagreement(cut(rates[0].unionByName(rates[1])), pairs, "clip", ["model", "threshold", "stride"], "n_episodes")
    return found.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if("disagree").alias("n_disagree"))


@register("""with s as (select distinct regexp_extract(url, '^[^?#]*/', 0) as stem from pages where page_id % 3 = 0 and url is not null), u as (select distinct url from pages where url is not null)
    select stem, count(*) as n from s join u on starts_with(url, stem) where stem <> '' group by stem""")
def prefix_matches(spark, sf_dir):
    """Addresses that begin with the folder of a listed one."""
    pages = table(spark, sf_dir, "pages").filter("url is not null")
    stems = pages.filter("page_id % 3 = 0").select(F.regexp_extract("url", "^[^?#]*/", 0).alias("stem")).distinct()
    return D.by_prefix(pages.select("url").distinct(), stems, "url", "stem").groupBy("stem").agg(F.count("*").alias("n"))


@register(f"""with {RUNS}, l as (select model, config, sum(fp_pre::int) / 360.0 as lam from r group by model, config), p as (select r.model, r.config, hit, 1 - exp(-lam * followup) as chance from r join l using (model, config)),
    g as (select model, coalesce(cast(config as varchar), 'ALL') as config, count(*) as n, 100 * avg(chance) as chance_pct, count(*) filter (where hit) as hits from p group by grouping sets ((model, config), (model)))
    select model, config, n, hits, round(chance_pct, 6) as chance_pct, round(100.0 * hits / n - chance_pct, 6) as above_chance from g""")
def hits_above_chance(spark, sf_dir):
    """Hit shares less what chance gives, by cell and pooled by model; both tables have to rest on the same runs."""
    r = runs(spark, sf_dir)
    rates = r.groupBy("model", "config").agg((F.sum(F.col("fp_pre").cast("int")) / 360.0).alias("lam"))
    pooled = lambda df: df.withColumn("config", F.explode(F.array(F.col("config").cast("string"), F.lit("ALL")))).groupBy("model", "config")
    hits = pooled(r).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    chance = X.chance_of_hit(F.col("lam"), F.col("followup") * F.lit(3.6e6))
    expected = pooled(r.join(rates, ["model", "config"])).agg(F.count("*").alias("n"), (100 * F.avg(chance)).alias("chance_pct"))
    out = A.join_equal_counts(hits, expected, ["model", "config"], "n").withColumnRenamed("chance_pct_b", "chance_pct")
    return out.select("model", "config", "n", "hits", F.round("chance_pct", 6).alias("chance_pct"), F.round(100.0 * F.col("hits") / F.col("n") - F.col("chance_pct"), 6).alias("above_chance"))


@register(f"""with {RUNS}, g as (select config, model, count(*) as n, count(*) filter (where hit) as k from r group by 1, 2), c as (select config, model, k || '/' || n || ' (' || printf('%.1f', round(100.0 * k / n, 1)) || ' %)' as cell from g)
    select config, max(cell) filter (where model = 0) as m0, max(cell) filter (where model = 1) as m1, max(cell) filter (where model = 2) as m2 from c group by config""")
def hit_cells(spark, sf_dir):
    """Hits of every configuration and model as text cells, one column a model."""
    cells = runs(spark, sf_dir).groupBy("config", "model").agg(F.count("*").alias("n"), F.count_if("hit").alias("k")).withColumn("cell", X.share_cell(F.col("k"), F.col("n")))
    return cells.groupBy("config").pivot("model", [0, 1, 2]).agg(F.first("cell")).withColumnsRenamed({"0": "m0", "1": "m1", "2": "m2"})


@register("""select source, count(*) as n, count(*) filter (where quality = 1 and toxic = 0 and n_chars >= 100) as n_usable from documents join labels using (doc_id) group by source""")
def usable_annotations(spark, sf_dir):
    """Documents of each source whose label counts: of good quality, not toxic, long enough."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    ok = X.usable(F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars"), 100)
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_usable"))
