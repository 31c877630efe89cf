"""Queries on data quality: duplicates, completeness, reconciliation, agreement, provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import audit as A
from ..operators import compare as T
from ..operators import sequence as S
from .registry import CORPUS, FRAMES, RUNS, register
from .views import CORPUS_ORDER, corpus, frames, runs, table

SEQ = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"


@register("""select doc_id as clip, source, md5(text) as md5, row_number() over (partition by md5(text) order by source, doc_id) = 1 as kept,
    count(*) over (partition by md5(text)) as n_alike from documents""")
def manifest_dedup(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip"), "source", F.md5(F.col("text").cast("binary")).alias("md5"))
    return S.keep_first(m, ["md5"], ["source", "clip"])


@register("""with m as (select doc_id, source, n_chars, row_number() over (partition by md5(text) order by source, doc_id) as k from documents)
    select source, sum(n_chars) as seconds, round(sum(n_chars) / 3600.0, 6) as hours, count(*) filter (where k > 1) as n_duplicates,
           coalesce(sum(n_chars) filter (where k > 1), 0) as duplicate_seconds, round(-ln(0.05) / (sum(n_chars) / 3600.0), 6) as bound, round(3 / (sum(n_chars) / 3600.0), 6) as rule_of_three from m group by source""")
def footage_accounting(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("md5"))
    d = S.keep_first(d, ["md5"], ["source", "doc_id"])
    hours = F.sum("n_chars") / F.lit(3600.0)
    dup = ~F.col("kept")
    return d.groupBy("source").agg(F.sum("n_chars").alias("seconds"), F.round(hours, 6).alias("hours"), F.count_if(dup).alias("n_duplicates"), F.coalesce(F.sum(F.when(dup, F.col("n_chars"))), F.lit(0)).alias("duplicate_seconds"), F.round(-F.log(F.lit(0.05)) / hours, 6).alias("bound"), F.round(3 / hours, 6).alias("rule_of_three"))


@register("select count(*) as n_shared from (select md5(text) from documents intersect select md5(text) from benchmark)")
def corpora_disjoint(spark, sf_dir):
    key = F.md5(F.col("text").cast("binary")).alias("md5")
    return A.overlap(table(spark, sf_dir, "documents").select(key), table(spark, sf_dir, "benchmark").select(key), ["md5"]).agg(F.count("*").alias("n_shared"))


@register("""with a as (select o_custkey as k, count(*) as n from orders group by 1), b as (select c_custkey as k, cast(floor(c_acctbal / 500) as bigint) as n from customer)
    select coalesce(a.k, b.k) as k, a.n as n_a, b.n as n_b, case when b.k is null then 'extra' when a.k is null then 'missing' when abs(a.n - b.n) <= 1 then 'ok' else 'mismatch' end as status from b full join a on a.k = b.k""")
def reconciliation(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.floor(F.col("c_acctbal") / 500).alias("n"))
    return A.reconcile(said, found, ["k"], ["n"], 1.0).select("k", F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), "status")


@register("""with x as (select o_orderkey, cast(ceil(o_totalprice / 60000) as bigint) as expected from orders), f as (select l_orderkey as o_orderkey, count(*) as n from lineitem group by 1)
    select status, count(*) as n from (select case when coalesce(n, 0) = 0 then 'missing' when n < 0.99 * expected then 'short' else 'complete' end as status from x left join f using (o_orderkey)) group by status""")
def completeness(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select("o_orderkey", F.ceil(F.col("o_totalprice") / 60000).alias("expected"))
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return A.completeness(expected, facts, ["o_orderkey"], "expected").groupBy("status").agg(F.count("*").alias("n"))


@register(f"""with {CORPUS}, n as (select *, row_number() over (partition by model, clip order by {SEQ}) as k from c),
    p as (select a.clip, a.score as a, b.score as b from n a join n b on a.clip = b.clip and a.k = b.k and a.model = 'A' and b.model = 'R')
    select clip, count(*) as n, round(avg(abs(a - b)), 6) as mean_diff, max(abs(a - b)) as max_diff, round(avg(((a >= 5) = (b >= 5))::int), 6) as agree_0, round(avg(((a >= 3) = (b >= 3))::int), 6) as agree_1 from p group by clip""")
def score_agreement(spark, sf_dir):
    c = corpus(spark, sf_dir)
    out = A.positional_agreement(c.filter("model = 'A'"), c.filter("model = 'R'"), ["clip"], CORPUS_ORDER, "score", [5, 3])
    return out.select("clip", "n", F.round("mean_diff", 6).alias("mean_diff"), "max_diff", F.round("agree_0", 6).alias("agree_0"), F.round("agree_1", 6).alias("agree_1"))


@register(f"""with {CORPUS} select model, round(corr(score, l_quantity), 6) as r, round(avg(((score >= 5) = (l_quantity >= 25))::int), 6) as same, round(avg((score >= 10)::int), 6) as saturated from c group by model""")
def decision_agreement(spark, sf_dir):
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return corpus(spark, sf_dir).groupBy("model").agg(F.round(F.corr("score", "l_quantity"), 6).alias("r"), share((F.col("score") >= 5) == (F.col("l_quantity") >= 25)).alias("same"), share(F.col("score") >= 10).alias("saturated"))


@register(f"""with {FRAMES} select run_id, arg_max(cls, (t_post, frame_idx)) as last_cls, arg_min(cls, (t_post, frame_idx)) as first_cls, max(t_post) as t_last, bool_or(cls = 'error') as any_failure from f group by run_id""")
def first_and_last(spark, sf_dir):
    at = F.struct("t_post", "frame_idx")
    return frames(spark, sf_dir).groupBy("run_id").agg(F.max_by("cls", at).alias("last_cls"), F.min_by("cls", at).alias("first_cls"), F.max("t_post").alias("t_last"), F.bool_or(F.col("cls") == "error").alias("any_failure"))


@register(f"""with {FRAMES} select config, string_agg(distinct cls, ',' order by cls) as kinds, count(distinct cls) = 1 as homogeneous from f group by config""")
def provenance_sets(spark, sf_dir):
    kinds = F.sort_array(F.collect_set("cls"))
    return frames(spark, sf_dir).groupBy("config").agg(F.array_join(kinds, ",").alias("kinds"), (F.size(kinds) == 1).alias("homogeneous"))


@register("""select page_id, case when starts_with(url, 'https://www.') then 'web/' || substr(url, 13) when starts_with(url, 'https://') then 'tls/' || substr(url, 9) end as path from pages""")
def path_remap(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.remap_prefix(F.col("url"), [("https://www.", "web/"), ("https://", "tls/")]).alias("path"))


@register(f"""with {RUNS}, x as (select scenario from r where config = 0 and hit), y as (select scenario from r where config = 4 and hit),
    b as (select scenario from x intersect select scenario from y), u as (select scenario from x union select scenario from y)
    select (select count(*) from b) as n_both, (select count(*) from u) as n_either, (select count(*) from (select * from u except select * from b)) as n_one""")
def scenario_sets(spark, sf_dir):
    r = runs(spark, sf_dir).filter("hit")
    x, y = (r.filter(F.col("config") == k).select("scenario") for k in (0, 4))
    tagged = x.withColumn("x", F.lit(1)).unionByName(y.withColumn("y", F.lit(1)), allowMissingColumns=True).groupBy("scenario").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return tagged.agg(F.count_if(both).alias("n_both"), F.count("*").alias("n_either"), F.count_if(~both).alias("n_one"))


@register(f"""with {RUNS} select config, count(*) as submitted, count(*) filter (where n_post > 0) as reached_onset, count(*) filter (where n_qualifying_post > 0) as detected, count(*) filter (where hit) as alarmed,
    round(100.0 * (1 - avg(hit::int)), 6) as attrition from r group by config""")
def disposition(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("config").agg(F.count("*").alias("submitted"), F.count_if(F.col("n_post") > 0).alias("reached_onset"), F.count_if(F.col("n_qualifying_post") > 0).alias("detected"), F.count_if("hit").alias("alarmed"), F.round(100.0 * (1 - F.avg(F.col("hit").cast("int"))), 6).alias("attrition"))


@register(f"""with {RUNS} select scenario, round(avg((not hit)::int) filter (where config = 0), 6) as c0, round(avg((not hit)::int) filter (where config = 1), 6) as c1, round(avg((not hit)::int) filter (where config = 2), 6) as c2,
    round(avg((not hit)::int) filter (where config = 3), 6) as c3, round(avg((not hit)::int) filter (where config = 4), 6) as c4 from r group by scenario""")
def miss_matrix(spark, sf_dir):
    p = runs(spark, sf_dir).groupBy("scenario").pivot("config", [0, 1, 2, 3, 4]).agg(F.round(F.avg((~F.col("hit")).cast("int")), 6))
    return p.toDF("scenario", "c0", "c1", "c2", "c3", "c4")


@register(f"""with {RUNS} select coalesce(cast(model as varchar), 'ALL') as model, coalesce(cast(config as varchar), 'ALL') as config, count(*) as n, round(avg(hit::int), 6) as hit_share, round(median(ttd), 6) as median_ttd
    from r group by grouping sets ((model, config), (model), (config), ())""")
def pooled_summaries(spark, sf_dir):
    # each row once for itself and once for every margin that it is in
    r = runs(spark, sf_dir).select("model", "config", "hit", "ttd")
    margin = lambda c: F.explode(F.array(F.col(c), F.lit(None).cast("int")))
    r = r.withColumn("model", margin("model")).withColumn("config", margin("config"))
    out = T.with_quantiles(r, ["model", "config"], [F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_share")], "ttd", {"median_ttd": 0.5})
    out = out.withColumn("median_ttd", F.round("median_ttd", 6))
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("ALL")) for c in ("model", "config")})


@register(f"""with {FRAMES}, x as (select run_id, map_from_entries(list((cls, n) order by cls)) as m from (select run_id, cls, count(*) as n from f group by 1, 2) group by run_id), e as (select m as expected from x where run_id = 0)
    select run_id, len(list_filter(map_keys(m), lambda k: expected[k] is not null and expected[k] <> m[k])) + len(list_filter(map_keys(expected), lambda k: m[k] is null)) as n_differ from x cross join e""")
def version_drift(spark, sf_dir):
    counts = frames(spark, sf_dir).groupBy("run_id", "cls").agg(F.count("*").alias("n"))
    m = counts.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("cls", "n"))).alias("m"))
    expected = F.broadcast(m.filter("run_id = 0").select(F.col("m").alias("expected")))  # one row
    return m.crossJoin(expected).select("run_id", F.size(A.drift(F.col("m"), F.col("expected"))).cast("long").alias("n_differ"))


@register("""with d as (select doc_id, md5(text) as h, n_chars, source from documents), p as (select a.doc_id as a, b.doc_id as b from d a join d b on a.h = b.h and a.doc_id < b.doc_id)
    select count(*) as n_pairs, count(distinct a) as n_left from p""")
def duplicate_pairs(spark, sf_dir):
    """Pairs within groups of equal content, from the group sizes alone."""
    g = table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("h")).agg(F.count("*").alias("n"))
    return g.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"), F.sum(F.col("n") - 1).alias("n_left"))


@register("""with x as (select user_id, event_id, ts, row_number() over (partition by user_id order by md5('7-' || event_id), event_id) as k from events) select user_id, event_id from x where k <= 5""")
def seeded_sample(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.md5(F.concat(F.lit("7-"), F.col("event_id").cast("string")).cast("binary")), "event_id")
    return table(spark, sf_dir, "events").withColumn("_k", F.row_number().over(w)).filter("_k <= 5").select("user_id", "event_id")


@register(f"""with {RUNS} select run_id, config, followup from r where ttd is null and followup is not null order by followup desc, run_id limit 10""")
def longest_misses(spark, sf_dir):
    return runs(spark, sf_dir).filter("ttd is null and followup is not null").orderBy(F.desc("followup"), "run_id").limit(10).select("run_id", "config", "followup")


@register("""select o_custkey, o_orderkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal < 5000)""")
def incremental_scan(spark, sf_dir):
    done = table(spark, sf_dir, "customer").filter("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey"))
    return A.new_keys(table(spark, sf_dir, "orders"), done, ["o_custkey"]).select("o_custkey", "o_orderkey")
