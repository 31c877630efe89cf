"""Queries that stream a table, or write it as run logs and read these again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import runs as R
from ..operators.sequence import with_streak
from ..sources import runlogs as L
from ..sources import tables as T
from ..streaming.alarms import alarm_stream, finished_runs, loss_stream, replay_safe, timeout_misses
from ..streaming.timers import timed_alarms, timer_store
from .registry import FRAMES, RUNS, register
from .views import ONSET_NS, frames, partitions, runs, spread, table


@register(f"""with {FRAMES}, s0 as (select *, case when value >= 60 then 1 else 0 end as q from f), s1 as (select *, sum(1 - q) over (partition by run_id order by t_post, frame_idx) as brk from s0),
    s as (select *, case when q = 1 then sum(q) over (partition by run_id, brk order by t_post, frame_idx) else 0 end as streak from s1),
    e as (select run_id as key, t_post as t from s where streak = 3), w as (select run_id, t_post, lag(t_post, 2) over (partition by run_id order by t_post, frame_idx) as t0 from f where value >= 60)
    select key, t, 'episode' as rule from e union all select key, min(t), 'first' from e group by key union all select run_id, t_post, 'window' from w where t_post - t0 <= 86400000000000""")
def alarm_stream_parity(spark, sf_dir):
    """The streaming alarms over the events as a stream; equal to the rules on the table."""
    at = T.work_folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    stream = stream.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    out = alarm_stream(stream, "user_id", "t", "event_id", F.col("value") >= 60, 3, 86_400_000_000_000)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/alarms").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("key long, t long, rule string").parquet(f"{at}/alarms")


@register(f"""with {FRAMES}, s0 as (select *, case when value >= 60 then 1 else 0 end as q from f), s1 as (select *, sum(1 - q) over (partition by run_id order by t_post, frame_idx) as brk from s0),
    s as (select *, case when q = 1 then sum(q) over (partition by run_id, brk order by t_post, frame_idx) else 0 end as streak from s1),
    e as (select run_id as key, t_post as t from s where streak = 3), w as (select run_id, t_post, lag(t_post, 2) over (partition by run_id order by t_post, frame_idx) as t0 from f where value >= 60),
    l as (select run_id, max(t_post) as t from f group by run_id), n as (select max(t_post) - 3600000000000 as seen from f)
    select key, t, 'episode' as rule from e union all select key, min(t), 'first' from e group by key union all select run_id, t_post, 'window' from w where t_post - t0 <= 86400000000000
    union all select run_id, t, 'miss' from l, n where t // 1000000 + 21600000 <= seen // 1000000 and run_id not in (select key from e)""")
def alarms_with_timers(spark, sf_dir):
    """The streaming alarms with an event-time timer for each run: one that is silent for six hours ends, as a miss if it had no alarm."""
    at = T.work_folder(spark)
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*")
    out = timed_alarms(stream, "user_id", "ts", "event_id", F.col("value") >= 60, 3, 86_400_000_000_000, "6 hours", "1 hour")
    with timer_store(spark):
        out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/alarms").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key long, t long, rule string").parquet(f"{at}/alarms")


@register("""with o as (select user_id, ts from events where event_type = 'signup'), a as (select user_id, ts from events where value >= 60),
    w as (select least((select max(ts) from o), (select max(ts) from a)) - interval 1 hour as seen),
    m as (select user_id, ts from o where not exists (select 1 from a where a.user_id = o.user_id and a.ts >= o.ts and a.ts <= o.ts + interval 1 day))
    select user_id as run, epoch_us(ts) as onset_us, epoch_us(ts) + 86400000000 as miss_us from m, w where ts + interval 1 day < seen""")
def stream_timeouts(spark, sf_dir):
    """Signups of a stream that no high value follows within a day, as far as the watermark tells."""
    at = T.work_folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = timeout_misses(stream().filter("event_type = 'signup'"), stream().filter("value >= 60").withColumnRenamed("ts", "t"), "user_id", "ts", "t", "1 day")
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/misses").trigger(availableNow=True).start()
    q.awaitTermination()
    back = spark.read.schema("run long, onset timestamp, t_miss timestamp").parquet(f"{at}/misses")
    return back.select("run", F.unix_micros("onset").alias("onset_us"), F.unix_micros("t_miss").alias("miss_us"))


#: The runs of a log as SQL: stamps, alarm, onset and faults as ``_log_records`` writes them.
_LOGGED = f"""{FRAMES},
n as (select fo.*, row_number() over (partition by run_id order by t_post, frame_idx) - 1 as i, cast(json_extract_string(props, '$.k') as bigint) as k from fo),
s0 as (select *, case when value >= 60 then 1 else 0 end as q from n),
s1 as (select *, sum(1 - q) over (partition by run_id order by i) as brk from s0),
s2 as (select *, case when q = 1 then sum(q) over (partition by run_id, brk order by i) else 0 end as streak from s1),
w as (select run_id, min(t_post) as t_window from (select run_id, t_post, t_onset, lag(t_post, 2) over (partition by run_id order by i) as t0 from n where value >= 60) where t_post - t0 <= 86400000000000 and t_post >= t_onset group by run_id),
g as (
    select run_id, max(config) as config, max(t_onset) as t_onset, count(*) as n, count(*) filter (where cls = 'error') as n_drops, max(t_post) as t_last,
           arg_min({{'t': t_post, 'i': i}}, i) filter (where streak = 3) as a, arg_min({{'t': t_post, 'i': i}}, i) filter (where streak >= 3 and t_post >= t_onset) as m,
           min(t_post) filter (where q = 1 and t_post >= t_onset) as t_first, count(*) filter (where t_post >= t_onset) as n_post, count(*) filter (where q = 1 and t_post >= t_onset) as n_qual,
           avg(i % 7) as acq, avg(i % 9) as infer, median(i % 9) as infer_median
    from s2 group by run_id
),
x as (
    select *, a.t + 1000000 as t_alarm, case when config = 4 then 4::double else 0::double end as transfer, coalesce(a.t + 1000000 >= t_onset and a.t + 1000000 - t_onset <= 432000000000000, false) as hit,
           coalesce(m.t - t_onset <= 432000000000000, false) as meas_hit, coalesce(t_window - t_onset <= 432000000000000, false) as win_hit,
           case when run_id % 30 = 4 then 'broken line' when run_id % 40 = 11 then 'no header' when a.t is not null and t_onset is null then 'alarm without onset' when run_id % 25 = 9 then 'transfer without an answer' end as error
    from g left join w using (run_id)
)"""


def _log_records(f):
    """The observations as log records of all types; some runs lack a header, an onset or the answer's stamps."""
    at = Window.partitionBy("run_id").orderBy("t_post", "frame_idx")
    f = with_streak(f.withColumn("i", F.row_number().over(at) - 1), ["run_id"], ["i"], F.col("value") >= 60)
    k, mm = F.get_json_object("props", "$.k").cast("long"), 1_000_000
    t, remote = F.col("t_post"), F.col("config") == 4
    det = F.array(F.struct(F.lit("Gun").alias("cls"), (F.col("value") / 100).alias("conf"), F.array(F.lit(0.0)).alias("xyxy")))
    stamps = {"t_capture": t - (k + 12) * mm, "t_infer_start": t - (F.col("i") % 9 + 2) * mm, "t_infer_end": t - 2 * mm, "t_send": F.when(remote, t - (k + 11) * mm), "t_recv_server": F.when(remote, t - (k + 8) * mm)}
    answer = {"t_resp_send": F.when(remote, t - 2 * mm), "t_resp_recv": F.when(remote & (F.col("run_id") % 25 != 9), t - mm)}
    kind = lambda name: F.lit(name).alias("type")
    frame = f.select("run_id", kind("frame"), F.col("i").cast("long").alias("frame_idx"), *(v.alias(c) for c, v in {**stamps, **answer}.items()), "t_post", det.alias("detections"))
    emit = f.select("run_id", kind("emit"), F.col("i").cast("long").alias("frame_idx"), (t - (k + 12 + F.col("i") % 7) * mm).alias("t"))
    drop = f.filter("cls = 'error'").select("run_id", kind("drop"), F.col("i").cast("long").alias("frame_idx"), t.alias("t"))
    runs = f.groupBy("run_id").agg(F.max("config").alias("config"), F.min(F.when(t >= ONSET_NS, t)).alias("t_onset"), F.min(F.when(F.col("streak") == 3, F.struct("i", "t_post"))).alias("a"))
    onset = runs.filter("t_onset is not null").select("run_id", kind("onset_ref"), F.col("t_onset").alias("t"))
    alarm = runs.filter("a is not null").select("run_id", kind("alarm"), F.col("a.i").cast("long").alias("frame_idx"), (F.col("a.t_post") + mm).alias("t"))
    header = runs.filter("run_id % 40 <> 11").select("run_id", kind("header"), F.struct(F.concat(F.lit("c"), "config").alias("deployment"), F.lit("lan").alias("network_profile")).alias("cell"), F.lit(1).cast("long").alias("t_monotonic_at_header"))
    end = runs.filter("run_id % 2 = 0").select("run_id", kind("end"), F.lit("done").alias("reason"))
    out = frame
    for more in (emit, drop, onset, alarm, header, end):
        out = out.unionByName(more, True)
    return out


def _written(spark, sf_dir, at, keep="true"):
    """Write the log of the runs to keep; the records, and the number of files that they fill.

    An event makes three records at most, a run four of its own.  Files, and the
    partitions that make them, grow with the events, so that no task sorts
    more records in a larger table.
    """
    f = frames(spark, sf_dir)
    records = _log_records(spread(f, ["run_id"])).filter(keep)
    files = partitions(f, rows=100_000)
    L.write_logs(records, at, "run_id", files)
    return records, files


def _judged(spark, sf_dir):
    """The log written to a few files, with a broken line in some runs, read back and judged; the second table has the runs set aside."""
    at = T.work_folder(spark)
    records, files = _written(spark, sf_dir, f"{at}/logs")
    broken = records.filter("type = 'frame' and frame_idx = 0 and run_id % 30 = 4").select(F.concat(F.lit('{"run_id": '), F.col("run_id").cast("string"), F.lit(', "type": "fra')).alias("value"))
    broken.write.mode("append").text(f"{at}/logs")
    found, bad = L.read_logs(spark, f"{at}/logs", run_field="run_id")
    judged = R.judged_runs(found.repartition(files, "run_id"), ["gun"], 0.6, 3, timeout_s=5 * 86400.0, window_ms=86_400_000)
    return R.with_labels(judged, L.headers(found)), bad


_MS = "round({0} / 1e6, 6)"


@register(f"""with {_LOGGED} select cast(run_id as varchar) as run_id, 'c' || config || '-lan' as config_label, n as n_frames_emitted, n as n_frames_processed, n_drops, round(n_drops / (n + n_drops), 6) as drop_rate, hit, not hit as miss, coalesce(t_alarm < t_onset, false) as false_alarm_pre_onset,
    case when hit then {_MS.format("(t_alarm - t_onset)")} end as ttd_ms, case when hit then cast(a.i % 7 as double) end as dt_acq_ms, case when hit then transfer end as dt_transfer_ms, case when hit then cast(a.i % 9 as double) end as dt_infer_ms, case when hit then 2::double end as dt_post_ms,
    case when hit then round((t_alarm - t_onset) / 1e6 - a.i % 7 - transfer - a.i % 9 - 2, 6) end as dt_alarm_ms, case when hit then 1::double end as dt_decision_ms,
    meas_hit, case when meas_hit then {_MS.format("(m.t - t_onset)")} end as ttd_meas_ms, case when meas_hit then round((m.t - t_onset) / 1e6 - m.i % 7 - transfer - m.i % 9 - 2, 6) end as dt_alarm_meas_ms,
    win_hit, case when win_hit then {_MS.format("(t_window - t_onset)")} end as ttd_win_ms, {_MS.format("(t_first - t_onset)")} as t_first_det_ms, case when meas_hit then {_MS.format("(m.t - t_first)")} end as t_accum_ms, {_MS.format("(t_last - t_onset)")} as followup_ms,
    n_post as n_frames_post_onset, n_qual as n_qualifying_post_onset, round(acq, 6) as pf_dt_acq_ms, transfer as pf_dt_transfer_ms, round(infer, 6) as pf_dt_infer_ms, 2::double as pf_dt_post_ms, infer_median as pf_dt_infer_median_ms, round(acq + transfer + infer + 2, 6) as pf_latency_ms,
    case when run_id % 2 = 0 then 'done' else 'unknown' end as end_reason from x where error is null""")
def run_log_metrics(spark, sf_dir):
    """Events written as run logs, read back with the log schema and folded to the run table; runs with an error are left out."""
    judged, _ = _judged(spark, sf_dir)
    keep = """run_id config_label n_frames_emitted n_frames_processed n_drops drop_rate hit miss false_alarm_pre_onset ttd_ms dt_acq_ms dt_transfer_ms dt_infer_ms dt_post_ms dt_alarm_ms dt_decision_ms
        meas_hit ttd_meas_ms dt_alarm_meas_ms win_hit ttd_win_ms t_first_det_ms t_accum_ms followup_ms n_frames_post_onset n_qualifying_post_onset
        pf_dt_acq_ms pf_dt_transfer_ms pf_dt_infer_ms pf_dt_post_ms pf_dt_infer_median_ms pf_latency_ms end_reason""".split()
    kinds = dict(judged.dtypes)
    return judged.filter("error is null").select(*(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in keep))


@register(f"with {_LOGGED} select cast(run_id as varchar) as run_id, error from x where error is not null")
def run_log_errors(spark, sf_dir):
    """The runs that the run table leaves out, each with its reason: a line that cannot be read, or records that do not fit together."""
    judged, bad = _judged(spark, sf_dir)
    return bad.select("run_id", F.lit("broken line").alias("error")).unionByName(judged.filter("error is not null").select("run_id", "error"))


@register(f"""with {_LOGGED} select 'c' || x.config as deployment, 'lan' as profile, count(*) as n_frames, count(distinct n.run_id) as n_runs from n join x using (run_id) where run_id % 30 <> 4 and run_id % 40 <> 11 group by x.config""")
def stamped_frames(spark, sf_dir):
    """Frames of all logs with the fields of their run's header on every line."""
    at = T.work_folder(spark)
    _written(spark, sf_dir, at, "run_id % 30 <> 4")
    found, _ = L.read_logs(spark, at, run_field="run_id")
    stamped = L.with_header(found, {"deployment": "cell.deployment", "profile": "cell.network_profile"})
    return stamped.groupBy("deployment", "profile").agg(F.count("*").alias("n_frames"), F.count_distinct("run_id").alias("n_runs"))


#: What the text log of a run says about it, the first one that any line shows.
LINE_RULES = {"crash": "error value=9[5-9][0-9][0-9]$", "overload": "purchase value=9[0-9][0-9][0-9]$", "noise": "error value="}


@register(f"""with l as (select user_id, event_type || ' value=' || cast(round(value * 100) as int) as line from events)
    select cast(user_id as varchar) as run_id, count(*) as n_lines, case when bool_or(regexp_matches(line, '{LINE_RULES["crash"]}')) then 'crash' when bool_or(regexp_matches(line, '{LINE_RULES["overload"]}')) then 'overload'
           when bool_or(regexp_matches(line, '{LINE_RULES["noise"]}')) then 'noise' else 'other' end as category from l group by user_id""")
def text_log_categories(spark, sf_dir):
    """The events as text logs of many runs in shared files, read back line by line and put into categories by run."""
    at = T.work_folder(spark)
    line = F.concat(F.lit("run="), F.col("user_id").cast("string"), F.lit(" "), "event_type", F.lit(" value="), F.round(F.col("value") * 100).cast("int").cast("string"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(at)
    return D.first_line_category(L.text_lines(spark, at, "^run=([0-9]+) "), ["run_id"], "line", LINE_RULES)


@register("""with r as (select o_custkey as k, bool_or(o_orderstatus = 'F' and o_totalprice > 300000) as bad, count(*) as n from orders group by 1)
    select c_custkey as customer, coalesce(n, 0) as n_records, coalesce(bad, true) as failed from customer left join r on k = c_custkey""")
def failed_customers(spark, sf_dir):
    """Customers of whom some order failed, or who have none; runs and records come from two tables."""
    runs_ = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))
    records = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer")
    return D.failed_runs(runs_, records, ["customer"], (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))


@register("""with e as (select user_id, event_type, ts, time_bucket(interval 1 day, ts) as start from events), w as (select max(ts) - interval 1 hour as seen from events)
    select epoch_us(start) as start_us, user_id, count(*) as n, count(*) filter (where event_type = 'error') as n_drops from e, w where start + interval 1 day <= seen group by start, user_id""")
def loss_by_day(spark, sf_dir):
    """Frames and drops of the event stream by run and day, as far as the watermark has closed the day."""
    at = T.work_folder(spark)
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = loss_stream(stream, "user_id", "ts", F.col("event_type") == "error")
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/days").trigger(availableNow=True).start().awaitTermination()
    back = spark.read.schema("start timestamp, user_id long, n long, n_drops long").parquet(f"{at}/days")
    return back.select(F.unix_micros("start").alias("start_us"), "user_id", "n", "n_drops")


@register("select n_name as nation, count(*) as n, round(sum(c_acctbal), 2) as total from customer join nation on c_nationkey = n_nationkey group by n_name")
def csv_round_trip(spark, sf_dir):
    """Customers by nation, written as CSV and read back by schema before they are added up."""
    at = T.work_folder(spark)
    met = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    T.write_csv(met.select("c_custkey", F.col("n_name").alias("nation"), "c_acctbal"), at, ["c_custkey"])
    back = T.read_csv(spark, at, "c_custkey long, nation string, c_acctbal double")
    return back.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@register("select o_orderpriority as priority, count(*) as n, count(*) filter (where o_orderstatus = 'F') as n_done from orders where o_orderpriority <> '5-LOW' group by o_orderpriority")
def partitioned_orders(spark, sf_dir):
    """Orders in one folder for each priority; the filter prunes folders."""
    at = T.work_folder(spark)
    T.write_partitioned(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority")), at, ["priority"])
    back = spark.read.parquet(at).filter("priority <> '5-LOW'")
    return back.groupBy("priority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))


@register(f"with {RUNS}, j as (select config, count(*) as n, count(*) filter (where hit) as hits from r group by config) select 'config ' || config as key, hits || ' of ' || n as value from j")
def run_report(spark, sf_dir):
    """Runs as a stage table, summed up as a key-value report and read back."""
    at = T.work_folder(spark)
    staged = T.stage_table(runs(spark, sf_dir).select("run_id", "config", "hit"), f"{at}/runs")
    done = staged.groupBy("config").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    T.write_report(done.select(F.concat(F.lit("config "), F.col("config").cast("string")).alias("k"), F.concat_ws(" of ", F.col("hits").cast("string"), F.col("n").cast("string")).alias("v")), f"{at}/report", "k", "v")
    return T.read_report(spark, f"{at}/report")


@register("select s_suppkey as supplier, n_name as name, s_acctbal as balance from supplier join nation on s_nationkey = n_nationkey")
def registry_lookup(spark, sf_dir):
    """Nations as a registry of JSON lines that suppliers look up."""
    at = T.work_folder(spark)
    table(spark, sf_dir, "nation").write.json(at)
    nations = T.registry(spark, at, "n_nationkey int, n_name string", "n_nationkey")
    met = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
    return met.select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("name"), F.col("s_acctbal").alias("balance"))


@register("select event_type as cls, count(*) as n from events group by 1")
def replayed_events(spark, sf_dir):
    """The events as a stream that sends every row twice; each counts once."""
    at = T.work_folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    once = lambda: spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("at", F.col("ts").cast("timestamp"))
    out = replay_safe(once().unionByName(once()), "user_id", "event_id", "at", "60 days").select("user_id", "event_id", "event_type")
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").option("path", f"{at}/events").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/events").groupBy(F.col("event_type").alias("cls")).agg(F.count("*").alias("n"))


@register("select user_id as run_id, count(*) as n, max(event_id) as last_event, round(avg(value), 6) as mean from events group by user_id having bool_or(value >= 99)")
def finished_run_means(spark, sf_dir):
    """Runs of the event stream that have an end, in micro-batches of one file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*").withColumnRenamed("user_id", "run_id")
    summary = [F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.round(F.avg("value"), 6).alias("mean")]
    return finished_runs(stream, "run_id", F.col("value") >= 99, summary, T.work_folder(spark))
