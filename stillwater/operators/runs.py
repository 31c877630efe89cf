"""From log records to one row a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import config_label, drop_rate, max_confidence, ms, qualifies
from .sequence import first_fires, with_streak


def confidence_trace(records: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """``run_id, frame_idx, t_rel_onset_ms, max_conf`` of every frame; the time is null without an onset."""
    onset = records.filter("type = 'onset_ref'").groupBy("run_id").agg(F.max("t").alias("t_onset"))
    f = records.filter("type = 'frame'").join(onset, "run_id", "left")
    return f.select("run_id", "frame_idx", ms(F.col("t_post"), F.col("t_onset")).alias("t_rel_onset_ms"), max_confidence("detections", classes).alias("max_conf"))


#: Stamps of a frame that its latencies are made of.
_STAMPS = ["t_capture", "t_send", "t_recv_server", "t_resp_send", "t_resp_recv", "t_infer_start", "t_infer_end", "t_post"]


def judged_runs(records: DataFrame, classes: list[str], threshold: float = 0.5, k: int = 3, timeout_s: float = 30.0, window_ms: int = 1000) -> DataFrame:
    """One row a run: counts, operational, measured and windowed alarm with their parts, per-frame means, and ``error``.

    The five parts add up to the time to alarm exactly, as the last is what
    remains; ``dt_confirm_window_ms`` and ``dt_decision_ms`` are what it is
    made of: from the onset to the alarm's frame, and from that frame's result
    to the alarm.  The measured alarm is the first streak of ``k`` that is
    complete at or after the onset, the windowed one ``k`` qualifying frames
    within ``window_ms``.  Without an onset all times since it are null, but
    the means over frames stand.

    ``error`` names what makes a run unusable, null if nothing does: no
    header, an alarm without an onset, an alarm that counts without the record
    of its frame or of that frame's emission, a transfer without the answer's stamps.

    The records of a run meet once, sorted by frame, and every rule is read off
    that one pass: a task sorts the records of its runs a single time.  Records
    that are already dealt out by ``run_id`` stay where they are.
    """
    of = lambda kind, value: F.when(F.col("type") == kind, value)
    n_of = lambda kind: F.count_if(F.col("type") == kind)
    a_frame = (F.col("type") == "frame") & F.col("run_id").isNotNull()
    frame = F.struct(*_STAMPS, qualifies("detections", classes, threshold).alias("q"))
    # a row for each frame; the records that belong to none are one row of their run
    f = records.groupBy("run_id", "frame_idx").agg(
        F.max_by(F.when(a_frame, frame), F.when(a_frame, F.col("t_post"))).alias("v"),
        F.count_if(a_frame).alias("_frames"),
        F.max(F.when(F.col("frame_idx").isNotNull(), of("emit", F.col("t")))).alias("t_emit"),
        n_of("header").alias("_headers"),
        n_of("emit").alias("_emits"),
        n_of("drop").alias("_drops"),
        F.max(of("onset_ref", F.col("t"))).alias("_onset"),
        F.min(of("alarm", F.col("t"))).alias("_alarm"),
        F.max(of("end", F.coalesce("reason", F.lit("unknown")))).alias("_end"),
    )
    of_run = Window.partitionBy("run_id")
    f = f.select("*", "v.*", (F.col("_frames") > 0).alias("_frame"), F.max("_onset").over(of_run).alias("t_onset"), F.min_by("frame_idx", "_alarm").over(of_run).alias("_at")).drop("v")

    sent = F.col("t_send").isNotNull() & F.col("t_recv_server").isNotNull()
    transfer = ms(F.col("t_recv_server"), F.col("t_send")) + ms(F.col("t_resp_recv"), F.col("t_resp_send"))
    parts = {"dt_acq": ms(F.col("t_capture"), F.col("t_emit")), "dt_transfer": F.when(sent, transfer).otherwise(0.0), "dt_infer": ms(F.col("t_infer_end"), F.col("t_infer_start")), "dt_post": ms(F.col("t_post"), F.col("t_infer_end"))}
    f = with_streak(f.withColumns({**parts, "_sent": sent}), ["run_id"], ["frame_idx"], F.col("q"), among=F.col("_frame"))
    # the time of the qualifying frame k - 1 before this one
    back = F.expr(f"lag(case when streak >= 1 then t_post end, {k - 1}) ignore nulls over (partition by run_id order by frame_idx)") if k > 1 else F.col("t_post")
    f = f.withColumn("_from", back)
    at = F.struct("t_post", "t_emit", *parts)
    after = F.col("t_post") >= F.col("t_onset")
    fired = (F.col("streak") >= k) & after
    out = f.groupBy("run_id").agg(
        F.sum("_headers").alias("_headers"),
        F.sum("_emits").alias("n_frames_emitted"),
        F.sum("_drops").alias("n_drops"),
        F.min("_alarm").alias("t_alarm"),
        F.max("_end").alias("end_reason"),
        F.count_if("_frame").alias("n_frames_processed"),
        *(F.avg(c).alias(f"pf_{c}_ms") for c in ("dt_acq", "dt_infer", "dt_post")),
        F.when(F.count_if("_frame") > 0, F.coalesce(F.avg(F.when(F.col("_sent"), F.col("dt_transfer"))), F.lit(0.0))).alias("pf_dt_transfer_ms"),
        F.median("dt_infer").alias("pf_dt_infer_median_ms"),
        F.count_if(F.col("_sent") & F.col("dt_transfer").isNull()).alias("_unanswered"),
        F.max(F.when(F.col("_frame") & (F.col("frame_idx") == F.col("_at")), at)).alias("_alarm_frame"),
        F.min_by(F.when(fired, at), F.when(fired, F.col("frame_idx"))).alias("_measured"),
        *first_fires("t_post", "t_onset", k),
        F.min(F.when((F.col("streak") >= 1) & (F.col("t_post") - F.col("_from") <= window_ms * 1_000_000) & after, F.col("t_post"))).alias("t_window"),
    )

    since = lambda t: ms(t, F.col("t_onset"))
    limit = timeout_s * 1000
    hit = F.coalesce((F.col("t_alarm") >= F.col("t_onset")) & (since(F.col("t_alarm")) <= limit), F.lit(False))
    alarm, meas = F.col("_alarm_frame"), F.col("_measured")
    meas_hit = F.coalesce((since(meas.t_post) <= limit) & meas.t_emit.isNotNull(), F.lit(False))
    win_hit = F.coalesce(since(F.col("t_window")) <= limit, F.lit(False))
    rest = lambda total, frame: total - frame.dt_acq - frame.dt_transfer - frame.dt_infer - frame.dt_post
    processed = F.col("n_frames_processed")
    error = (
        F.when(F.col("_headers") == 0, "no header")
        .when(F.col("t_alarm").isNotNull() & F.col("t_onset").isNull(), "alarm without onset")
        .when(hit & alarm.t_post.isNull(), "alarm without its frame")
        .when(hit & alarm.t_emit.isNull(), "alarm without its emission")
        .when(F.col("_unanswered") > 0, "transfer without an answer")
    )
    total = sum((F.coalesce(f"pf_{c}_ms", F.lit(0.0)) for c in ("dt_transfer", "dt_infer", "dt_post")), F.coalesce("pf_dt_acq_ms", F.lit(0.0)))
    return out.select(
        "run_id",
        "n_frames_emitted",
        "n_frames_processed",
        "n_drops",
        drop_rate(F.col("n_drops"), processed).alias("drop_rate"),
        hit.alias("hit"),
        (~hit).alias("miss"),
        F.coalesce(F.col("t_alarm") < F.col("t_onset"), F.lit(False)).alias("false_alarm_pre_onset"),
        F.when(hit, since(F.col("t_alarm"))).alias("ttd_ms"),
        *(F.when(hit, alarm[c]).alias(f"{c}_ms") for c in parts),
        F.when(hit, rest(since(F.col("t_alarm")), alarm)).alias("dt_alarm_ms"),
        F.when(hit, since(alarm.t_emit)).alias("dt_confirm_window_ms"),
        F.when(hit, ms(F.col("t_alarm"), alarm.t_post)).alias("dt_decision_ms"),
        meas_hit.alias("meas_hit"),
        F.when(meas_hit, since(meas.t_post)).alias("ttd_meas_ms"),
        *(F.when(meas_hit, meas[c]).alias(f"{c}_meas_ms") for c in parts),
        F.when(meas_hit, rest(since(meas.t_post), meas)).alias("dt_alarm_meas_ms"),
        win_hit.alias("win_hit"),
        F.when(win_hit, since(F.col("t_window"))).alias("ttd_win_ms"),
        F.when(F.col("t_onset").isNotNull() & (processed > 0), F.lit(float(window_ms))).alias("win_ms"),
        since(F.col("t_first_detection")).alias("t_first_det_ms"),
        F.when(meas_hit, ms(meas.t_post, F.col("t_first_detection"))).alias("t_accum_ms"),
        since(F.col("t_last")).alias("followup_ms"),
        F.col("n_post").alias("n_frames_post_onset"),
        F.col("n_qualifying_post").alias("n_qualifying_post_onset"),
        *(f"pf_{c}_ms" for c in parts),
        "pf_dt_infer_median_ms",
        F.when(processed > 0, total).alias("pf_latency_ms"),
        F.col("pf_dt_infer_ms").alias("mean_frame_infer_ms"),
        F.coalesce("end_reason", F.lit("unknown")).alias("end_reason"),
        error.alias("error"),
    )


def run_metrics(records: DataFrame, classes: list[str], threshold: float = 0.5, k: int = 3, timeout_s: float = 30.0, window_ms: int = 1000, strict: bool = False) -> DataFrame:
    """The rows of ``judged_runs`` without an error; strict stops at the first run that has one."""
    judged = judged_runs(records, classes, threshold, k, timeout_s, window_ms)
    if strict and (bad := judged.filter("error is not null").select("run_id", "error").first()):
        raise ValueError(f"run {bad['run_id']}: {bad['error']}")
    return judged.filter("error is null").drop("error")


def with_labels(metrics: DataFrame, headers: DataFrame) -> DataFrame:
    """Attach the cell of each run and its configuration label."""
    h = headers.select("run_id", "hostname", "deployment", F.coalesce("network_profile", F.lit("none")).alias("network_profile"), "model", "scenario", "repetition", "seed")
    return metrics.join(h, "run_id", "left").withColumn("config_label", config_label(F.col("deployment"), F.col("network_profile")))
