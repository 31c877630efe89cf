"""Hand-computed runs, reading and writing of logs, alarms on streams with their state."""

import itertools
import json
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.operators.audit import exclude
from stillwater.operators.runs import judged_runs, run_metrics
from stillwater.sources import runlogs as L
from stillwater.streaming.alarms import finished_runs, loss_stream, rule_times
from stillwater.streaming.timers import timed_alarms, timer_store

MS = 1_000_000
HEADER = {"type": "header", "schema": 1, "hostname": "h", "t_monotonic_at_header": 0, "cell": {"deployment": "local", "network_profile": None, "model": "m", "scenario": "s", "repetition": 1, "seed": 2}}


def frames(qualifying, n=20, period=40, onset=10, up=0, down=0, remote=False, alarm=None, delay=50):
    """A run of ``n`` frames, captured ``delay`` ms after they are emitted; stamps after that: decode 1, pre 2, inference 3 to 13, post 15."""
    out = [HEADER]
    for i in range(n):
        at = (i * period + delay) * MS
        start = at + (3 + up) * MS
        rec = {"type": "frame", "frame_idx": i, "t_capture": at, "t_decode": at + MS, "t_pre": at + 2 * MS, "t_infer_start": start, "t_infer_end": start + 10 * MS, "t_post": start + (12 + down) * MS, "detections": [{"cls": "Gun", "conf": 0.9 if i in qualifying else 0.1, "xyxy": [0, 0, 1, 1]}]}
        if remote:
            rec |= {"t_send": at + 2 * MS, "t_recv_server": at + (2 + up) * MS, "t_resp_send": start + 11 * MS, "t_resp_recv": start + (11 + down) * MS}
        out += [{"type": "emit", "frame_idx": i, "t": i * period * MS}, rec]
    if onset is not None:
        out.append({"type": "onset_ref", "t": onset * period * MS})
    if alarm:
        out.append({"type": "alarm", "frame_idx": alarm[0], "t": alarm[1] * MS})
    return out


def without(records, kind, idx=None):
    return [r for r in records if not (r["type"] == kind and (idx is None or r.get("frame_idx") == idx))]


KNOWN = frames(range(10, 20), alarm=(12, 12 * 40 + 50 + 15 + 1))
REMOTE = frames(range(10, 20), up=15, down=10, remote=True, alarm=(12, 600))
RUNS = {
    "known": KNOWN,
    "remote": REMOTE,
    "timeout": frames(range(10, 20), alarm=(12, 400 + 31_000)),
    "quiet": frames([], n=1, onset=0),
    "drops": [*frames([], n=2, onset=0), {"type": "drop", "frame_idx": 7, "t": 1}, {"type": "drop", "frame_idx": 8, "t": 1}],
    "latency_only": frames(range(10, 20), onset=None),
    "alarm_no_onset": frames(range(10, 20), onset=None, alarm=(12, 546)),
    "pre_onset": frames(range(0, 5), alarm=(2, 150)),
    "pre_then_streak": frames([*range(0, 5), *range(10, 20)], alarm=(2, 150)),
    "gaps": frames([6, 8, 10], n=14, onset=5),
    "slow": frames([6, 7, 8], n=14, onset=5, period=600),
    "split": frames([7, 8, 9, 10], onset=5),
    "no_header": KNOWN[1:],
    "no_frame": without(KNOWN, "frame", 12),
    "no_emit": without(KNOWN, "emit", 12),
    "unanswered": [{k: v for k, v in r.items() if k != "t_resp_recv"} for r in REMOTE],
    "ended": [*KNOWN, {"type": "end", "t": 1, "reason": "done"}],
    "two_alarms": [*KNOWN, {"type": "alarm", "frame_idx": 15, "t": 700 * MS}],
}


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("logs")
    for name, records in RUNS.items():
        (at / f"{name}.jsonl").write_text("\n".join(map(json.dumps, records)) + "\n\n")
    records, bad = L.read_logs(spark, str(at))
    assert bad.count() == 0
    return records


def test_hand_computed_runs(logs):
    got = {r["run_id"]: r for r in judged_runs(logs, ["gun"]).collect()}
    assert set(got) == set(RUNS)
    errors = {r: x["error"] for r, x in got.items() if x["error"]}
    assert errors == {"alarm_no_onset": "alarm without onset", "no_header": "no header", "no_frame": "alarm without its frame", "no_emit": "alarm without its emission", "unanswered": "transfer without an answer"}
    k = got["known"]
    assert (k.ttd_ms, k.dt_acq_ms, k.dt_transfer_ms, k.dt_infer_ms, k.dt_post_ms, k.dt_alarm_ms, k.dt_confirm_window_ms, k.dt_decision_ms) == (146, 50, 0, 10, 2, 84, 80, 1)
    assert abs(k.ttd_ms - (k.dt_acq_ms + k.dt_transfer_ms + k.dt_infer_ms + k.dt_post_ms + k.dt_alarm_ms)) < 1e-9
    assert (k.pf_dt_acq_ms, k.pf_dt_infer_ms, k.pf_dt_post_ms, k.pf_dt_transfer_ms, k.pf_latency_ms, k.mean_frame_infer_ms) == (50, 10, 2, 0, 62, 10)
    assert (k.meas_hit, k.ttd_meas_ms, k.dt_alarm_meas_ms) == (True, 145, 83) and k.ttd_ms - k.ttd_meas_ms == k.dt_decision_ms
    assert k.end_reason == "unknown" and got["ended"].end_reason == "done" and got["two_alarms"].ttd_ms == 146
    assert (got["remote"].dt_transfer_ms, got["remote"].pf_dt_transfer_ms, got["remote"].dt_transfer_meas_ms) == (25, 25, 25)
    t = got["timeout"]
    assert t.miss and not t.hit and t.ttd_ms is None and t.dt_confirm_window_ms is None
    q = got["quiet"]
    assert q.miss and not q.meas_hit and q.ttd_meas_ms is None and q.win_hit is False
    assert got["drops"].drop_rate == 0.5 and got["drops"].n_drops == 2
    n = got["latency_only"]
    assert n.miss and not n.meas_hit and n.followup_ms is None and n.win_ms is None and n.pf_dt_acq_ms == 50 and n.n_frames_post_onset == 0
    p = got["pre_onset"]
    assert p.miss and p.false_alarm_pre_onset and not p.meas_hit
    s = got["pre_then_streak"]
    assert s.miss and s.false_alarm_pre_onset and s.meas_hit and s.ttd_meas_ms == 145
    g = got["gaps"]
    assert not g.meas_hit and g.win_hit and g.ttd_win_ms == 265 and g.win_ms == 1000
    w = got["split"]
    assert w.t_first_det_ms == 145 and abs(w.t_first_det_ms + w.t_accum_ms - w.ttd_meas_ms) < 1e-9
    assert (w.followup_ms, w.n_frames_post_onset, w.n_qualifying_post_onset) == (625, 16, 4)


def test_wide_windows(logs):
    one, three = ({r["run_id"]: r for r in judged_runs(logs, ["gun"], window_ms=w).collect()}["slow"] for w in (1000, 3000))
    assert one.meas_hit and not one.win_hit and three.win_hit


def test_records_of_a_run_meet_once(logs):
    plan = judged_runs(logs.repartition(5, "run_id"), ["gun"])._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Join") == 1  # the runs set aside by the reader
    text = plan.executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and text.split("REPARTITION_BY_NUM")[0].count("Exchange") == 1, text


def test_records_without_a_frame_break_no_streak(spark, logs):
    skipped = logs.filter("run_id = 'known' and not (type = 'frame' and frame_idx = 11)")
    x = judged_runs(skipped, ["gun"]).first()
    assert (x.n_frames_processed, x.n_frames_emitted, x.ttd_meas_ms, x.ttd_win_ms, x.ttd_ms, x.n_qualifying_post_onset) == (19, 20, 185, 185, 146, 9)
    one = judged_runs(skipped, ["gun"], k=1).first()
    assert (one.ttd_meas_ms, one.ttd_win_ms) == (65, 65)
    bare = judged_runs(logs.filter("run_id = 'known' and type <> 'frame'"), ["gun"]).first()
    assert (bare.error, bare.n_frames_processed, bare.pf_dt_transfer_ms, bare.pf_latency_ms, bare.dt_transfer_ms, bare.dt_confirm_window_ms, bare.followup_ms) == ("alarm without its frame", 0, None, None, None, None, None)


def test_errors_set_aside_or_stop(logs):
    assert {r["run_id"] for r in run_metrics(logs, ["gun"]).select("run_id").collect()} == set(RUNS) - {"alarm_no_onset", "no_header", "no_frame", "no_emit", "unanswered"}
    with pytest.raises(ValueError, match="no_header"):
        run_metrics(logs.filter("run_id in ('known', 'no_header')"), ["gun"], strict=True)
    assert run_metrics(logs.filter("run_id = 'known'"), ["gun"], strict=True).count() == 1
    assert run_metrics(logs.limit(0), ["gun"]).count() == 0


def test_reading_strictly_and_from_shared_files(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text("\n".join(map(json.dumps, KNOWN)))
    (tmp_path / "bad.jsonl").write_text("\n".join([*map(json.dumps, KNOWN), '{"type": "fra']))
    records, bad = L.read_logs(spark, str(tmp_path))
    assert [r["run_id"] for r in bad.collect()] == ["bad"] and {r["run_id"] for r in records.select("run_id").distinct().collect()} == {"ok"}
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        L.read_logs(spark, str(tmp_path), strict=True)[0].collect()
    shared = tmp_path / "shared"
    rows = [{**r, "run_id": run} for run in ("a", "b", "c") for r in KNOWN]
    df = spark.read.schema(L.LOG_SCHEMA + ", run_id string").json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    L.write_logs(df.drop("_corrupt_record"), str(shared), "run_id", 2)
    L.write_logs(df.drop("_corrupt_record").filter("run_id = 'c'").withColumn("run_id", F.lit("d")), str(shared), "run_id", 1)
    (shared / "more.json").write_text('{"run_id": "b", "type": "fra\n')
    records, bad = L.read_logs(spark, str(shared), run_field="run_id")
    assert [r["run_id"] for r in bad.collect()] == ["b"]
    got = {r["run_id"]: r["ttd_ms"] for r in run_metrics(records, ["gun"]).collect()}
    assert got == {"a": 146, "c": 146, "d": 146}
    assert len(list(shared.glob("part-*"))) <= 3
    (shared / "nameless.json").write_text("{broken\n")
    assert {r["run_id"] for r in L.read_logs(spark, str(shared), run_field="run_id")[1].collect()} == {"b", None}


def test_other_inputs(spark, tmp_path):
    (tmp_path / "sums").mkdir()
    (tmp_path / "sums" / "a.txt").write_text("abc  x/one two.mp4\nnothing\ndef  y.mp4\n")
    assert {tuple(r) for r in L.checksums(spark, str(tmp_path / "sums")).collect()} == {("abc", "x/one two.mp4"), ("def", "y.mp4")}
    (tmp_path / "notes.txt").write_text("v1 Fight 10 20\n  v2  Fight  3 9 30 40 \nv3 Other 1 2\nshort Fight\n\n")
    assert {tuple(r) for r in L.annotations(spark, str(tmp_path / "notes.txt"), "Fight").collect()} == {("v1", 10, 20), ("v2", 3, 9)}
    files = {r["path"].rsplit("/", 1)[1]: (r["length"], r["md5"]) for r in L.manifest(spark, str(tmp_path / "sums")).collect()}
    assert files["a.txt"][0] == 38 and len(files["a.txt"][1]) == 32
    ids = spark.createDataFrame([(10,), (9,), (10,), (100,)], "id int")
    L.write_ids(ids, "id", str(tmp_path / "ids"))
    L.write_ids(ids, "id", str(tmp_path / "ids"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "ids")).collect()] == ["9", "10", "100"]


def test_headers_stamp_every_frame(logs):
    got = {r["run_id"]: (r["n"], r["clip"]) for r in L.with_header(logs, {"clip": "cell.scenario"}).groupBy("run_id", "clip").agg(F.count("*").alias("n")).collect()}
    assert "no_header" not in got and got["known"] == (20, "s") and got["quiet"] == (1, "s")


def test_equal_counts_and_cells(spark):
    from stillwater.functions.expressions import share_cell, usable
    from stillwater.operators.audit import join_equal_counts

    a = spark.createDataFrame([("x", 2, 1.0), ("y", 3, 2.0)], "c string, n int, v double")
    assert {tuple(r) for r in join_equal_counts(a, a, ["c"], "n").collect()} == {("x", 2, 1.0, 1.0), ("y", 3, 2.0, 2.0)}
    for other in (a.limit(1), a.withColumn("n", F.col("n") + 1)):
        with pytest.raises(ValueError):
            join_equal_counts(a, other, ["c"], "n")
    rows = spark.createDataFrame([(True, False, 5), (True, None, 2), (True, True, 5), (None, False, 5), (True, False, 1), (True, False, None)], "v boolean, u boolean, o int")
    assert [r[0] for r in rows.select(usable(F.col("v"), F.col("u"), F.col("o"), 2)).collect()] == [True, True, False, False, False, False]
    assert [r[0] for r in spark.createDataFrame([(3, 8), (0, 0), (1, 1)], "k int, n int").select(share_cell(F.col("k"), F.col("n"))).collect()] == ["3/8 (37.5 %)", "-", "1/1 (100.0 %)"]


def test_excluded_cells(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "c string, n int")
    cells = spark.createDataFrame([("a", 2)], "c string, n int")
    assert {tuple(r) for r in exclude(df, cells, ["c", "n"]).collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(ValueError):
        exclude(df, spark.createDataFrame([("z", 2)], "c string, n int"), ["c", "n"])


# ---- streams


@pytest.mark.parametrize("k, width", [(1, 0), (2, 5), (3, 10), (5, 3)])
def test_rules_on_pieces_equal_the_fold(k, width):
    r = random.Random(k)
    for _ in range(60):
        n = r.randint(0, 40)
        ok, t = [r.random() < 0.6 for _ in range(n)], list(itertools.accumulate(r.randint(0, 4) for _ in range(n)))
        streak, met, episodes, windows = 0, [], [], []
        for q, at in zip(ok, t):
            streak = streak + 1 if q else 0
            met += [at] if q else []
            episodes += [at] if streak == k else []
            windows += [at] if q and len(met) >= k and at - met[-k] <= width else []
        state, got = (0, np.zeros(0, np.int64)), ([], [])
        cuts = sorted(r.sample(range(n + 1), min(n, 3)))
        for a, b in zip([0, *cuts], [*cuts, n]):
            e, w, *state = rule_times(np.array(ok[a:b], bool), np.array(t[a:b], np.int64), k, width, *state)
            got[0].extend(e.tolist())
            got[1].extend(w.tolist())
        assert got == (episodes, windows) and state[0] == streak and state[1].tolist() == met[-k:]


def events(spark, tmp_path, rows, name="in"):
    df = spark.createDataFrame(rows, "run long, at string, seq long, v double").withColumn("at", F.to_timestamp("at"))
    for k, part in enumerate(sorted({r[1][:10] for r in rows})):
        df.filter(F.date_format("at", "yyyy-MM-dd") == part).coalesce(1).write.parquet(str(tmp_path / name / f"{k:03d}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "*"))


def test_runs_end_by_timer_and_leave_the_state(spark, tmp_path):
    rows = [(1, f"2026-01-01 00:00:{s:02d}", s, 9.0) for s in range(4)]  # alarm, then silent
    rows += [(2, "2026-01-01 00:00:01", 1, 9.0), (2, "2026-01-01 00:00:02", 2, 1.0)]  # never an alarm
    rows += [(3, "2026-01-01 23:00:00", 1, 9.0), (3, "2026-01-02 01:00:00", 2, 9.0), (3, "2026-01-02 02:00:00", 3, 9.0)]  # a streak over two batches
    rows += [(4, "2026-01-03 12:00:00", 1, 1.0), (None, "2026-01-03 12:00:00", 1, 9.0)]  # still running at the end
    out = timed_alarms(events(spark, tmp_path, rows), "run", "at", "seq", F.col("v") >= 5, 3, 10**15, "12 hours", "1 hour")
    with timer_store(spark):
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = {(r["key"], r["rule"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, "episode"), (1, "first"), (1, "window"), (2, "miss"), (3, "episode"), (3, "first"), (3, "window")}
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # run 4 alone


def test_finished_runs_add_up_over_batches(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00", 1, 1.0), (2, "2026-01-01 00:00:00", 1, 5.0), (1, "2026-01-02 00:00:00", 2, 9.0), (2, "2026-01-02 00:00:00", 2, 5.0), (1, "2026-01-03 00:00:00", 3, 2.0), (None, "2026-01-03 00:00:00", 3, 9.0)]
    summary = [F.count("*").alias("n"), F.avg("v").alias("mean"), F.max("seq").alias("last")]
    got = finished_runs(events(spark, tmp_path, rows), "run", F.col("v") >= 9, summary, str(tmp_path / "w"))
    assert {tuple(r) for r in got.select("run", "n", "mean", "last").collect()} == {(1, 3, 4.0, 3)}
    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("run long, at timestamp, seq long, v double").parquet(str(tmp_path / "none"))
    got = finished_runs(empty, "run", F.col("v") >= 9, summary, tempfile.mkdtemp(dir=tmp_path))
    assert got.columns == ["run", "n", "mean", "last"] and got.count() == 0


def test_losses_by_span(spark, tmp_path):
    rows = [(1, "2026-01-01 01:00:00", 1, 1.0), (1, "2026-01-01 02:00:00", 2, 9.0), (2, "2026-01-01 03:00:00", 1, 9.0), (1, "2026-01-02 05:00:00", 3, 9.0)]
    out = loss_stream(events(spark, tmp_path, rows), "run", "at", F.col("v") >= 5)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["run"], r["n"], r["n_drops"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 2, 1), (2, 1, 1)}
