"""Window rewrites against plain folds, hand-computed runs, tails against known values."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from stillwater.functions import tails
from stillwater.operators import audit as A
from stillwater.operators import sequence as S
from stillwater.operators import survival as V
from stillwater.operators.runs import confidence_trace, run_metrics
from stillwater.sources.runlogs import headers, read_logs

MS = 1_000_000


def test_streaks_and_episodes_equal_the_fold(spark):
    r = random.Random(1)
    rows = [(k, i, r.random() < 0.6) for k in range(40) for i in range(r.randint(0, 60))] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "k int, i int, q boolean")
    got = {(x.k, x.i): x.streak for x in S.with_streak(df, ["k"], ["i"], F.col("q")).collect()}
    want, n, last = {}, 0, None
    for k, i, q in rows:
        n = (n if k == last else 0) + 1 if q else 0
        want[k, i], last = n, k
    assert got == want
    for need in (1, 2, 4):
        got = {x.k: x.n_episodes for x in S.episodes(df, ["k"], ["i"], F.col("q"), need).collect()}
        assert got == {k: sum(want[a, b] == need for a, b in want if a == k) for k, _ in want}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_all_thresholds_in_one_pass(spark, k):
    r = random.Random(k)
    rows = [(c, i, r.randint(0, 10), i - 15) for c in range(30) for i in range(r.randint(0, 40))]
    df = spark.createDataFrame(rows, "c int, i int, score int, t int").withColumns({"m": F.lit("x"), "onset": F.lit(0)})
    grid = spark.createDataFrame([(t,) for t in range(0, 12)], "threshold int")
    got = {x.threshold: x.n_episodes for x in S.episodes_by_threshold(df, ["m"], ["m", "c"], ["i"], "score", k, grid).collect()}
    fires = {(x.c, x.threshold): (x.hit, x.fp_pre, x.t_fire) for x in S.alarms_by_threshold(df, ["c"], ["i"], "score", "t", "onset", k, grid).collect()}
    for t in range(0, 12):
        n, out = 0, {}
        streak, last = 0, None
        for c, i, s, at in rows:
            streak = (streak if c == last else 0) + 1 if s >= t else 0
            last = c
            n += streak == k
            hit, fp, first = out.get(c, (False, False, None))
            if streak >= k:
                hit, fp, first = (True, fp, at if first is None else first) if at >= 0 else (hit, True, first)
            out[c] = hit, fp, first
        assert got[t] == n
        assert {c: fires[c, t] for c in out} == out


def frame(idx, at, conf, up=0, down=0, remote=False):
    t = {"decode": at + MS, "pre": at + 2 * MS}
    start = at + 3 * MS + up
    rec = {"type": "frame", "frame_idx": idx, "t_capture": at, "t_decode": t["decode"], "t_pre": t["pre"], "t_infer_start": start, "t_infer_end": start + 10 * MS, "t_post": at + 15 * MS + up + down, "detections": [{"cls": "Gun", "conf": conf, "xyxy": [0, 0, 1, 1]}]}
    if remote:
        rec |= {"t_send": t["pre"], "t_recv_server": t["pre"] + up, "t_resp_send": start + 10 * MS, "t_resp_recv": start + 10 * MS + down}
    return rec


def known_run(alarm_at=None, onset=True, drops=0):
    out = [{"type": "header", "schema": 1, "hostname": "h", "wallclock_utc": "2026-01-02T03:04:05+00:00", "t_monotonic_at_header": 0, "cell": {"deployment": "remote", "network_profile": "lan", "model": "m", "scenario": "s", "repetition": 1, "seed": 2}}]
    for i in range(20):
        out += [{"type": "emit", "frame_idx": i, "t": i * 40 * MS}, frame(i, i * 40 * MS + 50 * MS, 0.9 if i >= 10 else 0.1)]
    if onset:
        out.append({"type": "onset_ref", "t": 400 * MS})
    out += [{"type": "drop", "frame_idx": 100 + d, "t": 1} for d in range(drops)]
    out.append({"type": "alarm", "frame_idx": 12, "t": (12 * 40 + 50 + 15 + 1) * MS if alarm_at is None else alarm_at})
    return out


def write(tmp_path, runs):
    for name, recs in runs.items():
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(r if isinstance(r, str) else json.dumps(r) for r in recs) + "\n")
    return str(tmp_path)


def test_known_run(spark, tmp_path):
    runs = {"a": known_run(), "late": known_run(400 * MS + 31_000 * MS), "none": known_run(onset=False)[:-1], "odd": known_run(onset=False), "drops": known_run(drops=20), "bad": [*known_run(), "{not json"]}
    records, bad = read_logs(spark, write(tmp_path, runs))
    assert [x.run_id for x in bad.collect()] == ["bad"]
    got = {x.run_id: x for x in run_metrics(records, ["gun"]).collect()}
    assert set(got) == {"a", "late", "none", "drops"}
    a = got["a"]
    assert (a.hit, a.ttd_ms, a.dt_acq_ms, a.dt_transfer_ms, a.dt_infer_ms, a.dt_post_ms, a.dt_alarm_ms) == (True, 146.0, 50.0, 0.0, 10.0, 2.0, 84.0)
    assert abs(a.ttd_ms - sum((a.dt_acq_ms, a.dt_transfer_ms, a.dt_infer_ms, a.dt_post_ms, a.dt_alarm_ms))) < 1e-9
    assert (a.pf_dt_acq_ms, a.pf_dt_infer_ms, a.pf_dt_post_ms, a.n_frames_processed, a.ttd_meas_ms) == (50.0, 10.0, 2.0, 20, 145.0)
    assert got["late"].miss and got["late"].ttd_ms is None
    assert got["none"].miss and got["none"].pf_dt_acq_ms == 50.0 and got["none"].followup_ms is None
    assert got["drops"].drop_rate == 0.5
    assert confidence_trace(records, ["gun"]).filter("run_id = 'none'").filter("t_rel_onset_ms is not null").count() == 0
    h = headers(records).filter("run_id = 'a'").first()
    assert (h.deployment, h.seed, str(h.started)) == ("remote", 2, "2026-01-02 03:04:05")


def test_tails():
    assert abs(tails.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(tails.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(tails.t_quantile(0.975, 9) - 2.262157162740992) < 1e-8
    assert abs(tails.f_sf(4.964602743730711, 1, 10) - 0.05) < 1e-8
    assert abs(tails.garwood(3)[1] - 8.767273) < 1e-5 and tails.garwood(0)[0] == 0
    assert tails.sign_test(0, 0) == 1 and abs(tails.sign_test(0, 5) - 0.0625) < 1e-12


def test_survival(spark):
    rows = [(1.0, True), (2.0, True), (2.0, False), (3.0, True), (4.0, False), (-1.0, True), (None, True)]
    km = V.kaplan_meier(spark.createDataFrame(rows, "t double, e boolean").withColumn("g", F.lit("x")), ["g"], "t", "e")
    assert [round(x.s, 6) for x in km.orderBy("time").collect()] == [0.8, 0.6, 0.3, 0.3]
    assert V.quantile(km, ["g"], 0.5, "m").first().m == 3.0
    assert abs(V.rmst(km, ["g"], 3.5).first().rmst - (1 + 0.8 + 0.6 + 0.3 * 0.5)) < 1e-9


def test_cox_maximises_the_partial_likelihood(spark):
    r = random.Random(2)
    rows = [(x := r.randint(0, 1), r.expovariate(0.5 if x else 1.0), r.random() < 0.8, i % 6) for i in range(120)]
    out = V.cox(spark.createDataFrame(rows, "x int, t double, e boolean, c int"), ["x"], "t", "e", cluster="c")[0]

    def loglik(b):
        return sum(b * x - math.log(sum(math.exp(b * y) for y, s, *_ in rows if s >= t)) for x, t, e, _ in rows if e)

    assert out["converged"] and loglik(out["coef"]) >= max(loglik(out["coef"] - 1e-3), loglik(out["coef"] + 1e-3)) and out["se"] > 0


def test_cox_adds_up_in_spark(spark, monkeypatch):
    import numpy as np

    r = random.Random(3)
    rows = [(a := r.randint(0, 1), 0 if a else r.randint(0, 1), r.randint(1, 25) / 4, r.random() < 0.7, i % 7, "s" if i % 3 else "t") for i in range(300)]
    df = spark.createDataFrame(rows, "x int, y int, t double, e boolean, c int, g string")
    sizes, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "toPandas", lambda d: pytest.fail("rows on the driver"))
    monkeypatch.setattr(type(df), "collect", lambda d: sizes.append(out := collect(d)) or out)
    got = V.cox(df, ["x", "y"], "t", "e", cluster="c", strata=["g"])
    assert max(map(len, sizes)) < 20 and all(o["converged"] for o in got)

    # the score and its residuals row by row, Efron's ties
    x, t, e = np.array([q[:2] for q in rows], float), np.array([q[2] for q in rows]), np.array([q[3] for q in rows])
    g, c = np.array([q[5] for q in rows]), np.array([q[4] for q in rows])
    rate = np.exp(x @ np.array([o["coef"] for o in got]))
    u, hess = np.zeros((len(rows), 2)), np.zeros((2, 2))
    for s in "st":
        for at in np.unique(t[(g == s) & e]):
            risk, tied = (g == s) & (t >= at), (g == s) & (t == at) & e
            for j in range(tied.sum()):
                w = np.where(tied, 1 - j / tied.sum(), 1.0) * rate * risk
                mean = w @ x / w.sum()
                hess += (x.T * w) @ x / w.sum() - np.outer(mean, mean)
                u -= (w / w.sum())[:, None] * (x - mean)
                u[tied] += (x[tied] - mean) / tied.sum()
    assert np.abs(u.sum(0)).max() < 1e-6
    sums = np.array([u[c == k].sum(0) for k in range(7)])
    se = np.sqrt(np.diag(np.linalg.inv(hess) @ sums.T @ sums @ np.linalg.inv(hess)))
    assert np.allclose([o["se"] for o in got], se, rtol=1e-6)


def test_reconcile_and_exclude(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.05), (2, None), (4, 1.0)], "k int, v double")
    got = {x.k: x.status for x in A.reconcile(a, b, ["k"], ["v"], 0.1).collect()}
    assert got == {1: "ok", 2: "ok", 3: "missing", 4: "extra"}
    with pytest.raises(ValueError):
        A.exclude(a, spark.createDataFrame([(9,)], "k int"), ["k"])
    assert A.exclude(a, spark.createDataFrame([(3,)], "k int"), ["k"]).count() == 2


def test_evenly_spaced(spark):
    df = spark.range(10).withColumn("g", F.lit(1))
    assert sorted(x.id for x in S.evenly_spaced(df, ["g"], ["id"], 4).collect()) == [0, 3, 6, 9]
    assert S.evenly_spaced(df, ["g"], ["id"], 1).count() == 1 and S.evenly_spaced(df, ["g"], ["id"], 50).count() == 10


def test_first_of_equal_content_with_ties_and_nulls(spark):
    from stillwater.operators import sequence as Q

    rows = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), (None, 5), (None, 4), ("b", None)], "h string, i int")
    out = Q.keep_first(rows, ["h"], ["i"]).collect()
    assert len(out) == 6
    assert sorted((str(r["h"]), str(r["i"]), r["n_alike"]) for r in out if r["kept"]) == [("None", "4", 2), ("a", "1", 3), ("b", "None", 1)]


def test_average_ranks_with_nulls(spark):
    from stillwater.operators import sequence as Q

    rows = spark.createDataFrame([("g", 3.0), ("g", 1.0), ("g", 3.0), (None, 7.0), (None, None)], "g string, v double")
    out = Q.average_ranks(rows, ["g"], "v", "r").collect()
    assert sorted((str(r["g"]), str(r["v"]), r["r"]) for r in out) == [("None", "7.0", 2.0), ("None", "None", 1.0), ("g", "1.0", 1.0), ("g", "3.0", 2.5), ("g", "3.0", 2.5)]


def test_stride_slice_numbers_across_partitions(spark):
    from stillwater.operators import sequence as Q

    rows = spark.range(1000).selectExpr("nullif(id % 2, 1) as g", "id as i").repartition(7)
    got = sorted(r["i"] for r in Q.stride_slice(rows, ["i"], 3, 11, ["g"]).collect())
    assert got == sorted(i for g in (0, 1) for i in list(range(g, 1000, 2))[3::11])


def test_streak_with_null_condition(spark):
    from pyspark.sql import functions as F

    from stillwater.operators import sequence as Q

    rows = spark.createDataFrame([(1, 5), (2, 6), (3, None), (4, 7), (5, 1), (6, 9)], "t int, v int")
    out = Q.with_streak(rows.withColumn("k", F.lit(1)), ["k"], ["t"], F.col("v") >= 5).orderBy("t").collect()
    assert [r["streak"] for r in out] == [1, 2, 0, 1, 0, 1]
