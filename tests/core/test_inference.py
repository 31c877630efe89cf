"""Hazards, gates, exact tests, bootstraps and copies against plain versions and published values."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stillwater.functions import normality as N
from stillwater.operators import audit as A
from stillwater.operators import compare as T
from stillwater.operators import decide as D
from stillwater.operators import resample as B
from stillwater.operators import survival as V

# ---- hazards


def sample(n=160, seed=3):
    r = random.Random(seed)
    return [(r.randrange(3), r.randrange(2), r.randrange(6), r.choice([1.0, 2.0, 3.0, 4.0, 5.5, 7.0, r.randint(1, 40) / 2]), r.random() < 0.7) for _ in range(n)]


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "config int, model int, scenario int, time double, hit boolean").repartition(3)
    df, a = V.dummies(df, "config", 0)
    df, b = V.dummies(df, "model", 0)
    return df, [*a, *b]


def plain_fit(rows, strata):
    """Newton on Efron's likelihood, row by row; gives beta, covariance, and (stratum, time, row's residual) of every event."""
    x = np.array([[c == 1, c == 2, m == 1] for c, m, *_ in rows], float)
    t, e = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    s = np.array([r[2] if strata else 0 for r in rows])

    def terms(beta):
        for g in set(s.tolist()):
            for u in sorted(set(t[(s == g) & e].tolist())):
                risk, dead = (s == g) & (t >= u), (s == g) & (t == u) & e
                w, d = np.exp(x @ beta), int(dead.sum())
                means, seconds = [], []
                for i in range(d):
                    v = w * risk - i / d * w * dead
                    means.append(v @ x / v.sum())
                    seconds.append((x.T * v) @ x / v.sum())
                yield u, dead, means, seconds

    beta = np.zeros(3)
    for _ in range(30):
        grad, hess = np.zeros(3), np.zeros((3, 3))
        for _, dead, means, seconds in terms(beta):
            grad += x[dead].sum(0) - sum(means)
            hess += sum(q - np.outer(m, m) for m, q in zip(means, seconds))
        beta = beta + np.linalg.solve(hess, grad)
    residuals = [(u, r - np.mean(means, 0)) for u, dead, means, _ in terms(beta) for r in x[dead]]
    return beta, np.linalg.inv(hess), residuals


@pytest.mark.parametrize("strata", [None, ["scenario"]])
def test_fit_and_proportionality(spark, strata):
    rows = sample()
    df, names = rows_of(spark, rows)
    assert names == ["config_1", "config_2", "model_1"]
    fit = V.fit_cox(df, names, "time", "hit", strata=strata)
    beta, cov, residuals = plain_fit(rows, strata)
    assert fit.converged and np.allclose(fit.beta, beta, atol=1e-6) and np.allclose(fit.cov, cov, atol=1e-6)
    for row, b, v in zip(fit.rows(), beta, np.sqrt(np.diag(cov))):
        assert row["hr_lo"] == pytest.approx(math.exp(b - 1.959963984540054 * v)) and row["hr_hi"] == pytest.approx(math.exp(b + 1.959963984540054 * v))
        assert row["p"] == pytest.approx(math.erfc(abs(b / v) / math.sqrt(2))) and row["separated"] is False
    times = sorted(u for u, _ in residuals)
    rank = {u: np.mean([i + 1 for i, v in enumerate(times) if v == u]) for u in times}
    got = V.schoenfeld(fit).collect()
    mine = Counter((r["time"], r["rank"], *(round(r[f"r_{c}"], 6) + 0.0 for c in names)) for r in got for _ in range(r["n"]))
    assert mine == Counter((u, rank[u], *(round(float(v), 6) + 0.0 for v in r)) for u, r in residuals)
    # the statistic, event by event
    g = np.array([rank[u] for u, _ in residuals]) - np.mean([rank[u] for u, _ in residuals])
    scaled = len(residuals) * np.array([r for _, r in residuals]) @ cov
    chi2 = (g @ scaled) ** 2 / (len(residuals) * np.diag(cov) * (g @ g))
    found = {r["covariate"]: r for r in V.ph_test(fit).collect()}
    assert np.allclose([found[c]["chi2"] for c in names], chi2, atol=1e-6)
    p = [math.erfc(math.sqrt(v / 2)) for v in chi2]
    assert np.allclose([found[c]["p"] for c in names], p, atol=1e-9)
    order, most = np.argsort(p), 0.0
    for i, j in enumerate(order):
        most = max(most, min(1.0, (3 - i) * p[j]))
        assert found[names[j]]["p_holm"] == pytest.approx(most)


def test_separation_and_no_events(spark):
    rows = [(0, k % 2, k, float(k % 7 + 1), True) for k in range(40)] + [(1, k % 2, k, 9.0, False) for k in range(40)]
    df, names = rows_of(spark, rows)
    out = {r["covariate"]: r for r in V.cox(df, names, "time", "hit", max_steps=60)}
    assert not out["config_1"]["converged"] or out["config_1"]["separated"]
    fit = V.fit_cox(df.filter("not hit"), ["config_1"], "time", "hit")
    assert not fit.converged and V.ph_test(fit).collect()[0]["p"] is None
    assert V.fit_cox(df.limit(0), ["config_1"], "time", "hit") is None and V.cox(df.limit(0), ["config_1"], "time", "hit") == []


# ---- gates and exact tests

#: Published examples: values, W, p.
WEIGHTS = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.788815, 0.006704
SLEEP = [1.2, 2.4, 1.3, 1.3, 0.0, 1.0, 1.8, 0.8, 4.6, 1.4], 0.829871, 0.033342
MILES = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4], 0.947565, 0.122881


def test_normality(spark):
    groups = {"weights": WEIGHTS[0], "sleep": SLEEP[0], "miles": MILES[0], "three": [1, 2, 4], "two": [1, 2], "equal": [3.0] * 9, "large": [float(i % 977) for i in range(6000)]}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("sleep", None)], "g string, v double")
    got = {r["g"]: r for r in T.normality(df, ["g"], "v").collect()}
    for g, (_, w, p) in (("weights", WEIGHTS), ("sleep", SLEEP), ("miles", MILES), ("three", (0, 0.964286, 0.636887))):
        assert got[g]["w"] == pytest.approx(w, abs=1e-6) and got[g]["p"] == pytest.approx(p, abs=1e-6), g
    assert got["equal"]["p"] == 0.0 and got["equal"]["w"] is None
    assert got["two"]["p"] is None and got["large"]["p"] is None


def test_signed_ranks_exactly():
    for n in range(1, 9):
        sums = Counter(sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n))
        for w in range(n * (n + 1) // 4 + 1):
            assert N.signed_rank_p(n, w) == pytest.approx(min(1.0, 2 * sum(v for k, v in sums.items() if k <= w) / 2**n))
    assert N.signed_rank_p(10, 8) == pytest.approx(0.048828125)  # the five percent point of the tables
    assert N.signed_rank_p(0, 0) == 1.0


def test_gated_tests(spark):
    r = random.Random(1)
    rows = []
    for s in range(12):
        base = 200 + r.gauss(0, 10)
        rows += [("a", s, base), ("b", s, base + 50 + r.gauss(0, 5)), ("same", s, base), ("odd", s, base + (400.0 if s == 3 else r.uniform(0, 3)))]
    rows += [("few", 0, 1.0), ("few", 1, 2.0), ("few", 2, None), (None, 1, 5.0)]
    df = spark.createDataFrame(rows, "config string, scenario int, ttd double")
    got = {(x["a"], x["b"]): x for x in T.gated_tests(df, "config", ["scenario"], "ttd").collect()}
    assert len(got) == 10  # five labels
    shift = got["a", "b"]
    assert shift["test"] == "paired-t" and shift["significant"] and shift["mean_diff"] == pytest.approx(-50, abs=6) and shift["effect"] < 0
    assert shift["p_bonferroni"] == pytest.approx(min(1.0, 10 * shift["p"]))
    same = got["a", "same"]
    assert (same["test"], same["p"], same["effect"], same["statistic"], same["significant"]) == ("signed-ranks", 1.0, 0.0, None, False)
    assert got["a", "odd"]["test"] == "signed-ranks" and got["a", "odd"]["p"] == pytest.approx(2 / 2**12)
    few = got["a", "few"]
    assert few["test"] == "insufficient" and few["n_pairs"] == 2 and few["p"] is None and few["significant"] is False and few["mean_diff"] is None


def test_corrected_chi_square(spark):
    rows = [(f, o) for f, o, n in (("x", 0, 12), ("x", 1, 7), ("y", 0, 5), ("y", 1, 7)) for _ in range(n)]
    df = spark.createDataFrame(rows, "f string, o int")
    assert T.chi_square(df, "f", "o", yates=True).first()["chi2"] == pytest.approx(0.6411, abs=1e-4)
    alone = T.chi_square(df.filter("f = 'x'"), "f", "o").first()
    assert alone["dof"] == 0 and alone["chi2"] is None


def test_cell_half_widths(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, 5.0), ("b", 2.0, 1.0), ("b", 2.0, -1.0)], "c string, x double, y double")
    got = {(r["c"], r["metric"]): r for r in T.cell_half_widths(df, ["c"], ["x", "y"]).collect()}
    assert set(got) == {("a", "x"), ("b", "x"), ("b", "y")}
    assert got["a", "x"]["half_width"] == pytest.approx(12.706204736, rel=1e-6) and got["a", "x"]["half_width_pct"] == pytest.approx(635.3102368, rel=1e-6)
    assert got["b", "x"]["half_width"] == 0 and got["b", "y"]["half_width_pct"] is None


# ---- bootstraps


def test_draws_are_with_replacement_and_shared(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(37)] * 2, "clip string")
    got = B.resample(keys, "clip", 50).collect()
    total = Counter()
    for r in got:
        assert r["weight"] > 0
        total[r["rep"]] += r["weight"]
    assert total == {i: 37 for i in range(50)}
    assert Counter(map(tuple, got)) == Counter(map(tuple, B.resample(keys.repartition(7), "clip", 50).collect()))
    share = sum(1 for _ in got) / (50 * 37)
    assert 0.58 < share < 0.68  # of the keys, 1 - 1/e are drawn
    assert B.resample(keys.limit(0), "clip", 5).count() == 0


def test_matched_thresholds(spark):
    pairs = [(c, t, max(0, 10 - t - c % 2), max(0, 12 - 2 * t)) for c in range(8) for t in range(1, 9)]
    p = spark.createDataFrame([("m", *r) for r in pairs], "model string, clip int, threshold int, na int, nb int")
    w = B.resample(p, "clip", 20)
    points = spark.createDataFrame([("m", 1.0, 3), ("m", 2.0, 8)], "model string, target double, threshold int")
    got = {(r["target"], r["rep"]): r["matched"] for r in B.matched_thresholds(p, w, points, ["model"], "threshold", "clip").collect()}
    weight = defaultdict(dict)
    for r in w.collect():
        weight[r["rep"]][r["clip"]] = r["weight"]
    assert len(got) == 40
    for (target, rep), m in got.items():
        at = 3 if target == 1.0 else 8
        na = sum(a * weight[rep].get(c, 0) for c, t, a, _ in pairs if t == at)
        ok = [t for t in range(1, 9) if sum(b * weight[rep].get(c, 0) for c, u, _, b in pairs if u == t) <= na]
        assert m == (min(ok) if ok else None)


def test_widths(spark):
    f = lambda rows: spark.createDataFrame(rows, "t int, far_h double, lo double, hi double")
    a, b = f([(1, 10.0, 8.0, 12.0), (2, 40.0, 30.0, 50.0), (3, 0.0, 0.0, 1.0)]), f([(1, 9.0, 6.3, 11.7), (2, 38.0, 30.4, 45.6), (3, 1.0, 0.0, 1.0)])
    got = {r["subset"]: r for r in B.width_comparison(a, b, ["t"]).collect()}
    assert got["all"]["n"] == 2 and got["all"]["width_a"] == pytest.approx(0.45) and got["all"]["width_b"] == pytest.approx(0.5) and got["all"]["wider_pct"] == 50
    assert got["low"]["n"] == 1 and got["low"]["change_pct"] == pytest.approx(50)


def test_restricted_means(spark):
    rows = [("a", 1, 1.0, True), ("a", 2, 3.0, True), ("a", 3, 4.0, False), ("b", 1, 9.0, False), ("b", 2, None, True)]
    df = spark.createDataFrame(rows, "g string, s int, t double, hit boolean")
    km = V.kaplan_meier(df, ["g"], "t", "hit")
    steps = {(r["g"], r["time"]): (r["n"], round(r["s_before"], 9), round(r["s"], 9)) for r in km.collect()}
    assert steps == {("a", 1.0): (3, 1.0, round(2 / 3, 9)), ("a", 3.0): (2, round(2 / 3, 9), round(1 / 3, 9)), ("a", 4.0): (1, round(1 / 3, 9), round(1 / 3, 9)), ("b", 9.0): (1, 1.0, 1.0)}
    got = {r["g"]: r["rmst"] for r in V.rmst(km, ["g"], 5.0).collect()}
    assert got == {"a": pytest.approx(1 + 2 * 2 / 3 + 2 / 3), "b": pytest.approx(5.0)}
    lim = {r["g"]: r for r in B.rmst_limits(df, ["g"], "t", "hit", "s", 5.0, 200).collect()}
    assert lim["a"]["lo"] <= lim["a"]["rmst"] <= lim["a"]["hi"] and lim["a"]["n"] == 3 and lim["b"]["lo"] == lim["b"]["hi"] == 5.0


def test_everyone_dies(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 2.0, True)], "g string, t double, hit boolean")
    got = {r["time"]: (r["s_before"], r["s"]) for r in V.kaplan_meier(df, ["g"], "t", "hit").collect()}
    assert got[2.0] == (pytest.approx(0.5), 0.0)


# ---- copies and prefixes


def test_copies(spark):
    manifest = spark.createDataFrame([("h1", "a"), ("h1", "b"), ("h2", "c"), ("h2", "d"), ("h3", "e"), ("h4", "f"), ("h4", "g"), ("h4", "h"), (None, "x"), (None, "y"), ("h5", "i"), ("h5", "j")], "md5 string, clip string")
    pairs = A.copy_pairs(manifest, ["md5"], "clip")
    assert {tuple(r) for r in pairs.collect()} == {("a", "b"), ("c", "d"), ("i", "j")}
    traces = [("m", c, i, v) for c, vs in {"a": [0.1, 0.9, None], "b": [0.1, 0.9, None], "c": [0.1, 0.2], "d": [0.1, 0.7], "i": [0.5], "j": [0.5, 0.5], "f": [1.0]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(traces, "model string, clip string, k int, s double")
    got = {(r["a"], r["b"]): (r["identical"], r["worst"], r["n_a"], r["n_b"]) for r in A.trace_identity(df, pairs, "clip", ["model"], ["k"], "s").collect()}
    assert got == {("a", "b"): (True, 0.0, 3, 3), ("c", "d"): (False, pytest.approx(0.5), 2, 2), ("i", "j"): (False, 0.0, 1, 2)}
    decisions = spark.createDataFrame([("a", 1, 2), ("b", 1, 2), ("c", 1, 0), ("d", 1, 1)], "clip string, t int, n int")
    assert {(r["a"], r["disagree"]) for r in A.copy_disagreement(decisions, pairs, "clip", ["t"], "n").collect()} == {("a", False), ("c", True)}


def test_prefixes(spark):
    names = spark.createDataFrame([("clip1_part2.mp4",), ("clip1.mp4",), ("clip2",), ("cl",), (None,)], "name string")
    stems = spark.createDataFrame([("clip1",), ("clip1_part2",), ("clip",), ("",), (None,), ("zzz",)], "stem string")
    got = {tuple(r) for r in D.by_prefix(names, stems, "name", "stem").select("name", "stem").collect()}
    assert got == {(n, s) for n in ("clip1_part2.mp4", "clip1.mp4", "clip2") for s in ("clip1", "clip1_part2", "clip") if n.startswith(s)}
    assert D.by_prefix(names, stems.limit(0), "name", "stem").count() == 0


def test_step_down_leaves_out_null_p_values(spark):
    from stillwater.operators.sequence import holm

    df = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.04), ("d", 0.02)], "t string, p double").withColumn("g", F.lit(1))
    got = {r["t"]: (r["p_holm"], r["p_bonferroni"]) for r in holm(df, ["g"], "p", ["t"]).collect()}
    assert got == {"a": (pytest.approx(0.03), pytest.approx(0.03)), "d": (pytest.approx(0.04), pytest.approx(0.06)), "c": (pytest.approx(0.04), pytest.approx(0.12)), "b": (None, None)}


def test_quantiles_over_range_partitions(spark):
    r = random.Random(8)
    rows = [(g, r.choice([None, r.randint(0, 20), r.random()])) for g in ["a", "b", None] for _ in range(r.randint(1, 90))] + [("none", None), ("one", 4)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(5)
    got = {x["g"]: (x["m"], x["p"], x["top"]) for x in T.exact_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.9, "top": 1.0}).collect()}
    values = defaultdict(list)
    for g, v in rows:
        if v is not None:
            values[g].append(float(v))
    assert set(got) == set(values)
    for g, v in values.items():
        assert got[g] == pytest.approx(tuple(np.percentile(v, [50, 90, 100])))
    beside = {x["g"]: (x["n"], x["m"]) for x in T.with_quantiles(df, ["g"], [F.count("*").alias("n")], "v", {"m": 0.5}).collect()}
    assert beside["none"] == (1, None) and beside["one"] == (1, 4.0) and beside[None][0] == sum(g is None for g, _ in rows)


def test_categories_and_failures(spark, tmp_path):
    from stillwater.sources.runlogs import text_lines

    (tmp_path / "run1.log").write_text("start\nWARN disk\nout of memory at 5\n")
    (tmp_path / "run2.log").write_text("WARN slow\n")
    (tmp_path / "run3").write_text("fine\n")
    lines = text_lines(spark, str(tmp_path))
    got = {tuple(x) for x in D.first_line_category(lines, ["run_id"], "line", {"oom": "out of memory", "warned": "^WARN"}).collect()}
    assert got == {("run1", 3, "oom"), ("run2", 1, "warned"), ("run3", 1, "other")}
    assert {x["run_id"] for x in text_lines(spark, str(tmp_path), "at ([0-9])").collect()} == {"5"}
    runs = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "k int")
    records = spark.createDataFrame([(1, True), (1, False), (2, False), (4, None), (9, True)], "k int, bad boolean")
    assert {tuple(x) for x in D.failed_runs(runs, records, ["k"], F.col("bad")).collect()} == {(1, 2, True), (2, 1, False), (3, 0, True), (4, 1, False)}
