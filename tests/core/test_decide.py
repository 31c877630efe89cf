"""Adjusted decisions, annotators, aligned traces and gates on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from stillwater.functions import tails
from stillwater.operators import decide as D


def test_bonferroni(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None)], "k string, p double")
    got = {r["k"]: (r["p_bonferroni"], r["significant"]) for r in D.bonferroni(rows, "p").collect()}
    assert got == {"a": (0.02, True), "b": (0.08, False), "c": (None, None)}
    assert D.bonferroni(rows.filter("false"), "p").count() == 0


@pytest.mark.parametrize("x", [0.1, 1.0, 3.7, 12.5])
def test_tails_with_closed_forms(x):
    assert tails.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert tails.chi2_sf(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)
    assert tails.t_sf2(x, 2) == pytest.approx(1 - x / math.sqrt(2 + x * x), rel=1e-10)
    assert tails.f_sf(x, 2, 10) == pytest.approx((1 + 2 * x / 10) ** -5, rel=1e-10)


def test_serial_client(spark):
    rows = spark.createDataFrame([(20.0, 30.0, 50.0), (None, 40.0, None), (10.0, 20.0, 20.0)], "t double, i double, p double")
    assert [(r["cycle"], r["predicted"]) for r in D.serial_client(rows, "t", "i", "p", F.lit(50.0)).collect()] == [(100.0, 0.5), (40.0, 0.0), (50.0, 0.0)]


def test_annotator_agreement(spark):
    a = spark.createDataFrame([(1, "x", True, 10), (2, "x", True, 20), (3, "x", False, None), (4, "x", True, 5), (9, "x", True, 5)], "id int, g string, u boolean, o int")
    b = spark.createDataFrame([(1, True, 12), (2, True, 14), (3, True, 7), (4, False, None)], "id int, u boolean, o int")
    r = D.annotator_agreement(a, b, "id", "u", "o", ["g"]).first()
    assert (r["n"], r["n_both"], r["same_usable"], r["max_abs"], r["mean_abs"], r["bias"]) == (4, 2, 0.5, 6, 4.0, -2.0)
    assert (r["median_abs"], r["within_3"], r["within_10"]) == (6, 0.5, 1.0)  # the upper one of 2 and 6


def test_annotator_without_common_usable_rows(spark):
    a = spark.createDataFrame([(1, "x", False, 1)], "id int, g string, u boolean, o int")
    r = D.annotator_agreement(a, a.drop("g"), "id", "u", "o", ["g"]).first()
    assert (r["n"], r["n_both"], r["median_abs"], r["mean_abs"]) == (1, 0, None, None)


@pytest.mark.parametrize("shift", [-2, 0, 1])
def test_align_finds_the_shift(spark, shift):
    scores = [3, 9, 4, 1, 8, 2, 7, 7, 0, 5]
    a = spark.createDataFrame([("k", i, float(s)) for i, s in enumerate(scores)], "k string, i int, s double")
    moved = scores[shift:] if shift >= 0 else [6] * -shift + scores
    b = spark.createDataFrame([("k", i, float(s)) for i, s in enumerate(moved)], "k string, i int, s double")
    r = D.align(a, b, ["k"], ["i"], "s", range(-3, 4), 5.0).first()
    assert (r["offset"], r["mae"], r["agree"]) == (shift, 0.0, 1.0)


def test_first_category(spark):
    rows = spark.createDataFrame([("CUDA error: out of memory",), ("timeout, out of memory",), ("fine",), (None,)], "t string")
    got = [r[0] for r in rows.select(D.first_category("t", {"time": "time ?out", "memory": "out of memory"})).collect()]
    assert got == ["memory", "time", "other", "other"]


def test_moved_rows_and_rates(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, None), (3, None)], "k int, v double")
    assert {r["k"]: r["moved"] for r in D.moved_rows(a, b, ["k"], "v").collect()} == {1: False, 2: False, 3: True}
    s = spark.createDataFrame([("h", 0), ("h", 1800), ("h", 3600), ("one", 7)], "g string, t long")
    assert {r["g"]: r["per_hour"] for r in D.start_rates(s, ["g"], F.col("t")).collect()} == {"h": 3.0, "one": None}


def test_homogeneous(spark):
    rows = spark.createDataFrame([("ok", "a", True), ("ok", "a", True), ("open", "a", None), ("mixed", "a", True), ("mixed", None, True)], "g string, hash string, done boolean")
    got = {r["g"]: (r["n_hash"], r["n_open"], r["passed"]) for r in D.homogeneous(rows, ["g"], ["hash"], F.col("done")).collect()}
    assert got == {"ok": (1, 0, True), "open": (1, 1, False), "mixed": (2, 0, False)}


def test_finished_runs_over_several_batches(spark, tmp_path):
    from stillwater.streaming.alarms import finished_runs

    # run 1 ends in the second file and goes on in the third, run 2 never ends, run 3 ends at once
    for i, rows in enumerate([[(1, "frame"), (2, "frame"), (3, "end")], [(1, "end"), (2, "frame")], [(1, "frame")]]):
        spark.createDataFrame(rows, "run int, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    stream = spark.readStream.schema("run int, kind string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = finished_runs(stream, "run", F.col("kind") == "end", [F.count("*").alias("n")], f"{tmp_path}/at")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 3), (3, 1)]


def test_tier_rejects_unknown_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.5)], "m string, d double")
    assert D.tier(rows, "d", 1.0, 2.0, {"m": ["a"]}).count() == 1
    with pytest.raises(ValueError, match="unknown m"):
        D.tier(rows, "d", 1.0, 2.0, {"m": ["a", "c"]})


def test_by_stem(spark):
    a = spark.createDataFrame([("x/clip1.mp4",), ("x/clip10.mp4",)], "a string")
    b = spark.createDataFrame([("x/clip1.csv",)], "b string")
    assert [tuple(r) for r in D.by_stem(a, b, "a", "b").collect()] == [("x/clip1", "x/clip1.mp4", "x/clip1.csv")]


def test_one_sided_pair(spark):
    rows = spark.createDataFrame([(3.0, -2.0, 0.01, 0.06), (-1.0, -2.0, 0.4, 0.06)], "a double, b double, p double, q double")
    got = [r[0] for r in rows.select(D.one_sided_pair_p(F.col("a"), F.col("b"), F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([0.03, 0.8])
