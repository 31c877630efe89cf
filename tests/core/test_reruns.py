from pyspark.sql import functions as F

from stillwater.operators import reruns as R
from stillwater.streaming.alarms import timeout_misses


def test_switched_takes_one_source_a_group(spark):
    one = spark.createDataFrame([("m", 1, 10), ("m", 2, 20), ("k", 1, 30)], "model string, config int, score int")
    two = spark.createDataFrame([("m", 1, 11), ("m", 2, 21)], "model string, config int, score int")
    chosen = spark.createDataFrame([("m", 1, "one"), ("m", 2, "two")], "model string, config int, variant string")
    got = R.switched({"one": one, "two": two}, chosen, ["model", "config"])
    assert sorted(r.score for r in got.collect()) == [10, 21]
    assert R.switched({"one": one.limit(0)}, chosen, ["model", "config"]).isEmpty()


def test_traces_of_excluded_runs_go(spark):
    traces = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "run string, t int")
    runs = spark.createDataFrame([("a", 7, 0), ("c", 8, 0)], "run string, fire int, extra int")
    assert sorted(map(tuple, R.traces_of_runs(traces, runs, "run", "fire").collect())) == [("a", 1, 7), ("a", 2, 7)]


def test_beside_skips_runs_without_frames(spark):
    schema = "run string, n int, hit boolean"
    frozen = spark.createDataFrame([("a", 3, True), ("b", 0, False), ("c", 2, False), ("d", 1, True)], schema)
    rerun = spark.createDataFrame([("a", 3, False), ("b", 4, True), ("c", 0, True)], schema)
    assert [tuple(r) for r in R.beside(frozen, rerun, "run", "n", ["hit"]).collect()] == [("a", 3, True, False)]


def test_own_only(spark):
    rows = [([5], 5), ([5, 6], 5), ([], 5), (None, 5), ([None, 5], 5), ([None, 6], 5), ([5], None)]
    got = spark.createDataFrame(rows, "seen array<int>, own int").select(R.own_only(F.col("seen"), F.col("own"))).collect()
    assert [r[0] for r in got] == [True, False, True, None, None, False, None]


def test_robust_needs_every_shift(spark):
    rows = [(1, 0, 1, True), (1, 5, 1, True), (1, -5, 1, True), (2, 0, 1, True), (2, 5, -1, True), (2, -5, 1, True), (3, 0, 1, None), (3, 5, 1, None), (4, 5, 1, True)]
    got = R.robust(spark.createDataFrame(rows, "g int, shift int, side int, sig boolean"), ["g"], "shift", F.lit(0), "side", "sig")
    assert sorted(map(tuple, got.collect())) == [(1, 2, True), (2, 2, False), (3, 1, True)]


def test_timeout_misses_on_a_table(spark):
    at = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    onsets = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, 100), (None, 100), (5, None)], "run long, t long").select("run", at("t"))
    # at the onset, at the end, before the onset, after the end
    alarms = spark.createDataFrame([(1, 100), (2, 160), (3, 99), (4, 161), (1, 130), (3, None)], "run long, u long").select("run", at("u"))
    got = timeout_misses(onsets, alarms, "run", "t", "u", "60 seconds")
    rows = got.select("run", F.unix_seconds("onset"), F.unix_seconds("t_miss")).collect()
    assert sorted(map(tuple, rows)) == [(3, 100, 160), (4, 100, 160)]
    assert timeout_misses(onsets.limit(0), alarms, "run", "t", "u", "60 seconds").isEmpty()
