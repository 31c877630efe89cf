"""Sources and sinks on small inputs of their own."""

import pytest
from stillwater.operators import points as P
from stillwater.sources import tables as T


def test_csv_keeps_order_nulls_and_types(spark, tmp_path):
    df = spark.createDataFrame([(2, "b, c", None), (1, None, 0.5)], "k long, s string, v double")
    T.write_csv(df, str(tmp_path / "c"), ["k"])
    assert sorted(map(tuple, T.read_csv(spark, str(tmp_path / "c"), "k long, s string, v double").collect())) == [(1, None, 0.5), (2, "b, c", None)]


def test_registry_refuses_repeated_and_missing_keys(spark, tmp_path):
    for i, lines in enumerate((['{"k": "a"}', '{"k": "a"}'], ['{"k": "a"}', '{"x": 1}'])):
        at = str(tmp_path / f"r{i}")
        spark.createDataFrame([(x,) for x in lines], "value string").write.text(at)
        with pytest.raises(Exception, match="repeated or missing k"):
            T.registry(spark, at, "k string", "k").collect()


def test_report_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([("b", "x: y"), ("a", "1")], "k string, v string")
    T.write_report(df, str(tmp_path / "p"), "k", "v")
    assert [tuple(r) for r in T.read_report(spark, str(tmp_path / "p")).collect()] == [("a", "1"), ("b", "x: y")]
    T.write_partitioned(df, str(tmp_path / "t"), ["k"])
    assert (tmp_path / "t" / "k=a").is_dir() and spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_points(spark):
    rows = spark.createDataFrame([("m", s) for s in (1, 2, 3, 4)] + [("n", None), ("n", 9)], "model string, score int")
    got = {(r["model"], r["point"]): r["threshold"] for r in P.share_thresholds(rows, ["model"], "score", [1, 2, 3, 4, 5], {"op25": 0.25, "op50": 0.5, "op0": 0.0}).collect()}
    assert got == {("m", "op25"): 4, ("m", "op50"): 3, ("m", "op0"): 5, ("n", "op50"): 1}
    points = spark.createDataFrame([("m", "op1"), ("n", "op1"), ("m", "op2")], "model string, point string")
    assert {(r["model"], r["point"]) for r in P.complete(points, "model", 2).collect()} == {("m", "op1"), ("n", "op1")}
