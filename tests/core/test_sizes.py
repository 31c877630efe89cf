"""What a task or a replicate costs does not depend on the table's size; results stay those of a plain version."""

from pyspark.sql import functions as F


def test_spread_grows_with_the_table(spark):
    from stillwater.plans.views import spread

    for n in (10, 1000, 4000):
        df = spread(spark.range(n).withColumn("k", F.col("id") % 97), ["k"], 20)
        assert df.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-n // 20))
        at = df.withColumn("p", F.spark_partition_id())
        assert at.count() == n and at.groupBy("k").agg(F.countDistinct("p").alias("p")).filter("p > 1").count() == 0


def test_sources_are_spread(spark):
    from stillwater.plans import points

    a, b = points._sources(spark, "/root/testdata/sf0.1")
    assert "REPARTITION_BY_NUM" in a._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" in b._jdf.queryExecution().toString()


def test_weights_meet_each_clip_once_for_all_levels(spark):
    from stillwater.operators import resample as B

    n = [(g, c, t, (c * t + g) % 4) for g in range(2) for c in range(6) for t in (1, 2, 5) if (c, g) != (4, 1)]
    amounts, weights = [(g, c, float(c + 1)) for g in range(2) for c in range(6)], [(r, c, (r * c) % 3) for r in range(4) for c in range(6) if (r + c) % 4]
    counts = spark.createDataFrame(n, "g int, clip int, level int, n long")
    out = B.replicate_rates(counts, spark.createDataFrame(amounts, "g int, clip int, amount double"), spark.createDataFrame(weights, "rep long, clip int, weight long"), ["g"], "level", "clip")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    want = {(g, t, r): (sum(k * w for h, c, u, k in n for q, d, w in weights if (h, u, q, d) == (g, t, r, c)), sum(x * w for h, c, x in amounts for q, d, w in weights if (h, q, d) == (g, r, c))) for g in range(2) for t in (1, 2, 5) for r in range(4)}
    assert {(x["g"], x["level"], x["rep"]): (x["n"], x["amount"]) for x in out.collect()} == want
    assert B.replicate_rates(counts.limit(0), spark.createDataFrame(amounts, "g int, clip int, amount double"), spark.createDataFrame(weights, "rep long, clip int, weight long"), ["g"], "level", "clip").count() == 0


def test_full_frame_rate_sorts_nothing(spark):
    from stillwater.operators import sequence as S

    df = spark.range(20).withColumn("k", F.col("id") % 3)
    assert S.every_nth(df, ["k"], ["id"], 1)._jdf.queryExecution().optimizedPlan().toString().count("Window") == 0
    assert S.every_nth(df, ["k"], ["id"], 1).count() == 20 and {r["id"] for r in S.every_nth(df, ["k"], ["id"], 3).collect()} == {0, 1, 2, 9, 10, 11, 18, 19}


def test_a_run_asks_the_state_as_little_as_it_can():
    import numpy as np
    import pandas as pd

    from stillwater.streaming.timers import AlarmRules

    class Handle:
        def __init__(self):
            self.value, self.timers, self.calls = None, set(), []

        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            def call(*a):
                self.calls.append(name)
                if name == "get":
                    return self.value
                if name == "update":
                    self.value = a[0]
                if name == "registerTimer":
                    self.timers.add(a[0])
                if name == "deleteTimer":
                    self.timers.remove(a[0])

            return call

    rules, h = AlarmRules(2, 10**9, 5), Handle()
    rules.init(h)
    big = 2**60  # numbers that only whole ones tell apart: in order 1, 2, 3 the second and third qualify
    rows = lambda t, seq, ok: iter([pd.DataFrame({"t": np.array(t, np.int64), "seq": np.array(seq), "ok": ok})])
    out = pd.concat(rules.handleInputRows((7,), rows([10**6] * 3, [big + 3, big + 1, big + 2], [True, False, True]), None))
    assert out["rule"].tolist() == ["episode", "first", "window"] and h.timers == {6} and h.calls == ["get", "update", "registerTimer"]
    h.calls.clear()
    assert list(rules.handleInputRows((7,), rows([9 * 10**6], [1], [False]), None)) == [] and h.timers == {14}
    assert h.calls == ["get", "update", "deleteTimer", "registerTimer"]
    h.calls.clear()
    list(rules.handleInputRows((7,), rows([8 * 10**6], [1], [False]), None))
    assert h.timers == {14} and h.calls == ["get", "update"]


def test_a_log_fills_files_by_its_rows(spark, tmp_path, monkeypatch):
    from stillwater.plans import logs

    monkeypatch.setattr(logs, "partitions", lambda f, rows: 11)
    records, files = logs._written(spark, "/root/testdata/sf0.001", str(tmp_path / "l"))
    assert files == 11 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = list((tmp_path / "l").glob("part-*"))
    assert 4 < len(made) <= 11 and sum(len(x.read_text().splitlines()) for x in made) == records.count()
