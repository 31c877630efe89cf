"""SQL of tests on more rows than those of the small tables."""

import duckdb
import pytest
from test_oracle import TABLES, plain

from stillwater.functions import tails
from stillwater.plans import registry

SF = "/root/testdata/sf0.1"


def both(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    return sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()), sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("d1", [1, 2, 4, 7])
def test_tails_at_any_size(d1):
    con = duckdb.connect()
    for d2 in (3, 400, 30_000):
        for f in (0.1, 0.363992, 2.5, 300.0):
            got = con.execute(f"select {registry.f_tail('f', 'd1', 'd2')} from (select {f}::double f, {d1}::bigint d1, {d2}::hugeint d2)").fetchone()[0]
            assert got == pytest.approx(tails.f_sf(f, d1, d2), abs=1e-8)
    for x in (0.0, 0.3, 12.0, 1200.0, 50_000.0):
        assert con.execute(f"select {registry.any_chi2_tail('x', 'd')} from (select {x}::double x, {d1}::bigint d)").fetchone()[0] == pytest.approx(tails.chi2_sf(x, d1), abs=1e-8)


def test_p_values(spark):
    mine, theirs = both(spark, "p_values")
    assert mine == theirs


def test_gated_pairs(spark):
    mine, theirs = both(spark, "gated_pairs")
    assert mine == theirs and any("signed-ranks" in r for r in mine)
