"""Every registered time-series query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidemill.operators import forecast, leaderboard, missing
from tidemill.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, (int, float)) else str(v)
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def long(spark, values):
    return spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "series string, pos int, y double")


def test_imputers_by_hand(spark):
    gaps = long(spark, [None, 1.0, None, None, 4.0, None])
    fill = lambda method, **kw: [r.y_hat for r in missing.impute(gaps, method, **kw).orderBy("pos").collect()]
    assert fill("linear") == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert fill("locf") == [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert fill("mean") == [2.5, 1.0, 2.5, 2.5, 4.0, 2.5]
    assert fill("seasonal", season=3) == [1.0, 1.0, 1.0, 1.0, 4.0, 4.0]
    assert [r.y_hat for r in missing.impute(long(spark, [None, None]), "linear").collect()] == [0.0, 0.0]
    with pytest.raises(ValueError):
        missing.impute(gaps, "other")


def test_seasonal_error_closes_gaps(spark):
    assert forecast.seasonal_error(long(spark, [1.0, None, 4.0, 6.0]), 2).first().scale == 5.0
    assert forecast.seasonal_error(long(spark, [1.0, 1.0, 1.0]), 1).first().scale is None


def test_naive_interval(spark):
    got = {(r.step, r.q): r.y_hat for r in forecast.naive_quantiles(long(spark, [0.0, 2.0, 0.0, 2.0]), 4).collect()}
    assert got[4, 0.5] == 2.0 and math.isclose(got[4, 0.9], 2 + 1.2815515655446004 * 2 * 2)


def test_leaderboard_rules(spark):
    scores = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("c", "x", None), ("a", "y", 0.0), ("b", "y", 2.0), ("a", "z", 3.0)], "model string, dataset string, score double")
    rank = {(r.model, r.dataset): r["rank"] for r in leaderboard.rank_models(scores).collect()}
    assert rank == {("a", "x"): 1, ("b", "x"): 2, ("c", "x"): None, ("a", "y"): 1, ("b", "y"): 2, ("a", "z"): 1}
    board = {r.model: (r.gmean_ratio, r.avg_rank) for r in leaderboard.leaderboard(scores, "b").collect()}
    assert board["a"] == (0.0, 1.0) and board["b"] == (1.0, 2.0) and board["c"] == (None, None)


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.queries()) >= len(QUERIES) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
