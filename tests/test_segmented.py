import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import forecast, missing, scaling, segmented, shape


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(11)
    rows = []
    for series, n, share in [("a", 200, 0.4), ("b", 37, 0.95), ("c", 64, 0.0), ("d", 1, 0.0), ("e", 30, 1.0), (None, 25, 0.5), ("f", 90, 0.9)]:
        rows += [(series, k, None if rng.random() < share else round(rng.gauss(1e6, 3), 3), f"x{k}") for k in range(n)]
    return spark.createDataFrame(rows, "series string, pos int, y double, extra string").cache()


def same(got, want, *keys, digits=6):
    plain = lambda df: sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(want.columns)).collect()), key=str)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("block", [1, 16])
def test_fills_equal_those_over_whole_series(spark, long, block):
    for method in ("locf", "linear", "mean", "zero"):
        same(segmented.impute(long, method, block=block), missing.impute(long, method))
    for season in (1, 24):
        same(segmented.impute(long, "seasonal", season, block=block), missing.impute(long, "seasonal", season))
    same(segmented.gap_islands(long, block), missing.gap_islands(long))


@pytest.mark.parametrize("block", [11])
def test_grid_scale_and_errors(spark, long, block):
    same(segmented.time_grid(long, block), shape.time_grid(long))
    same(segmented.last_context(long, 20, block), shape.last_context(long, 20))
    same(segmented.standard_scale(long, block=block), scaling.standard_scale(long))
    same(segmented.minmax_scale(long, block=block), scaling.minmax_scale(long))
    for season in (4, 60):
        same(segmented.seasonal_error(long, season, block), forecast.seasonal_error(long, season), digits=4)
    got = {(r.series, r.pos): r.s for r in segmented.running(long, F.col("y"), "s", block).collect()}
    total = {}
    for r in sorted(long.collect(), key=lambda r: (str(r.series), r.pos)):
        total[r.series] = total.get(r.series, 0.0) + (r.y or 0.0)
        assert got[r.series, r.pos] == pytest.approx(total[r.series])


def test_edges(spark, long):
    none = long.limit(0)
    for method in ("locf", "linear", "mean", "zero"):
        assert segmented.impute(none, method).collect() == []
    with pytest.raises(ValueError):
        segmented.impute(long, "other")
    with pytest.raises(ValueError):
        segmented.impute(long, "seasonal")
    with pytest.raises(ValueError):
        segmented.impute(long, "linear", block=0)


def test_one_long_series_is_spread_over_tasks(spark):
    n = 400_000
    rows = spark.range(n).select(F.lit("one").alias("series"), F.col("id").cast("int").alias("pos"), F.when(F.pmod("id", F.lit(1000)) == 0, F.col("id").cast("double")).alias("y"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = segmented.impute(rows, "linear", block=10_000).withColumn("task", F.spark_partition_id())
        by_task = got.groupBy("task").agg(F.count("*").alias("n"), F.max(F.abs(F.col("y_hat") - F.least(F.col("pos"), F.lit(n - 1000)))).alias("off")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert sum(r.n for r in by_task) == n and len(by_task) == 4 and max(r.n for r in by_task) < n / 2 and max(r.off for r in by_task) < 1e-6
