"""Selection, layout, training tables and reports by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemill.operators import forecast, layout, reports, selection, training


def long(spark, values, name="a"):
    return spark.createDataFrame([(name, k, v) for k, v in enumerate(values)], "series string, pos int, y double")


def packed(spark, *targets):
    return spark.createDataFrame([("d", str(k), t) for k, t in enumerate(targets)], "dataset string, item_id string, target array<double>")


def test_frequencies(spark):
    day = dt.datetime
    rows = [("h", day(2024, 1, 1, k * 2)) for k in range(3)] + [("m", day(2024, k, 1)) for k in (1, 4, 7)] + [("x", day(2024, 1, k)) for k in (1, 2, 4)] + [("one", day(2024, 1, 1))]
    found = layout.infer_freq(spark.createDataFrame(rows, "series string, ts timestamp"))
    assert {r.series: r.freq for r in found.collect()} == {"h": "2H", "m": "Q", "x": None, "one": None}
    with pytest.raises(ValueError):
        layout.require_freq(found)
    rules = spark.createDataFrame([("15min",), ("5H",), ("ME",), ("W-SUN",), ("odd",)], "freq string").select("freq", layout.seasonality("freq").alias("s"), layout.default_horizon("freq").alias("h"), layout.default_horizon("freq", m4=True).alias("m"))
    assert {r.freq: (r.s, r.h, r.m) for r in rules.collect()} == {"15min": (96, 48, None), "5H": (1, 48, 48), "ME": (12, 12, 18), "W-SUN": (1, 8, 13), "odd": (1, None, None)}
    seconds = spark.createDataFrame([(3600,), (7000,), (864000,), (None,)], "s int").select(layout.steps_per_day("s").alias("k"))
    assert [r.k for r in seconds.collect()] == [24, 1, 1, 1]


def test_patches_and_resizing_of_short_items(spark):
    got = {r.item_id: r for r in layout.patch(packed(spark, [1.0, 2.0, 3.0], [], [None, None]), 2, 1).collect()}
    assert got["0"].patches == [[None, 1.0], [1.0, 2.0], [2.0, 3.0]] and got["0"].usable == [True] * 3
    assert got["1"].patches == [] and got["2"].usable == [False]
    assert [r.target for r in layout.resize_series(packed(spark, [1.0, 3.0], []), 4, "linear").orderBy("item_id").collect()] == [[1.0, 1.5, 2.5, 3.0], []]


def test_item_names(spark):
    name = lambda *rows: sorted(r.item_id for r in layout.item_names(spark.createDataFrame(rows, "file string, variate string")).collect())
    assert name(("f", "x"), ("g", "x")) == ["f", "g"] and name(("f", "x"), ("f", "y")) == ["x", "y"] and name(("f", "x"), ("g", "y")) == ["f_x", "g_y"]


def test_validation(spark):
    with pytest.raises(ValueError):
        selection.validate_levels([0.1, 0.25], [0.1, 0.5])
    with pytest.raises(ValueError):
        selection.validate_keys({"target": 1, "future_covariates": {"x": 1}})
    with pytest.raises(ValueError):
        selection.min_length(packed(spark, [1.0]), 2)
    with pytest.raises(ValueError):
        selection.check_split_lengths(packed(spark, [1.0], [1.0] * 9), 2)
    with pytest.warns(UserWarning):
        selection.check_split_lengths(packed(spark, [1.0] * 9), 5)
    target = long(spark, [1.0] * 4)
    cov = lambda n: spark.createDataFrame([("a", "x", k, 1.0) for k in range(n)], "series string, name string, pos int, x double")
    selection.validate_covariates(target, cov(4), 2)
    selection.validate_covariates(target, cov(6), 2)
    with pytest.raises(ValueError):
        selection.validate_covariates(target, cov(5), 2)
    with pytest.raises(ValueError):
        selection.all_missing(long(spark, [None, None]))
    back = selection.restore_missing(spark.createDataFrame([("a", 1.0)], "series string, y_hat double"), spark.createDataFrame([("a",), ("b",)], "series string"), ["series"])
    assert {r.series: r.y_hat for r in back.collect()} == {"a": 1.0, "b": 0.0}


def test_resampled_fill(spark):
    rows = long(spark, [None, 5.0, None, 7.0, None]).unionByName(long(spark, [None], "b"))
    got = {(r.series, r.pos): (r.pos_used, r.y_hat) for r in selection.fill_by_resample(rows).collect()}
    assert len(got) == 6 and got["a", 1] == (1, 5.0) and got["b", 0] == (None, None)
    assert all(got["a", k] in ((1, 5.0), (3, 7.0)) for k in (0, 2, 4))


def test_windows_and_splits(spark):
    rows = packed(spark, *[[float(i) for i in range(n)] for n in (0, 3, 10, 200)])
    for r in selection.random_window(rows, 8, 4).collect():
        size = len(r.target)
        assert size == {"0": 0, "1": 3}.get(r.item_id, size) and (not size or r.target == [float(r.window_start + k) for k in range(size)])
        assert r.item_id in "01" or 4 <= size <= 8
    train = selection.cut_context_future(rows, "TRAIN", 4, 2, 1).collect()
    assert {r.item_id for r in train} == {"1", "2", "3"} and all(r.future == [float(r.split), float(r.split + 1)] and len(r.context) == min(4, r.split) for r in train)
    assert all(r.future is None and r.split == len(r.target) for r in selection.cut_context_future(rows, "TEST", 4, 2).collect())
    many = spark.range(1000).selectExpr("id as item_id", "if(id < 700, 'hot', null) as g")
    placed = selection.hash_order(many, "item_id", "g").collect()
    for g, n in (("hot", 700), (None, 300)):
        assert sorted(r["index"] for r in placed if r.g == g) == list(range(n))
    assert selection.split_series(many, 0.333).filter("is_validation").count() == 333


def test_tiles(spark):
    tiles = training.motif_tile(packed(spark, [1.0, None], [1.0]), 2, 5).collect()
    assert [r.target for r in tiles] == [[1.0, 0.0, 1.0, 0.0, 1.0]]


def test_rollout_equals_one_naive_step_at_a_time(spark):
    last = lambda rows, h: forecast.naive_quantiles(rows, h)
    got = training.rollout(long(spark, [1.0, 2.0, 4.0]), last, 5, 2)
    assert sorted(r.step for r in got.filter("q = 0.5").collect()) == [1, 2, 3, 4, 5]
    assert all(abs(r.y_hat - 4.0) < 1e-9 for r in got.filter("q = 0.5").collect())


def test_embedding_and_names(spark):
    rows = long(spark, [1.0, 3.0]).unionByName(long(spark, [5.0], "b"))
    assert {r.series: r.latent for r in training.embed_series(rows, lambda g: [g["y"].mean(), len(g)]).collect()} == {"a": [2.0, 2.0], "b": [5.0, 1.0]}
    with pytest.raises(ValueError):
        training.evaluate(rows.withColumn("y_hat", F.lit(0.0)), ["other"], ["series"])
    assert training.timed_counts(rows).first().n_windows == 3


def test_reports(spark):
    pred = spark.createDataFrame([("a", 1, 0.1, 1.0), ("a", 1, 0.9, 3.0)], "series string, step int, q double, y_hat double")
    with pytest.warns(UserWarning):
        got = reports.interval_bands(pred, [(0.1, 0.9), (0.2, 0.8)])
    assert got.columns == ["series", "step", "low_10_90", "high_10_90"] and got.first().high_10_90 == 3.0
    truth = spark.createDataFrame([("a", 1, 2.0)], "series string, step int, y double")
    assert reports.align(pred, truth, ["series", "step"]).count() == 2
    with pytest.raises(ValueError):
        reports.align(pred, truth.withColumn("step", F.lit(2)), ["series", "step"])
