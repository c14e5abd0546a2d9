import datetime

import pytest

from tidemill.operators import rolling


def frame(spark, values, variate="v"):
    start = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([("a", variate, k, start + datetime.timedelta(hours=k), v) for k, v in enumerate(values)], "series string, variate string, pos int, ts timestamp_ntz, y double")


def test_windows_do_not_see_each_other(spark):
    w = {r.window: r for r in rolling.rolling_windows(frame(spark, [1.0, None, 3.0, 4.0, 5.0, 6.0]), 4, 2).collect()}
    assert w[0].cutoff == 2 and w[0].context == [1.0, None] and w[0].filled == [1.0, 1.0] and w[0].truth == [3.0, 4.0]
    assert w[1].cutoff == 4 and w[1].context == [1.0, None, 3.0, 4.0] and w[1].truth == [5.0, 6.0]
    assert [r.context for r in rolling.rolling_windows(frame(spark, [1.0, None, 3.0, 4.0, 5.0, 6.0]), 4, 2, most=1).orderBy("window").collect()] == [[None], [4.0]]


def test_a_context_without_values_does_not_look_ahead(spark):
    rows = rolling.forecast(rolling.rolling_windows(frame(spark, [None, None, 7.0, 8.0]), 2, 2), 2, "naive").collect()
    assert rows[0].filled == [0.0, 0.0] and all(v == 0 for p in rows[0].quantiles for v in p["values"])


def test_seasonal_intervals_widen_by_the_season(spark):
    scored = rolling.forecast(rolling.rolling_windows(frame(spark, [0.0, 10.0, 2.0, 12.0, 0.0, 0.0, 0.0]), 3, 3), 3, "seasonal_naive", [0.1, 0.5, 0.9], season=2)
    rows = {(r.step, round(r.q, 1)): r.y_hat for r in rolling.forecast_rows(scored).collect()}
    assert [rows[k, 0.5] for k in (1, 2, 3)] == [2.0, 12.0, 2.0]
    z = rolling.z_value(0.9)
    assert rows[1, 0.9] == pytest.approx(2 + 2 * z) and rows[3, 0.9] == pytest.approx(2 + 2 * z * 2**0.5) and rows[2, 0.1] == pytest.approx(12 - 2 * z)


def test_levels_are_checked(spark):
    w = rolling.rolling_windows(frame(spark, [1.0, 2.0, 3.0]), 1, 1)
    for levels in ([0.1, 0.9], [0.5, 0.5], [0.5, 1.0]):
        with pytest.raises(ValueError):
            rolling.forecast(w, 1, "naive", levels)
    with pytest.raises(ValueError):
        rolling.forecast(w, 1, "other")
    with pytest.raises(Exception, match="other levels"):
        rolling.window_metrics(rolling.forecast(w, 1, "naive", [0.5]), 1).collect()


def test_metrics_without_truth_are_null(spark):
    m = rolling.window_metrics(rolling.forecast(rolling.rolling_windows(frame(spark, [1.0, 2.0, None, None]), 2, 2), 2, "naive"), 1).collect()
    assert m[0].mse is None and m[0].crps is None and m[0].mase is None


def test_batches_hold_one_window_of_a_series(spark):
    long = frame(spark, [float(k) for k in range(9)], "u").unionByName(frame(spark, [float(k) for k in range(9)]))
    rows = rolling.scoring_batches(rolling.rolling_windows(long, 6, 2), 1).collect()
    assert len(rows) == 6 and all(len({(r.series, r.variate) for r in rows if r.batch_id == b}) == sum(r.batch_id == b for r in rows) for b in {r.batch_id for r in rows})


def test_union_and_best(spark):
    a, b = spark.createDataFrame([(2.0, "x")], "score double, m string"), spark.createDataFrame([("y",), ("z",)], "m string")
    assert sorted(r.m for r in rolling.union_results(a, b).collect()) == ["x", "y", "z"]
    assert [r.m for r in rolling.best_rows(rolling.union_results(b, a), "score", 2, "m").collect()] == ["x", "y"]
    with pytest.raises(ValueError):
        rolling.union_results()
