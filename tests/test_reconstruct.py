import pytest

from tidemill.operators import forecast, reconstruct
from tidemill.operators.rolling import z_value

LEVELS = [0.1, 0.5, 0.9]


def long(spark, values):
    return spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "series string, pos int, y double")


def covariate(spark, values, name="c"):
    return spark.createDataFrame([("a", name, k, v) for k, v in enumerate(values)], "series string, name string, pos int, x double")


def by_key(rows):
    return {(r.pos, r.q): r.y_hat for r in rows.collect()}


def test_width_of_a_tied_walk(spark):
    got = by_key(reconstruct.impute_quantiles(long(spark, [None, 0.0, None, None, None, 4.0, None]), levels=LEVELS))
    sigma, z = 2.0, z_value(0.9)  # one pair of neighbours: 16 over a distance of 4
    assert got[1, 0.1] == got[1, 0.9] == 0 and got[3, 0.5] == pytest.approx(2)
    assert got[3, 0.9] == pytest.approx(2 + z * sigma) and got[2, 0.9] == pytest.approx(1 + z * sigma * 0.75**0.5)
    assert got[0, 0.1] == pytest.approx(-z * sigma) and got[6, 0.9] == pytest.approx(4 + z * sigma)


def test_series_without_values(spark):
    assert set(by_key(reconstruct.impute_quantiles(long(spark, [None, None]), levels=LEVELS)).values()) == {0.0}
    assert reconstruct.impute_quantiles(long(spark, [1.0]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        reconstruct.impute_quantiles(long(spark, [1.0]), levels=[0.1])


def test_covariates(spark):
    y, x = long(spark, [1.0, 3.0, None, 7.0]), covariate(spark, [0.0, 1.0, None, 3.0])
    assert by_key(reconstruct.impute_quantiles(y, x, levels=LEVELS))[2, 0.5] == pytest.approx(5)  # no covariate there: linear
    got = by_key(reconstruct.impute_quantiles(y, x, levels=LEVELS, auto_complete=True))
    assert got[2, 0.1] == pytest.approx(5) and got[2, 0.9] == pytest.approx(5)  # an exact line has no residual
    both = x.unionByName(covariate(spark, [2.0] * 4, "constant"))
    assert by_key(reconstruct.impute_quantiles(y, both, levels=[0.5], auto_complete=True))[2, 0.5] == pytest.approx(5)
    bent = by_key(reconstruct.impute_quantiles(long(spark, [0.0, 0.0, 3.0]), covariate(spark, [0.0, 1.0, 2.0]), levels=[0.5], keep_observed=False))
    assert [bent[k, 0.5] for k in range(3)] == pytest.approx([-0.5, 1.0, 2.5])


def test_masked_scores(spark):
    truth = spark.createDataFrame([("a", k, float(v), k == 1) for k, v in enumerate([1, 4, 1, 2])] + [("b", 0, None, True)], "series string, pos int, y_true double, is_masked boolean")
    pred = spark.createDataFrame([("a", 1, q, v) for q, v in ((0.1, 2.0), (0.5, 3.0), (0.9, 5.0))], "series string, pos int, q double, y_hat double")
    (r,) = reconstruct.masked_quantile_eval(pred, truth, 1).collect()
    assert (r.n, r.mae, r.rmse, r.nd) == (1, 1.0, 1.0, 0.25) and r.mase == pytest.approx(3 / 7)
    assert r.crps == pytest.approx((2 * 0.1 * 2 + 2 * 0.5 * 1 + 2 * 0.1 * 1) / 4 / 3)


def test_seasonal_quantiles(spark):
    got = {(r.step, r.q): r.y_hat for r in forecast.seasonal_naive_quantiles(long(spark, [0.0, 10.0, 2.0, 12.0]), 3, 2, LEVELS).collect()}
    z = z_value(0.9)
    assert got[1, 0.5] == 2 and got[1, 0.9] == pytest.approx(2 + 2 * z) and got[3, 0.1] == pytest.approx(2 - 2 * z * 2**0.5)
    assert {r.y_hat for r in forecast.seasonal_naive_quantiles(long(spark, [5.0]), 2, 3, LEVELS).collect()} == {5.0}
