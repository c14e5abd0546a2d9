import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import reconstruct, regression


def frames(spark, data):
    """data: series -> (y with None, {name: x with None})."""
    y = [(s, k, v) for s, (ys, _) in data.items() for k, v in enumerate(ys)]
    x = [(s, name, k, v) for s, (_, xs) in data.items() for name, values in xs.items() for k, v in enumerate(values)]
    return spark.createDataFrame(y, "series string, pos int, y double"), spark.createDataFrame(x, "series string, name string, pos int, x double")


def made(seed, n, k, gaps=0.2):
    rng = np.random.default_rng(seed)
    xs = rng.normal(size=(n, k)) * rng.choice([0.01, 1, 50], k) + rng.normal(size=k) * 1e4
    y = xs @ rng.normal(size=k) + 7 + rng.normal(size=n)
    ys = [None if rng.random() < gaps else float(v) for v in y]
    return ys, {f"c{j}": [None if rng.random() < 0.05 else float(v) for v in xs[:, j]] for j in range(k)}


def expected(ys, xs):
    names = sorted(xs)
    x = np.array([[np.nan if v is None else v for v in xs[c]] for c in names]).T
    y = np.array([np.nan if v is None else v for v in ys])
    full = ~np.isnan(x).any(1)
    use = full[: len(y)] & ~np.isnan(y)
    m, my = x[: len(y)][use].mean(0), y[use].mean()
    b = np.linalg.lstsq(x[: len(y)][use] - m, y[use] - my, rcond=None)[0]
    return my + (x - m) @ b, full


def test_five_covariates_against_numpy(spark):
    data = {"a": made(1, 120, 5), "b": made(2, 60, 2), "c": made(3, 40, 1), "d": made(4, 300, 7)}
    y, x = frames(spark, data)
    got = {(r.series, r.pos): r.line for r in regression.lines(regression.fit(y, x), x).collect()}
    for s, (ys, xs) in data.items():
        line, full = expected(ys, xs)
        assert {p for q, p in got if q == s} == set(np.nonzero(full)[0].tolist())
        assert max(abs(got[s, k] - line[k]) for k in np.nonzero(full)[0]) < 1e-6
    filled = {(r.series, r.pos): (r.y, r.y_hat) for r in regression.fill_by_covariates(y, x).collect()}
    for s, (ys, xs) in data.items():
        line, full = expected(ys, xs)
        assert all(filled[s, k][1] == pytest.approx(v if v is not None else line[k], abs=1e-6) for k, v in enumerate(ys) if v is not None or full[k])
        assert all(v is not None for k, (_, v) in filled.items())


def test_dependent_constant_and_few(spark):
    t = [float(k) for k in range(10)]
    data = {
        "twice": ([2 * v + 1 for v in t[:8]] + [None, None], {"a": t, "b": [3 * v for v in t]}),
        "constant": ([2 * v + 1 for v in t[:8]] + [None, None], {"a": t, "b": [4.0] * 10}),
        "one": ([5.0] + [None] * 9, {"a": t}), "flat": ([5.0] * 8 + [None, None], {"a": [1.0] * 10}), "unseen": ([None] * 10, {"a": t}),
    }
    y, x = frames(spark, data)
    fits = {r.series: r for r in regression.fit(y, x).collect()}
    assert set(fits) == {"twice", "constant", "one", "flat"}
    assert fits["constant"].slopes == pytest.approx([2, 0]) and fits["one"].slopes == [0.0] and fits["flat"].slopes == [0.0]
    got = {(r.series, r.pos): r.y_hat for r in regression.fill_by_covariates(y, x).collect()}
    assert got["twice", 9] == pytest.approx(19, abs=1e-4) and got["constant", 9] == pytest.approx(19) and got["one", 3] == 5 and got["unseen", 3] == 0
    assert regression.fit(y.limit(0), x).collect() == []


def test_imputation_is_joint(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=30), rng.normal(size=30)
    ys = [None if k % 4 == 0 else float(2 * a[k] - 3 * b[k] + 1) for k in range(30)]
    y, x = frames(spark, {"s": (ys, {"a": a.tolist(), "b": b.tolist()})})
    got = {(r.pos, r.q): r.y_hat for r in reconstruct.impute_quantiles(y, x, levels=[0.1, 0.5, 0.9]).collect()}
    assert all(got[k, q] == pytest.approx(2 * a[k] - 3 * b[k] + 1) for k in range(30) for q in (0.1, 0.5, 0.9))


def test_forecast(spark):
    rng = np.random.default_rng(5)
    n, h = 40, 3
    a, b = rng.normal(size=n + h), rng.normal(size=n + h)
    y, x = frames(spark, {"s": ((2 * a - b + 4)[:n].tolist(), {"a": a.tolist(), "b": b.tolist()}), "t": ([1.0, 2.0, 1.0, 2.0], {})})
    got = {(r.series, r.step, r.q): (r.y_hat, r.point) for r in regression.forecast(y, h, x, season=2, levels=[0.1, 0.5, 0.9]).collect()}
    for k in range(h):
        assert got["s", k + 1, 0.9] == pytest.approx((2 * a[n + k] - b[n + k] + 4,) * 2)
    assert got["t", 1, 0.5] == (1.0, 1.0) and got["t", 2, 0.5] == (2.0, 2.0)
    cut = {(r.series, r.step): r.y_hat for r in regression.forecast(y, h, x, context_length=25, season=2, levels=[0.5]).collect()}
    assert cut["s", 2] == pytest.approx(2 * a[n + 1] - b[n + 1] + 4)
    past = x.filter(~((F.col("name") == "b") & (F.col("pos") >= n)))
    alone = {r.step: r.y_hat for r in regression.forecast(y, h, past, season=2, levels=[0.5]).filter("series = 's'").collect()}
    slope, at = np.polyfit(a[:n], (2 * a - b + 4)[:n], 1)
    assert alone[1] == pytest.approx(slope * a[n] + at)
    known = {r.step: r.y_hat for r in regression.forecast(y, h, past, method="naive", levels=[0.5], forecast_covariates=True, point="median").filter("series = 's'").collect()}
    assert known[3] == pytest.approx(2 * a[n + 2] - b[n - 1] + 4)
    with pytest.raises(ValueError):
        regression.forecast(y, h, x.filter(F.col("pos") < n + 1)).collect()
    for bad in ({"horizon": 0}, {"horizon": 1, "method": "x"}, {"horizon": 1, "point": "x"}, {"horizon": 1, "context_length": 0}):
        with pytest.raises(ValueError):
            regression.forecast(y, **bad)
    holes = y.withColumn("y", F.when(F.pmod("pos", F.lit(7)) != 3, F.col("y")))
    full = {r.step: r.y_hat for r in regression.forecast(holes, h, x.withColumn("x", F.when(F.col("pos") != 5, F.col("x"))), auto_complete=True, levels=[0.5]).filter("series = 's'").collect()}
    assert set(full) == {1, 2, 3} and all(v is not None for v in full.values())
