"""Rolling evaluation: forecasts per (series, variate, window, step) and all their metrics.

Series are packed once (one shuffle by series and variate); windows, forecasts and metrics are then column
expressions on the packed rows, so no later step shuffles, and a window never reads another window's rows.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .missing import impute

#: The levels that a probabilistic forecast is scored at.
LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
KEYS = ["series", "variate", "window"]


def z_value(q: float) -> float:
    """Standard normal quantile of a level."""
    if not 0 < q < 1:
        raise ValueError(f"a level must be between 0 and 1, not {q!r}")
    return NormalDist().inv_cdf(q)


def checked_levels(levels: list[float]) -> list[float]:
    """Levels in order; they must be distinct, within (0, 1), and hold the median."""
    found = sorted(float(q) for q in levels)
    if len(set(found)) != len(found) or not any(abs(q - 0.5) < 1e-9 for q in found):
        raise ValueError("levels must be distinct and hold 0.5")
    for q in found:
        z_value(q)
    return found


def mean_of(values: Column) -> Column:
    """Mean of an array's values that are there; NULL without any."""
    there = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there))


def total_of(values: Column) -> Column:
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)


def differences(values: Column, lag: int = 1) -> Column:
    """Differences of an array's values ``lag`` places apart."""
    n = F.greatest(F.size(values) - lag, F.lit(0))
    return F.zip_with(F.slice(values, lag + 1, n), F.slice(values, 1, n), lambda later, earlier: later - earlier)


def computed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows, with all columns but ``keys`` computed once: the optimizer does not copy their expressions into what reads them,
    as it does through plain projections, since they come out of a generator."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, F.inline(F.array(F.struct(*rest))))


def rolling_windows(long: DataFrame, test_length: int, horizon: int, most: int | None = None) -> DataFrame:
    """One row per series, variate and test window: ``context`` and ``filled`` (its gaps closed), both cut to the last ``most``
    values, ``truth`` of the next ``horizon`` values, ``cutoff`` and its time ``ts`` (NULL without ``ts`` in ``long``).

    ``long`` is (series, variate, pos, y) on a regular grid, with ``ts`` if steps shall have times.  There are max(1,
    test_length // horizon) windows; those without any context go.  A gap at the beginning takes the first observed value of the context.
    """
    if horizon < 1 or test_length < 1 or most is not None and most < 1:
        raise ValueError("lengths must be positive")
    timed = long if "ts" in long.columns else long.withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    own = timed.select(F.struct("series", "variate").alias("series"), "pos", "ts", "y")
    point = F.struct("pos", "y", "y_hat")
    packed = impute(own, "locf").groupBy("series").agg(F.array_sort(F.collect_list(point)).alias("points"), F.min("ts").alias("start"))
    cutoffs = F.sequence(F.lit(0), F.lit(max(1, test_length // horizon) - 1))
    rows = packed.select("series.*", "start", "points", F.explode(cutoffs).alias("window")).withColumn("cutoff", (F.size("points") - test_length + F.col("window") * horizon).cast("int")).filter("cutoff > 0")
    first = F.greatest(F.col("cutoff") - (most or 2**30), F.lit(0)) + 1
    part = lambda name, at, n: F.transform(F.slice("points", at, n), lambda p: p[name])
    rows = rows.withColumn("context", part("y", first, F.col("cutoff") - first + 1)).withColumn("filled", part("y_hat", first, F.col("cutoff") - first + 1))
    # Without an observed value a gap would take one from beyond the cut-off.
    rows = rows.withColumn("filled", F.when(F.exists("context", lambda v: v.isNotNull()), F.col("filled")).otherwise(F.transform("filled", lambda _: F.lit(0.0))))
    return computed(rows.select(*KEYS, "cutoff", "start", "context", "filled", part("y", F.col("cutoff") + 1, F.lit(horizon)).alias("truth")), KEYS)


def forecast(windows: DataFrame, horizon: int, method: str = "seasonal_naive", levels: list[float] = LEVELS, season: int = 24) -> DataFrame:
    """Adds ``quantiles``, an array by level of (q, values by step).

    naive: the last value, with deviation sigma * sqrt(step), sigma the root mean square of one-step differences;
    seasonal_naive: the value one season back (the last value if the context is shorter), with sigma of seasonal
    differences times the root of the number of seasons begun.
    """
    if method not in ("naive", "seasonal_naive"):
        raise ValueError(f"unknown method {method!r}")
    lag = 1 if method == "naive" else season
    if horizon < 1 or lag < 1:
        raise ValueError("horizon and season must be positive")
    steps, n = F.sequence(F.lit(0), F.lit(horizon - 1)), F.size("filled")
    squares = F.transform(differences(F.col("filled"), lag), lambda d: d * d)
    sigma = F.sqrt(F.coalesce(mean_of(squares), F.lit(0.0)))
    place = lambda k: F.when(n >= lag, n - lag + F.pmod(k, F.lit(lag))).otherwise(n - 1).cast("int")
    step = F.transform(steps, lambda k: F.struct(F.get("filled", place(k)).alias("middle"), F.sqrt(F.floor(k / lag) + 1).alias("wide")))
    keys = [c for c in windows.columns if c in KEYS]
    rows = computed(windows.withColumn("_sigma", sigma).withColumn("_steps", step), keys)
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(z_value(q)).alias("z")) for q in checked_levels(levels)])
    values = lambda p: F.transform("_steps", lambda s: s["middle"] + p["z"] * F.col("_sigma") * s["wide"])
    rows = rows.withColumn("quantiles", F.transform(pairs, lambda p: F.struct(p["q"].alias("q"), values(p).alias("values"))))
    return computed(rows.drop("_sigma", "_steps"), keys)


def forecast_rows(scored: DataFrame, unit: str = "hour") -> DataFrame:
    """(series, variate, window, step, ts, q, y_hat) of packed forecasts; ``ts`` is the start plus the step's place."""
    each = scored.select(*KEYS, "cutoff", "start", F.explode("quantiles").alias("p"))
    rows = each.select(*KEYS, "cutoff", "start", "p.q", F.posexplode("p.values").alias("k", "y_hat"))
    return rows.select(*KEYS, (F.col("k") + 1).alias("step"), F.expr(f"start + (cutoff + k) * interval 1 {unit}").alias("ts"), "q", "y_hat")


def forecast_timestamps(windows: DataFrame, horizon: int, unit: str = "hour") -> DataFrame:
    """(series, variate, window, step, ts): the times that a window's forecast is for."""
    rows = windows.select(*KEYS, "cutoff", "start", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return rows.select(*KEYS, "step", F.expr(f"start + (cutoff + step - 1) * interval 1 {unit}").alias("ts"))


def scoring_batches(windows: DataFrame, batch: int) -> DataFrame:
    """Adds ``batch_id`` so that no batch holds two windows of one series and none more than about ``batch`` rows: the window's
    number, and a share of the series by hash; (series, variate, window) puts results back in order."""
    if batch < 1:
        raise ValueError("batch must be positive")
    parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / batch)).cast("int")
    sizes = windows.groupBy("window").agg(F.count("*").alias("_n"))
    placed = windows.join(sizes, "window").withColumn("_part", F.pmod(F.xxhash64("series", "variate"), parts))
    return placed.withColumn("batch_id", F.concat_ws("-", "window", "_part")).drop("_n", "_part")


def window_metrics(scored: DataFrame, season: int, levels: list[float] = LEVELS) -> DataFrame:
    """MSE, MAE, RMSE, MAPE, sMAPE, MASE and ND of the median, and CRPS over all levels, per series, variate and window.

    Positions without truth do not count; quotients by zero are left out.  The forecast must have exactly ``levels``.
    """
    wanted = checked_levels(levels)
    quantiles = F.when(F.size("quantiles") == len(wanted), F.col("quantiles")).otherwise(F.raise_error(F.lit("the forecast has other levels than those asked for")))
    median = F.get(F.filter(quantiles, lambda p: F.abs(p["q"] - 0.5) < 1e-9), F.lit(0))["values"]
    rows = scored.withColumn("_pairs", F.arrays_zip(F.col("truth").alias("y"), median.alias("m")))
    rows = rows.withColumn("_pairs", F.filter("_pairs", lambda p: p["y"].isNotNull()))
    over = lambda f: F.transform("_pairs", f)
    error = lambda p: F.abs(p["y"] - p["m"])
    size = total_of(over(lambda p: F.abs(p["y"])))
    dense = F.filter("context", lambda v: v.isNotNull())
    scale = F.nullif(mean_of(F.transform(differences(dense, season), F.abs)), F.lit(0.0))

    def loss(p):
        pairs = F.filter(F.arrays_zip(F.col("truth").alias("y"), p["values"].alias("v")), lambda x: x["y"].isNotNull())
        return F.try_divide(total_of(F.transform(pairs, lambda x: 2 * F.abs((x["y"] - x["v"]) * (F.when(x["v"] >= x["y"], 1.0).otherwise(0.0) - p["q"])))), size)

    out = rows.select(
        *KEYS, mean_of(over(lambda p: error(p) * error(p))).alias("mse"), mean_of(over(error)).alias("mae"), mean_of(over(lambda p: F.try_divide(error(p), F.abs(p["y"])))).alias("mape"),
        mean_of(over(lambda p: F.try_divide(2 * error(p), F.abs(p["y"]) + F.abs(p["m"])))).alias("smape"), F.try_divide(total_of(over(error)), size).alias("nd"),
        mean_of(F.transform(quantiles, loss)).alias("crps"), scale.alias("_scale"),
    )
    return out.select(*KEYS, "mse", "mae", F.sqrt("mse").alias("rmse"), "mape", "smape", (F.col("mae") / F.col("_scale")).alias("mase"), "nd", "crps")


def wql_pinball(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Per series: the mean over levels of twice the pinball sum, max(q e, (q - 1) e), over the sum of |y|."""
    rows = truth.filter("y is not null").join(pred, ["series", "step"])
    e = F.col("y") - F.col("y_hat")
    by_level = rows.groupBy("series", "q").agg(F.try_divide(2 * F.sum(F.greatest(F.col("q") * e, (F.col("q") - 1) * e)), F.sum(F.abs("y"))).alias("l"))
    return by_level.groupBy("series").agg(F.avg("l").alias("wql"))


def union_results(*results: DataFrame) -> DataFrame:
    """Result tables one below the other, by column name; columns that one lacks are NULL there."""
    if not results:
        raise ValueError("there must be a result table")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def best_rows(results: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of the smallest ``by``, missing ones last; ``ties`` order equal ones."""
    return results.orderBy(F.col(by).asc_nulls_last(), *ties).limit(n)


def last_steps(pred: DataFrame, k: int) -> DataFrame:
    """The last ``k`` steps of each series' forecast, whatever its horizon."""
    ends = pred.groupBy("series").agg(F.max("step").alias("_end"))
    return pred.join(ends, "series").filter(F.col("step") > F.col("_end") - k).drop("_end")
