"""Windows, native baseline forecasts, and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .missing import impute
from .rolling import LEVELS, checked_levels, z_value


def test_windows(long: DataFrame, test_length: int, horizon: int) -> DataFrame:
    """Cut-offs of max(1, floor(test_length / horizon)) windows per series: contexts end before ``cutoff``."""
    windows = max(1, test_length // horizon)
    n = long.groupBy("series").agg((F.max("pos") + 1).alias("n"))
    rows = n.select("series", "n", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("window"))
    return rows.select("series", "window", (F.col("n") - test_length + F.col("window") * horizon).cast("int").alias("cutoff")).filter("cutoff > 0")


def seasonal_naive(long: DataFrame, horizon: int, season: int) -> DataFrame:
    """(series, step, y_hat): the value one season back of the gap-filled series; the last value if it is shorter."""
    if horizon < 1 or season < 1:
        raise ValueError("horizon and season must be positive")
    filled = impute(long, "locf")
    n = F.max("pos").over(Window.partitionBy("series")) + 1
    tail = filled.withColumn("n", n).filter(F.col("pos") >= F.col("n") - season)
    packed = tail.groupBy("series").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "y_hat"))), lambda s: s["y_hat"]).alias("last"))
    steps = packed.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    index = F.when(F.col("n") >= season, F.pmod(F.col("step") - 1, F.lit(season)) + 1).otherwise(F.size("last"))
    return steps.select("series", "step", F.element_at("last", index.cast("int")).alias("y_hat"))


def naive_quantiles(long: DataFrame, horizon: int, levels=(0.1, 0.5, 0.9)) -> DataFrame:
    """(series, step, q, y_hat): last value plus z * sigma * sqrt(step), sigma from one-step differences."""
    filled = impute(long, "locf").withColumn("d", F.col("y_hat") - F.lag("y_hat").over(Window.partitionBy("series").orderBy("pos")))
    last = filled.groupBy("series").agg(F.max_by("y_hat", "pos").alias("last"), F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), F.lit(0.0)).alias("sigma"))
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(z_value(q)).alias("z")) for q in levels])
    rows = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("p", F.explode(pairs))
    return rows.select("series", "step", F.col("p.q").alias("q"), (F.col("last") + F.col("p.z") * F.col("sigma") * F.sqrt("step")).alias("y_hat"))


def seasonal_naive_quantiles(long: DataFrame, horizon: int, season: int, levels: list[float] = LEVELS) -> DataFrame:
    """(series, step, q, y_hat): :func:`seasonal_naive` plus z * sigma * the root of the seasons begun, sigma the root mean
    square of seasonal differences of the gap-filled series (0 if it is not longer than a season)."""
    d = F.col("y_hat") - F.lag("y_hat", season).over(Window.partitionBy("series").orderBy("pos"))
    sigma = impute(long, "locf").withColumn("d", d).groupBy("series").agg(F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), F.lit(0.0)).alias("sigma"))
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(z_value(q)).alias("z")) for q in checked_levels(levels)])
    rows = seasonal_naive(long, horizon, season).join(sigma, "series").withColumn("p", F.explode(pairs))
    seasons = F.floor((F.col("step") - 1) / season) + 1
    return rows.select("series", "step", "p.q", (F.col("y_hat") + F.col("p.z") * F.col("sigma") * F.sqrt(seasons)).alias("y_hat"))


def seasonal_error(context: DataFrame, season: int) -> DataFrame:
    """Mean absolute seasonal difference of the observed values, gaps closed first; NULL if zero or too short."""
    dense = context.filter("y is not null").withColumn("d", F.abs(F.col("y") - F.lag("y", season).over(Window.partitionBy("series").orderBy("pos"))))
    return dense.groupBy("series").agg(F.nullif(F.avg("d"), F.lit(0.0)).alias("scale"))


def point_metrics(pred: DataFrame, truth: DataFrame, scale: DataFrame) -> DataFrame:
    """MSE, MAE, RMSE, MAPE, sMAPE, ND, MASE per series over rows with truth.  Inputs are keyed (series, step)."""
    rows = truth.join(pred, ["series", "step"])
    error, size = F.abs(F.col("y") - F.col("y_hat")), F.abs("y")
    # Terms that are no number (division by zero) do not count.
    scores = rows.groupBy("series").agg(
        F.avg(F.when(F.col("y").isNotNull(), error * error)).alias("mse"), F.avg(error).alias("mae"), F.avg(F.try_divide(error, size)).alias("mape"),
        F.avg(F.try_divide(2 * error, size + F.abs("y_hat"))).alias("smape"), F.try_divide(F.sum(error), F.sum(size)).alias("nd"),
    )
    return scores.join(scale, "series", "left").select("series", "mse", "mae", F.sqrt("mse").alias("rmse"), "mape", "smape", "nd", (F.col("mae") / F.col("scale")).alias("mase"))


def quantile_loss(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean weighted quantile loss per series: mean over levels of sum 2|(y - q)(1[q >= y] - level)| / sum |y|."""
    rows = truth.filter("y is not null").join(pred, ["series", "step"])
    loss = 2 * F.abs((F.col("y") - F.col("y_hat")) * (F.when(F.col("y_hat") >= F.col("y"), 1.0).otherwise(0.0) - F.col("q")))
    by_level = rows.groupBy("series", "q").agg(F.try_divide(F.sum(loss), F.sum(F.abs("y"))).alias("l"))
    return by_level.groupBy("series").agg(F.avg("l").alias("crps"))
