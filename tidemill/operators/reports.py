"""Tables of scores: per data set, by metric, against reference constants; interval bands and aligned truth."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import level, pinball
from .leaderboard import gmean

#: Geometric means of the naive forecaster (fixed values).
NAIVE = {"MASE": 1.3978756266343049, "CRPS": 0.2521119096855818}


def interval_bands(pred: DataFrame, bands: list[tuple[float, float]]) -> DataFrame:
    """(series, step, low_x_y, high_x_y ...) per band of levels; bands with a level that is not there are left out with a warning."""
    wanted = sorted({q for band in bands for q in band})
    found = pred.agg(*[F.coalesce(F.bool_or(level(q)), F.lit(False)).alias(f"l{k}") for k, q in enumerate(wanted)]).first() if wanted else ()
    there = [q for q, yes in zip(wanted, found) if yes]
    columns = []
    for low, high in sorted(bands):
        lost = [q for q in (low, high) if not any(abs(q - t) < 5e-4 for t in there)]
        if lost:
            warnings.warn(f"levels {lost} are not among the forecasts", stacklevel=2)
            continue
        name = f"{round(100 * low)}_{round(100 * high)}"
        columns += [F.max(F.when(level(low), F.col("y_hat"))).alias(f"low_{name}"), F.max(F.when(level(high), F.col("y_hat"))).alias(f"high_{name}")]
    return pred.groupBy("series", "step").agg(*columns) if columns else pred.select("series", "step").distinct()


def masked_quantile_loss(rows: DataFrame, levels: list[float]) -> DataFrame:
    """Per series of (series, pos, q, y, y_hat, loss_mask): the mean doubled quantile loss over masked positions, summed over
    the levels, over the root of their number; and MSE and MAE of the middle level.  Without masked positions all are 0."""
    on = F.col("loss_mask") & F.col("y").isNotNull()
    middle, error = level(sorted(levels)[len(levels) // 2]), F.col("y") - F.col("y_hat")
    at = lambda q: F.coalesce(F.avg(F.when(on & level(q), pinball())), F.lit(0.0))
    loss = sum((at(q) for q in levels), F.lit(0.0)) / math.sqrt(len(levels))
    return rows.groupBy("series").agg(
        loss.alias("loss"), F.coalesce(F.avg(F.when(on & middle, error * error)), F.lit(0.0)).alias("mse"), F.coalesce(F.avg(F.when(on & middle, F.abs(error))), F.lit(0.0)).alias("mae")
    )


def dataset_scores(metrics: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Means of the metrics; NaN counts as missing."""
    return metrics.groupBy(*by).agg(*[F.avg(F.when(~F.isnan(n), F.col(n))).alias(n) for n in names])


def metric_table(metrics: DataFrame, by: list[str], models: list[str], names: dict[str, str]) -> DataFrame:
    """One column per metric and model, <label>_<model>, where ``names`` gives each metric's label.  The models are a parameter."""
    cells = [F.max(F.when(F.col("model") == m, F.col(n))).alias(f"{label}_{m}") for n, label in names.items() for m in models]
    return metrics.groupBy(*by).agg(*cells)


def score_scatter(metrics: DataFrame, categories: DataFrame, names: list[str]) -> DataFrame:
    """Means per model with its category, ``Unknown`` where there is none.  Categories are one row per model."""
    return metrics.groupBy("model").agg(*[F.avg(n).alias(n) for n in names]).join(categories, "model", "left").withColumn("category", F.coalesce("category", F.lit("Unknown")))


def reference_score(metrics: DataFrame, constants: dict[str, float] = NAIVE) -> DataFrame:
    """Per model the geometric mean of each metric over the data sets, over its constant."""
    return metrics.groupBy("model").agg(*[(gmean(n) / c).alias(n) for n, c in constants.items()])


def align(pred: DataFrame, truth: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Forecasts and truth joined by their keys; ValueError if either has rows without a partner."""
    if check and (n := _lonely(pred, truth, keys)):
        raise ValueError(f"{n} keys of forecasts or truth have no partner")
    return pred.join(truth, keys)


def _lonely(pred: DataFrame, truth: DataFrame, keys: list[str]) -> int:
    a, b = pred.select(*keys).distinct().withColumn("_side", F.lit(1)), truth.select(*keys).distinct().withColumn("_side", F.lit(2))
    return a.unionByName(b).groupBy(*keys).agg(F.sum("_side").alias("s")).filter("s <> 3").count()
