"""Tables for training, chained forecasts, and metrics by name."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluation, masking
from .common import checkpointed
from .missing import impute


def flatten_channels(packed: DataFrame) -> DataFrame:
    """One row per channel of ``target``, numbered by ``channel``; other columns stay."""
    return packed.select("*", F.posexplode("target").alias("channel", "_target")).withColumn("target", F.col("_target")).drop("_target")


def motif_tile(packed: DataFrame, period: int, length: int, seed: int = 0, key: str = "item_id") -> DataFrame:
    """A drawn window of ``period`` values, missing and infinite ones as 0, repeated to ``length``; shorter items go."""
    rows = packed.filter(F.size("target") >= period)
    start = F.floor(masking.uniform(seed, key) * (F.size("target") - period + 1)).cast("int")
    clean = lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    motif = F.transform(F.slice("target", start + 1, F.lit(period)), clean)
    return rows.withColumn("target", F.slice(F.flatten(F.array_repeat(motif, -(-length // period))), 1, length))


def rollout(context: DataFrame, forecaster: Callable[[DataFrame, int], DataFrame], horizon: int, chunk: int) -> DataFrame:
    """Horizons beyond ``chunk``: ``forecaster(context, h)`` gives (series, step, q, y_hat), whose mean over the levels is the next
    chunk's context.  Each chunk is checkpointed, so plans do not grow."""
    if horizon < 1 or chunk < 1:
        raise ValueError("horizon and chunk must be positive")
    done, past = None, context.select("series", "pos", "y")
    for start in range(0, horizon, chunk):
        part = checkpointed(forecaster(past, min(chunk, horizon - start)))
        end = past.groupBy("series").agg((F.max("pos") + 1).alias("_n"))
        mean = part.groupBy("series", "step").agg(F.avg("y_hat").alias("y")).join(end, "series").select("series", (F.col("_n") + F.col("step") - 1).cast("int").alias("pos"), "y")
        past = past.unionByName(mean)
        moved = part.withColumn("step", F.col("step") + start)
        done = moved if done is None else done.unionByName(moved)
    return done


def complete_lookback(long: DataFrame, method: str = "linear", season: int | None = None) -> DataFrame:
    """Missing values of the look-back are imputed before a forecast; observed ones stay."""
    return impute(long, method, season).withColumn("y", F.col("y_hat")).drop("y_hat")


def forecast_covariates(covariates: DataFrame, forecaster: Callable[[DataFrame, int], DataFrame], horizon: int) -> DataFrame:
    """Past-only covariates (series, name, pos, x), each forecast as a series of its own: their past rows and ``horizon`` more,
    which then count as known.  ``forecaster`` gives (series, step, y_hat)."""
    own = covariates.select(F.struct("series", "name").alias("series"), "pos", F.col("x").alias("y"))
    ends = own.groupBy("series").agg((F.max("pos") + 1).alias("_n"))
    ahead = forecaster(own, horizon).join(ends, "series").select("series.series", "series.name", (F.col("_n") + F.col("step") - 1).cast("int").alias("pos"), F.col("y_hat").alias("x"), F.lit(True).alias("forecast"))
    return covariates.select("series", "name", "pos", "x", F.lit(False).alias("forecast")).unionByName(ahead)


def embed_series(long: DataFrame, fn: Callable, key: str = "series") -> DataFrame:
    """(series, latent): ``fn(pandas frame of one series)`` returns numbers; bound contexts first."""
    import pandas as pd

    kind = dict(long.dtypes)[key]

    def one(group):
        return pd.DataFrame({key: [group[key].iloc[0]], "latent": [[float(x) for x in fn(group)]]})

    return evaluation.score_series(long, one, f"{key} {kind}, latent array<float>", key)


#: Metrics by name: aggregates of ``y`` and ``y_hat``.
METRICS: dict[str, Callable[[], Column]] = {
    "mae": lambda: F.avg(F.abs(F.col("y") - F.col("y_hat"))),
    "mse": lambda: F.avg((F.col("y") - F.col("y_hat")) ** 2),
    "rmse": lambda: F.sqrt(F.avg((F.col("y") - F.col("y_hat")) ** 2)),
    "nmae": lambda: F.try_divide(F.sum(F.abs(F.col("y") - F.col("y_hat"))), F.sum(F.abs("y"))),
}


def evaluate(rows: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """The named metrics over rows with truth and forecast."""
    if lost := [n for n in names if n not in METRICS]:
        raise ValueError(f"unknown metrics {lost}: there are {sorted(METRICS)}")
    return rows.filter("y is not null and y_hat is not null").groupBy(*by).agg(*[METRICS[n]().alias(n) for n in names])


def timed_counts(rows: DataFrame) -> DataFrame:
    """One row: windows scored and the seconds that scoring them took."""
    began = time.monotonic()
    n = rows.count()
    return rows.sparkSession.createDataFrame([(n, time.monotonic() - began)], "n_windows long, seconds double")
