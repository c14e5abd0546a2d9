"""Covariates: long frames (series, name, pos, x) beside targets (series, pos, y), NULL for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .missing import linear


def select_channels(long: DataFrame, target: str, covariates: list[str]) -> tuple[DataFrame, DataFrame]:
    """The target variate as (series, pos, y), and the chosen others as (series, name, pos, x).  Input: (series, variate, pos, y)."""
    chosen = long.filter(F.col("variate").isin(covariates)).select("series", F.col("variate").alias("name"), "pos", F.col("y").alias("x"))
    return long.filter(F.col("variate") == target).select("series", "pos", "y"), chosen


def assemble_covariates(past: DataFrame, future: DataFrame) -> DataFrame:
    """Past and future values in one frame; where a series has future values, only the names known in the future stay."""
    names, series = future.select("series", "name").distinct(), future.select("series").distinct()
    known = past.join(names, ["series", "name"], "left_semi").unionByName(past.join(series, "series", "left_anti"))
    return known.withColumn("known_future", F.lit(False)).unionByName(future.withColumn("known_future", F.lit(True)))


def broadcast_covariates(targets: DataFrame, covariates: DataFrame) -> DataFrame:
    """One covariate set for every variate of its series: (series, variate, name, pos, x)."""
    return targets.select("series", "variate").distinct().join(covariates, "series").select("series", "variate", "name", "pos", "x")


def past_only(covariates: DataFrame, targets: DataFrame) -> DataFrame:
    """Covariate values within the context of their series."""
    n = targets.groupBy("series").agg((F.max("pos") + 1).alias("_n"))
    return covariates.join(n, "series").filter(F.col("pos") < F.col("_n")).drop("_n")


def sparse_covariates(covariates: DataFrame, step: int) -> DataFrame:
    """Keeps every ``step``-th value, the last of each group; the others are missing."""
    if step < 1:
        raise ValueError("step must be positive")
    return covariates.withColumn("x", F.when(F.pmod("pos", F.lit(step)) == step - 1, F.col("x")))


def scale_covariates(covariates: DataFrame, queried_from: int, eps: float = 1e-7) -> DataFrame:
    """Adds ``scaled``: mean and population deviation come from positions >= ``queried_from``, and scale all positions."""
    w, queried = Window.partitionBy("series", "name"), F.when(F.col("pos") >= queried_from, F.col("x"))
    return covariates.withColumn("scaled", (F.col("x") - F.avg(queried).over(w)) / (F.stddev_pop(queried).over(w) + eps))


def _fitted(long: DataFrame, covariate: DataFrame) -> DataFrame:
    pairs = long.filter("y is not null").join(covariate.select("series", "pos", "x"), ["series", "pos"])
    return pairs.groupBy("series").agg(F.regr_slope("y", "x").alias("_b"), F.regr_intercept("y", "x").alias("_a"))


def fill_by_covariate(long: DataFrame, covariate: DataFrame) -> DataFrame:
    """Adds ``y_hat``: observed values, else the series' least-squares line over one covariate, else linear interpolation."""
    rows = long.withColumn("_linear", linear(F.col("y"))).join(covariate.select("series", "pos", "x"), ["series", "pos"], "left")
    rows = rows.join(_fitted(long, covariate), "series", "left")
    return rows.withColumn("y_hat", F.coalesce("y", F.col("_a") + F.col("_b") * F.col("x"), "_linear")).drop("_linear", "_a", "_b", "x")


def forecast_by_covariate(context: DataFrame, covariate: DataFrame, horizon: int) -> DataFrame:
    """(series, step, y_hat): the line fitted on the context at the known future values; the context's mean where there is no line."""
    n = context.groupBy("series").agg((F.max("pos") + 1).alias("_n"), F.avg("y").alias("_mean"))
    ahead = covariate.join(n, "series").withColumn("step", F.col("pos") - F.col("_n") + 1).filter(F.col("step").between(1, horizon))
    rows = ahead.join(_fitted(context, covariate), "series", "left")
    return rows.select("series", "step", F.coalesce(F.col("_a") + F.col("_b") * F.col("x"), "_mean").alias("y_hat"))


def target_encode(rows: DataFrame, smooth: float = 1.0) -> DataFrame:
    """Adds ``code``: (sum of y + smooth * mean) / (n + smooth) of the row's category within its series, over observed y.
    A category never observed (as in a future part) gets the series' mean."""
    series, group = Window.partitionBy("series"), Window.partitionBy("series", "category")
    mean = F.avg("y").over(series)
    total, n = F.coalesce(F.sum("y").over(group), F.lit(0.0)), F.count("y").over(group)
    return rows.withColumn("code", (total + smooth * mean) / (n + smooth))


def ordinal_encode(rows: DataFrame) -> DataFrame:
    """Adds ``code``: the place of the category in sorted order among those with a known part, from 0; unseen ones are NULL.
    Input: (series, category, known_future)."""
    seen = rows.filter("not known_future and category is not null").select("series", "category").distinct()
    codes = seen.withColumn("code", F.dense_rank().over(Window.partitionBy("series").orderBy("category")) - 1)
    return rows.join(codes, ["series", "category"], "left")
