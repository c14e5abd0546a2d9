"""Per-series scaling; every scaler returns the statistics next to the scaled value, for the inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def whole():
    return Window.partitionBy("series")


def standard_scale(long: DataFrame, eps: float = 1e-5) -> DataFrame:
    centre, spread = F.coalesce(F.avg("y").over(whole()), F.lit(0.0)), F.coalesce(F.stddev_pop("y").over(whole()), F.lit(1.0))
    return long.withColumn("centre", centre).withColumn("spread", F.when(spread == 0, eps).otherwise(spread)).withColumn("scaled", (F.col("y") - F.col("centre")) / F.col("spread"))


def minmax_scale(long: DataFrame) -> DataFrame:
    low, high = F.min("y").over(whole()), F.max("y").over(whole())
    return long.withColumn("scaled", (F.col("y") - low) / (high - low + 1e-8))


def asinh_scale(long: DataFrame) -> DataFrame:
    return standard_scale(long).withColumn("scaled", F.asinh("scaled"))


def masked_instance_scale(long: DataFrame, masked: bool = True, least: float = 1e-5) -> DataFrame:
    """By mean and deviation of the positions that are not ``is_masked`` (population deviation), or of all (sample deviation); a
    deviation of at most ``least`` counts as 1."""
    value = F.when(~F.col("is_masked"), F.col("y")) if masked else F.col("y")
    spread = (F.stddev_pop if masked else F.stddev_samp)(value).over(whole())
    return long.withColumn("scaled", (F.col("y") - F.avg(value).over(whole())) / F.when(spread > least, spread).otherwise(1.0))


def display_scale(rows: DataFrame, context: DataFrame, columns: list[str], eps: float = 1e-6) -> DataFrame:
    """The named columns by mean and population deviation (plus ``eps``) of the series' context."""
    stats = context.groupBy("series").agg(F.avg("y").alias("_m"), F.stddev_pop("y").alias("_s"))
    return rows.join(stats, "series").withColumns({c: (F.col(c) - F.col("_m")) / (F.col("_s") + eps) for c in columns}).drop("_m", "_s")
