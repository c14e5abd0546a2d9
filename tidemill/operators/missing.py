"""Missing values: summaries, gaps and native imputers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masking import series_seed


def whole():
    return Window.partitionBy("series")


def back():
    """From the series' start to here."""
    return whole().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ahead():
    """From the series' end back to here: what :func:`first_ahead` takes its value from.  (A frame that runs from a row to the end would be gone
    through anew for every row.)"""
    return whole().orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def first_ahead(value: Column) -> Column:
    """The first value that is there, from here on."""
    return F.last(value, True).over(ahead())


def missing_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("series").agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull()).alias("n_missing"), F.avg(F.col("y").isNull().cast("double")).alias("ratio"))


def gap_islands(long: DataFrame) -> DataFrame:
    """Blocks of missing positions: start, end and length."""
    gaps = long.filter("y is null")
    island = F.col("pos") - F.row_number().over(whole().orderBy("pos"))
    return gaps.withColumn("island", island).groupBy("series", "island").agg(F.min("pos").alias("gap_start"), F.max("pos").alias("gap_end"), F.count("*").alias("gap_len")).drop("island")


def locf(y: Column) -> Column:
    """Last value carried on; a leading gap takes the first observed value, an empty series 0."""
    return F.coalesce(y, F.last(y, True).over(back()), first_ahead(y), F.lit(0.0))


def linear(y: Column) -> Column:
    """By position between the neighbours; edges are held, an empty series is 0."""
    spot = F.when(y.isNotNull(), F.struct(F.col("pos").alias("p"), y.alias("v")))
    a, b = F.last(spot, True).over(back()), first_ahead(spot)
    between = a["v"] + (b["v"] - a["v"]) * (F.col("pos") - a["p"]) / (b["p"] - a["p"])
    return F.coalesce(y, between, a["v"], b["v"], F.lit(0.0))


def mean(y: Column) -> Column:
    return F.coalesce(y, F.avg(y).over(whole()), F.lit(0.0))


def zero(y: Column) -> Column:
    return F.when(F.abs(y) == float("inf"), 0.0).otherwise(F.coalesce(y, F.lit(0.0)))


def seasonal(y: Column, season: int) -> Column:
    """The value at the same place of the latest earlier season, else as :func:`locf`."""
    same = Window.partitionBy("series", F.pmod("pos", F.lit(season))).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(y, F.last(y, True).over(same), locf(y))


METHODS = {"locf": locf, "linear": linear, "mean": mean, "zero": zero}


def impute(long: DataFrame, method: str = "linear", season: int | None = None) -> DataFrame:
    """Adds ``y_hat`` at every position; observed values are kept."""
    if method == "seasonal":
        if not season:
            raise ValueError("seasonal imputation needs a season")
        return long.withColumn("y_hat", seasonal(F.col("y"), season))
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return long.withColumn("y_hat", METHODS[method](F.col("y")))


def mask_pointwise(long: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """Marks exactly round-half-even(ratio * n) positions of each series, whatever the partitioning."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be in [0, 1]")
    rank = F.row_number().over(whole().orderBy(series_seed(seed, "series", "pos"), "pos"))
    return long.withColumn("is_masked", rank <= F.bround(F.lit(ratio) * F.count("*").over(whole())))
