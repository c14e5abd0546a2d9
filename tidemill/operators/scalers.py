"""Fitted scaling as a table: statistics are fitted once, and scale and unscale any later rows of the same series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("standard", "minmax", "asinh")


def fit(long: DataFrame, kind: str = "standard", eps: float | None = None, mask: str | None = None) -> DataFrame:
    """(series, kind, centre, spread) of (series, y): a row for each series, by aggregates only.

    standard and asinh: mean (0 where nothing is observed) and population deviation (1 where nothing is observed, ``eps`` where it is 0);
    minmax: least value, and largest less least plus ``eps``.  Positions where the column ``mask`` holds do not count."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}, not {kind!r}")
    y = F.when(~F.isnan("y"), F.col("y"))
    y = y if mask is None else F.when(~F.coalesce(F.col(mask), F.lit(False)), y)
    if kind == "minmax":
        centre, spread = F.min(y), F.max(y) - F.min(y) + (1e-8 if eps is None else eps)
    else:
        deviation = F.coalesce(F.stddev_pop(y), F.lit(1.0))
        centre, spread = F.coalesce(F.avg(y), F.lit(0.0)), F.when(deviation == 0, 1e-5 if eps is None else eps).otherwise(deviation)
    return long.groupBy("series").agg(F.lit(kind).alias("kind"), centre.alias("centre"), spread.alias("spread"))


def _both(kind: Column, plain: Column, bent: Column) -> Column:
    return F.when(kind == "asinh", bent).otherwise(plain)


def transform(rows: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns in units of their series; rows of series that were never fitted have NULL."""
    joined = rows.join(fitted.select("series", "kind", "centre", "spread"), "series", "left")
    unit = lambda c: (F.col(c) - F.col("centre")) / F.col("spread")
    return joined.withColumns({c: _both(F.col("kind"), unit(c), F.asinh(unit(c))) for c in columns}).drop("kind", "centre", "spread")


def inverse(rows: DataFrame, fitted: DataFrame, columns: list[str]) -> DataFrame:
    """The inverse of :func:`transform`; a forecast's quantiles are rows or columns like any other."""
    joined = rows.join(fitted.select("series", "kind", "centre", "spread"), "series", "left")
    back = lambda c: _both(F.col("kind"), F.col(c), F.sinh(c)) * F.col("spread") + F.col("centre")
    return joined.withColumns({c: back(c) for c in columns}).drop("kind", "centre", "spread")
