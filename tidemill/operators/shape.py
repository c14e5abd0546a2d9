"""Series on a regular grid: long frames (series, pos, ts, y) with NULL for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def observed(column: str):
    """NaN means missing, as NULL does."""
    return F.when(~F.isnan(column), F.col(column))


def regularize(events: DataFrame, series: str, ts: str, value: str, unit: str = "hour") -> DataFrame:
    """Mean value per series and time unit; units without events are rows with NULL."""
    spot = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    means = events.select(F.col(series).alias("series"), spot.alias("ts"), observed(value).alias("v")).groupBy("series", "ts").agg(F.avg("v").alias("y"))
    # One shuffle by series: each unit with events brings the empty ones up to the next.
    own = Window.partitionBy("series")
    rows = means.withColumn("_next", F.lead("ts").over(own.orderBy("ts"))).withColumn("_low", F.min("ts").over(own))
    spread = F.sequence(F.col("ts"), F.coalesce(F.col("_next") - F.expr(f"interval 1 {unit}"), F.col("ts")), F.expr(f"interval 1 {unit}"))
    rows = rows.select("series", "_low", F.col("ts").alias("_ts"), "y", F.posexplode(spread).alias("_k", "ts"))
    pos = (F.expr(f"timestampdiff({unit}, _low, _ts)") + F.col("_k")).cast("int")
    return rows.select("series", pos.alias("pos"), "ts", F.when(F.col("_k") == 0, F.col("y")).alias("y"))


def time_grid(long: DataFrame) -> DataFrame:
    """Equally spaced coordinates in [0, 1]."""
    n = F.count("*").over(Window.partitionBy("series"))
    return long.withColumn("coord", F.when(n > 1, F.col("pos") / (n - 1)).otherwise(F.lit(0.0)))


def last_context(long: DataFrame, n: int) -> DataFrame:
    last = F.max("pos").over(Window.partitionBy("series"))
    return long.filter("true").withColumn("_last", last).filter(F.col("pos") > F.col("_last") - n).drop("_last")


def pack_series(long: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "y")))
    return long.groupBy("series").agg(F.min("ts").alias("start"), F.transform(ordered, lambda s: s["y"]).alias("target"))


def unpack_series(packed: DataFrame, unit: str = "hour") -> DataFrame:
    rows = packed.select("series", "start", F.posexplode("target").alias("pos", "y"))
    return rows.select("series", "pos", F.expr(f"start + pos * interval 1 {unit}").alias("ts"), "y")


def left_pad(packed: DataFrame, length: int) -> DataFrame:
    """The last ``length`` values, with NULL on the left of shorter series, and their pad flags."""
    kept = F.slice("target", F.greatest(F.size("target") - length + 1, F.lit(1)), length)
    pads = F.greatest(F.lit(length) - F.size("target"), F.lit(0))
    return packed.withColumn("pad_mask", F.concat(F.array_repeat(F.lit(True), pads), F.transform(kept, lambda _: F.lit(False)))).withColumn(
        "target", F.concat(F.array_repeat(F.lit(None).cast("double"), pads), kept)
    )


def downsample(packed: DataFrame, stride: int) -> DataFrame:
    return packed.withColumn("target", F.filter("target", lambda v, i: i % stride == 0))


def interleave_split(long: DataFrame, parts: int = 2) -> DataFrame:
    return long.withColumn("sub", F.pmod("pos", F.lit(parts))).withColumn("pos", F.floor(F.col("pos") / parts).cast("int"))
