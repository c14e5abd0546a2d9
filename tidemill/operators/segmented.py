"""Fills, islands, grids and scaling of long series, block by block.

A series is cut into blocks of positions.  What a block needs of the rest of its series is little: the nearest observed
value before and after it, or sums over all blocks.  That comes from one row for each block (aggregated before any
shuffle) and a running maximum or sum over those, and joins the block as rows of its own, its ghosts.  Then a window
over the block gives what a window over the series would, and no task ever holds more of a series than one block and
one row for each of its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 1 << 17


def _blocks(long: DataFrame, size: int) -> DataFrame:
    if size < 1:
        raise ValueError("a block must have positions")
    return long.withColumn("_block", F.floor(F.col("pos") / size))


def _neighbours(rows: DataFrame, *lane: str) -> DataFrame:
    """(series, _block, pos, y): for each block the nearest observed position before and after it, within each lane."""
    spot = F.when(F.col("y").isNotNull(), F.struct("pos", "y"))
    each = rows.groupBy("series", *lane, "_block").agg(F.max(spot).alias("_last"), F.min(spot).alias("_first"))
    own = Window.partitionBy("series", *lane)
    before = F.max("_last").over(own.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("_first").over(own.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("_before", before).withColumn("_after", after)
    ghosts = each.select("series", "_block", F.explode(F.array("_before", "_after")).alias("g")).filter("g is not null")
    return ghosts.select("series", "_block", "g.pos", "g.y")


def with_ghosts(rows: DataFrame, ghosts: DataFrame) -> DataFrame:
    """``rows`` and ``ghosts`` (told apart by ``_ghost``); what ghosts lack is NULL."""
    return rows.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True)), allowMissingColumns=True)


def _in_block() -> tuple:
    """From the block's begin to a row, and from its end back to it; both are gone through once, which a frame from a row to the end is not."""
    own = Window.partitionBy("series", "_block")
    return tuple(own.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow) for order in (F.col("pos"), F.col("pos").desc()))


def totals(rows: DataFrame) -> DataFrame:
    """(series, _block, _n, _observed, _mean, _var, _low, _high, _end) of the whole series, a row for each block.

    Deviations are merged from those of the blocks about their own means, so that large values lose no digits."""
    each = rows.groupBy("series", "_block").agg(
        F.count("*").alias("n"), F.count("y").alias("k"), F.avg("y").alias("m"), F.var_pop("y").alias("v"), F.min("y").alias("low"), F.max("y").alias("high"), F.max("pos").alias("end")
    )
    own = Window.partitionBy("series")
    each = each.withColumn("_mean", F.try_divide(F.sum(F.col("k") * F.col("m")).over(own), F.sum("k").over(own)))
    spread = F.sum(F.col("k") * (F.col("v") + (F.col("m") - F.col("_mean")) * (F.col("m") - F.col("_mean")))).over(own)
    return each.select(
        "series", "_block", F.sum("n").over(own).alias("_n"), F.sum("k").over(own).alias("_observed"), "_mean", F.try_divide(spread, F.sum("k").over(own)).alias("_var"),
        F.min("low").over(own).alias("_low"), F.max("high").over(own).alias("_high"), F.max("end").over(own).alias("_end"),
    )


def _told(long: DataFrame, size: int, *names: str) -> DataFrame:
    """``long`` with the named totals of each row's series."""
    rows = _blocks(long, size)
    whole = Window.partitionBy("series", "_block")
    both = with_ghosts(rows, totals(rows).select("series", "_block", *names))
    return both.withColumns({c: F.max(c).over(whole) for c in names}).filter("not _ghost").drop("_ghost", "_block")


def impute(long: DataFrame, method: str = "linear", season: int | None = None, block: int = BLOCK) -> DataFrame:
    """As :func:`missing.impute`, with the same values, for series of any length.  ``pos`` is whole numbers on a regular grid."""
    y = F.col("y")
    if method == "zero":
        return long.withColumn("y_hat", F.when(F.abs(y) == float("inf"), 0.0).otherwise(F.coalesce(y, F.lit(0.0))))
    if method == "mean":
        return _told(long, block, "_mean").withColumn("y_hat", F.coalesce(y, "_mean", F.lit(0.0))).drop("_mean")
    if method not in ("locf", "linear", "seasonal"):
        raise ValueError(f"unknown method {method!r}")
    if method == "seasonal" and not season:
        raise ValueError("seasonal imputation needs a season")
    rows = _blocks(long, block)
    ghosts = _neighbours(rows)
    if method == "seasonal":
        ghosts = ghosts.unionByName(_neighbours(rows.withColumn("_lane", F.pmod("pos", F.lit(season))), "_lane"))
    both = with_ghosts(rows, ghosts)
    back, ahead = _in_block()
    spot = F.when(y.isNotNull(), F.struct(F.col("pos").alias("p"), y.alias("v")))
    a, b = F.last(spot, True).over(back), F.last(spot, True).over(ahead)
    if method == "linear":
        value = F.coalesce(y, a["v"] + (b["v"] - a["v"]) * (F.col("pos") - a["p"]) / (b["p"] - a["p"]), a["v"], b["v"], F.lit(0.0))
    else:
        value = F.coalesce(y, a["v"], b["v"], F.lit(0.0))
    if method == "seasonal":
        lane = Window.partitionBy("series", "_block", F.pmod("pos", F.lit(season))).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        value = F.coalesce(y, F.last(y, True).over(lane), value)
    return both.withColumn("y_hat", value).filter("not _ghost").drop("_ghost", "_block")


def gap_islands(long: DataFrame, block: int = BLOCK) -> DataFrame:
    """As :func:`missing.gap_islands` on a regular grid: the gaps of one observed position's wake are one island."""
    rows = _blocks(long, block)
    back, _ = _in_block()
    seen = F.last(F.when(F.col("y").isNotNull(), F.col("pos")), True).over(back)
    gaps = with_ghosts(rows, _neighbours(rows)).withColumn("_seen", seen).filter("not _ghost and y is null")
    return gaps.groupBy("series", "_seen").agg(F.min("pos").alias("gap_start"), F.max("pos").alias("gap_end"), F.count("*").alias("gap_len")).drop("_seen")


def time_grid(long: DataFrame, block: int = BLOCK) -> DataFrame:
    """As :func:`shape.time_grid`."""
    return _told(long, block, "_n").withColumn("coord", F.when(F.col("_n") > 1, F.col("pos") / (F.col("_n") - 1)).otherwise(F.lit(0.0))).drop("_n")


def last_context(long: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """As :func:`shape.last_context`."""
    return _told(long, block, "_end").filter(F.col("pos") > F.col("_end") - n).drop("_end")


def standard_scale(long: DataFrame, eps: float = 1e-5, block: int = BLOCK) -> DataFrame:
    """As :func:`scaling.standard_scale`."""
    rows = _told(long, block, "_mean", "_var").withColumn("centre", F.coalesce("_mean", F.lit(0.0)))
    spread = F.coalesce(F.sqrt("_var"), F.lit(1.0))
    return rows.withColumn("spread", F.when(spread == 0, eps).otherwise(spread)).withColumn("scaled", (F.col("y") - F.col("centre")) / F.col("spread")).drop("_mean", "_var")


def minmax_scale(long: DataFrame, block: int = BLOCK) -> DataFrame:
    """As :func:`scaling.minmax_scale`."""
    return _told(long, block, "_low", "_high").withColumn("scaled", (F.col("y") - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-8)).drop("_low", "_high")


def compacted(long: DataFrame, block: int = BLOCK) -> DataFrame:
    """The observed rows, numbered from 0 in their series' order by ``k``."""
    rows = _blocks(long.filter("y is not null"), block)
    each = rows.groupBy("series", "_block").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The count so far is the block's one ghost, which stands before its rows.
    both = with_ghosts(rows, each.withColumn("_before", before).select("series", "_block", "_before"))
    own = Window.partitionBy("series", "_block").orderBy(F.col("_ghost").desc(), "pos")
    first = F.max("_before").over(Window.partitionBy("series", "_block"))
    return both.withColumn("_row", F.row_number().over(own)).withColumn("k", first + F.col("_row") - 2).filter("not _ghost").drop("_ghost", "_block", "_before", "_row")


def seasonal_error(context: DataFrame, season: int, block: int = BLOCK) -> DataFrame:
    """As :func:`forecast.seasonal_error`: gaps are closed first.  Each block of the closed series also gets the last ``season``
    values of the one before it."""
    size = max(block, season)
    rows = compacted(context, block).select("series", "k", "y").withColumn("_block", F.floor(F.col("k") / size))
    # Rows near a block's end are also the next one's ghosts.
    halo = F.when(F.pmod("k", F.lit(size)) >= size - season, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))
    both = rows.select("series", "k", "y", F.col("_block").alias("_own"), F.explode(halo).alias("_block"))
    lagged = F.lag("y", season).over(Window.partitionBy("series", "_block").orderBy("k"))
    d = both.withColumn("d", F.when(F.col("_own") == F.col("_block"), F.abs(F.col("y") - lagged)))
    return d.groupBy("series").agg(F.nullif(F.avg("d"), F.lit(0.0)).alias("scale"))


def running(long: DataFrame, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the running sum of ``value`` along each series; NULL counts as 0."""
    rows = _blocks(long, block).withColumn("_v", F.coalesce(value, F.lit(0.0)))
    each = rows.groupBy("series", "_block").agg(F.sum("_v").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    both = with_ghosts(rows, each.select("series", "_block", before.alias("_v")))
    along = Window.partitionBy("series", "_block").orderBy(F.col("_ghost").desc(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.sum("_v").over(along)).filter("not _ghost").drop("_ghost", "_block", "_v")
