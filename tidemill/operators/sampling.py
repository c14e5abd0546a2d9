"""Weighted draws at scale: sources by interval join, series by data set, file and row, resolutions, and training tables.

Draws are heads of MD5s of seed and keys.  A weighted choice is the interval of cumulative weights that a draw falls
into: intervals and draws meet in cells of the unit interval, so neither is ever collected or written out as a chain of conditions.
Choices without replacement are rank cuts, and ranks come from buckets of draws and the buckets' counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import masking, selection, shape

#: Cells of the unit interval in which draws meet intervals: of one set of names, and of each of many.
CELLS, GROUP_CELLS = 1024, 32


def intervals(weights: DataFrame, name: str, weight: str, group: str | None = None) -> DataFrame:
    """Adds ``low`` and ``high``: the share of the unit interval that each ``name`` has, in the order of names, within ``group``.

    Weights that are NULL count as 0; a negative weight, or a group whose weights have no positive sum, is a ValueError."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    own = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    rows = weights.withColumn("_w", w).withColumn("_all", F.sum("_w").over(own))
    bad = rows.filter("_w < 0 or _all <= 0 or isnan(_w)").limit(1).collect()
    if bad or weights.isEmpty():
        raise ValueError("weights must not be negative and must have a positive sum")
    upto = F.sum("_w").over(own.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("high", upto / F.col("_all"))
    below = F.coalesce(F.lag("high").over(own.orderBy(name)), F.lit(0.0))
    # Rounding must leave no gap below 1: the last interval with a weight is open above.
    after = F.sum("_w").over(own.orderBy(F.col(name).desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("low", below).withColumn("high", F.when(F.coalesce(after, F.lit(0.0)) == 0, 2.0).otherwise(F.col("high")))
    return rows.filter("_w > 0").drop("_w", "_all")


def draw_by_weight(draws: DataFrame, u: str, shares: DataFrame, name: str, group: str | None = None) -> DataFrame:
    """``draws`` with the ``name`` whose interval holds the draw ``u`` (in [0, 1)), each within its ``group``."""
    cells = GROUP_CELLS if group else CELLS
    cell = lambda x: F.floor(x * cells).cast("int")
    spread = F.sequence(cell(F.col("low")), F.least(cell(F.col("high")), F.lit(cells - 1)))
    keys = [group] if group else []
    meeting = shares.select(*keys, name, "low", "high", F.explode(spread).alias("_cell"))
    placed = draws.withColumn("_cell", cell(F.col(u)))
    return placed.join(meeting, ["_cell", *keys]).filter((F.col(u) >= F.col("low")) & (F.col(u) < F.col("high"))).drop("_cell", "low", "high")


def sample_mixture(rows: DataFrame, weights: DataFrame, n_batches: int, batch: int, seed: int = 0) -> DataFrame:
    """``n_batches`` batches of ``batch`` rows, each from one ``source`` drawn by ``weight``; adds batch_id and slot.

    The batches of a source go through its rows in the order of their draws and start again at its end.  Every batch of a source without
    rows is left out."""
    if n_batches < 1 or batch < 1:
        raise ValueError("batches must be positive")
    draws = rows.sparkSession.range(n_batches).withColumnRenamed("id", "batch_id").withColumn("_u", masking.uniform(seed, "batch_id"))
    drawn = draw_by_weight(draws, "_u", intervals(weights, "source", "weight"), "source").select("batch_id", "source")
    turns = selection.hash_order(drawn, "batch_id", "source", seed).withColumnRenamed("index", "_turn").drop("total")
    slots = turns.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(batch - 1))))
    placed = selection.hash_order(rows, "item_id", "source", seed + 1)
    totals = placed.groupBy("source").agg(F.max("total").alias("_n"))
    slots = slots.join(totals, "source").withColumn("index", F.pmod(F.col("_turn") * batch + F.col("slot"), F.col("_n")))
    return slots.select("source", "index", "batch_id", "slot").join(placed.drop("total"), ["source", "index"]).drop("index")


def sample_hierarchy(rows: DataFrame, weights: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of (dataset, file, item_id, ...) without replacement: a data set by weight, a file by its rows, a row of it.

    Each of ``n`` draws takes a data set by ``weight`` and one of its files in proportion to the file's rows.  A file then gives as many
    rows as it was drawn, those with the smallest draws; what it lacks comes from the rows that its data set has
    left, in the order of theirs.  A data set gives all its rows at most, so there are fewer than ``n`` only where one is used up.
    """
    if n < 0:
        raise ValueError("n must not be negative")
    files = rows.groupBy("dataset", "file").agg(F.count("*").alias("_rows"))
    known = weights.select("dataset", "weight").join(files.select("dataset").distinct(), "dataset", "left_semi")
    draws = rows.sparkSession.range(n).select(masking.uniform(seed, "id").alias("_u"), masking.uniform(seed + 1, "id").alias("_v"))
    draws = draw_by_weight(draws, "_u", intervals(known, "dataset", "weight"), "dataset")
    draws = draw_by_weight(draws, "_v", intervals(files, "file", "_rows", "dataset"), "file", "dataset")
    wanted = draws.groupBy("dataset", "file").agg(F.count("*").alias("_wanted"))
    lacking = wanted.join(files, ["dataset", "file"]).groupBy("dataset").agg(F.sum(F.greatest(F.col("_wanted") - F.col("_rows"), F.lit(0))).alias("_lacking"))
    keyed = rows.withColumn("_file", F.concat_ws("/", F.col("dataset").cast("string"), F.col("file").cast("string")))
    ranked = selection.hash_order(keyed, "item_id", "_file", seed + 2).withColumnRenamed("index", "_rank").drop("total", "_file")
    ranked = ranked.join(wanted, ["dataset", "file"], "left").withColumn("_taken", F.col("_rank") < F.coalesce("_wanted", F.lit(0)))
    first = ranked.filter("_taken").select(*rows.columns)
    left = selection.hash_order(ranked.filter("not _taken").drop("_rank", "_wanted", "_taken").join(lacking.filter("_lacking > 0"), "dataset"), "item_id", "dataset", seed + 3)
    return first.unionByName(left.filter(F.col("index") < F.col("_lacking")).select(*rows.columns))


def sample_resolution(packed: DataFrame, context: int, least: int | None = None, factors: list[int] | None = None, seed: int = 0, key: str = "item_id") -> DataFrame:
    """Adds ``resolution`` r, one of ``factors`` (1 ... 15) drawn with probability in proportion to 1 / r; ``target`` becomes every r-th
    value of a drawn window of r times ``context`` values (a length drawn from ``least`` ... ``context`` where that is given)."""
    factors = list(range(1, 16)) if factors is None else factors
    if not factors or min(factors) < 1 or context < 1 or least is not None and not 0 < least <= context:
        raise ValueError("factors and lengths must be positive, and least at most the context")
    total = sum(1 / r for r in factors)
    bounds, upto = [], 0.0
    for r in factors:
        upto += 1 / r / total
        bounds.append(upto)
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(b).alias("b")) for r, b in zip(factors, [*bounds[:-1], 2.0])])
    rows = packed.withColumn("_u", masking.uniform(seed, key)).withColumn("resolution", F.get(F.filter(steps, lambda s: F.col("_u") < s["b"]), F.lit(0))["r"])
    rows = selection.random_window(rows.drop("_u"), context, context if least is None else least, F.col("resolution"), seed + 1, key)
    return rows.withColumn("target", F.filter("target", lambda v, i: F.pmod(i, F.col("resolution")) == 0))


def packed_masks(rows: DataFrame, patch: int, most: int, ratio: float, seed: int = 0, key: str = "item_id") -> DataFrame:
    """Adds ``miss_mask``, ``pred_mask`` and ``loss_mask`` to padded rows (target, pad_mask): contiguous patches and a tail, within the row.

    Blocks of a quarter of the context's patches and one more (at most ``most``) fill slots from the left; of those, ``ratio`` of the patches' number are drawn.
    The tail's length is drawn from 0 to four blocks.  Padding is never hidden, and only hidden observed positions count for a loss."""
    n, context = F.size("target"), F.size(F.filter("pad_mask", lambda p: ~p))
    rows = rows.withColumn("_block", masking.adaptive_block_of_context(context, patch, most).cast("int")).withColumn("_patches", F.greatest(F.floor(n / patch), F.lit(1)).cast("int"))
    slots = F.greatest(F.lit(1), F.floor(F.col("_patches") / F.col("_block"))).cast("int")
    wanted = F.least(F.greatest(F.lit(1), F.bround(F.col("_patches") * F.lit(ratio) / F.col("_block"))), slots).cast("int")
    drawn = F.sort_array(F.transform(F.sequence(F.lit(0), slots - 1), lambda s: F.struct(masking.series_seed(seed, F.col(key), s).alias("d"), s.alias("s"))))
    rows = rows.withColumn("_chosen", F.transform(F.slice(drawn, F.lit(1), wanted), lambda x: x["s"]))
    rows = rows.withColumn("_tail", F.pmod(masking.series_seed(seed + 1, key), 4 * F.col("_block") * patch + 1))
    miss = F.transform("target", lambda v, i: v.isNull() & ~F.get("pad_mask", i))
    hit = lambda i: F.array_contains("_chosen", F.floor(F.floor(i / patch) / F.col("_block")).cast("int")) | (i >= n - F.col("_tail"))
    rows = rows.withColumn("miss_mask", miss).withColumn("pred_mask", F.transform("pad_mask", lambda p, i: hit(i) & ~p))
    return rows.withColumn("loss_mask", F.zip_with("pred_mask", "miss_mask", lambda p, m: p & ~m)).drop("_block", "_patches", "_chosen", "_tail")


def training_table(
    packed: DataFrame, weights: DataFrame, n: int, length: int, min_past: int, patch: int = 8, most_patches: int = 6, ratio: float = 0.4, factors: list[int] | None = None, seed: int = 0
) -> DataFrame:
    """(dataset, item_id, resolution, target, pad_mask, miss_mask, pred_mask, loss_mask) of ``n`` drawn items of (dataset, file, item_id, target).

    Items shorter than ``min_past`` go; the rest are drawn by :func:`sample_hierarchy`, cut and down-sampled by :func:`sample_resolution`,
    padded on the left to ``length`` and masked by :func:`packed_masks`.  Behind the draw nothing is shuffled."""
    known = packed.filter(F.size("target") >= min_past)
    drawn = sample_hierarchy(known, weights, n, seed)
    cut = sample_resolution(drawn, length, min(min_past, length), factors, seed + 10)
    rows = packed_masks(shape.left_pad(cut, length), patch, most_patches, ratio, seed + 20)
    return rows.select("dataset", "item_id", "resolution", "target", "pad_mask", "miss_mask", "pred_mask", "loss_mask")
