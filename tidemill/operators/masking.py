"""Masks for imputation scenarios and training: draws are hashes of the keys, so they never depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def series_seed(seed: int, *keys: str | Column) -> Column:
    """A draw of 60 bits of its own for each combination of keys: the head of an MD5, which SQL engines share; NULL keys are left out."""
    texts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *texts)), 1, 15), 16, 10).cast("bigint")


def uniform(seed: int, *keys: str | Column) -> Column:
    """A draw in [0, 1)."""
    return F.pmod(series_seed(seed, *keys), F.lit(1 << 31)) / F.lit(float(1 << 31))


def default_scenarios(spark: SparkSession, context: int) -> DataFrame:
    """(scenario, n_blocks, block_size, ratio): one or two blocks of a fifteenth of the context; half or 70 % of the points."""
    rows = [("one_block", 1, context // 15, 0.0), ("two_blocks", 2, context // 15, 0.0), ("points_50", 0, 0, 0.5), ("points_70", 0, 0, 0.7)]
    return spark.createDataFrame(rows, "scenario string, n_blocks int, block_size int, ratio double")


def mask_blocks(long: DataFrame, n_blocks: int, block_size: int, seed: int = 0) -> DataFrame:
    """Marks ``n_blocks`` blocks per series: starts in the order of their draws, each that overlaps none before it.
    Where fewer fit, blocks may overlap; a series shorter than a block is masked whole."""
    if n_blocks < 1 or block_size < 1:
        raise ValueError("blocks must be positive")
    n = long.groupBy("series").agg((F.max("pos") + 1).cast("int").alias("n"))
    tries = F.sequence(F.lit(0), F.lit(100 * n_blocks - 1))
    last = F.greatest(F.col("n") - block_size, F.lit(0))
    starts = F.transform(tries, lambda k: F.pmod(series_seed(seed, "series", k), last + 1).cast("int"))
    apart = lambda taken, s: F.forall(taken, lambda t: F.abs(t - s) >= block_size)
    step = lambda taken, s: F.when((F.size(taken) < n_blocks) & apart(taken, s), F.concat(taken, F.array(s))).otherwise(taken)
    placed = n.withColumn("tries", starts).withColumn("taken", F.aggregate("tries", F.array().cast("array<int>"), step))
    placed = placed.withColumn("taken", F.concat("taken", F.slice("tries", 1, F.lit(n_blocks) - F.size("taken"))))
    inside = F.exists("taken", lambda s: (F.col("pos") >= s) & (F.col("pos") < s + block_size))
    return long.join(placed.select("series", "taken"), "series").withColumn("is_masked", inside).drop("taken")


def mask_mixed(long: DataFrame, n_blocks: int, block_size: int, ratio: float, seed: int = 0) -> DataFrame:
    """Blocks, then max(1, round-half-even(ratio * n)) of the positions still unmasked."""
    rows = mask_blocks(long, n_blocks, block_size, seed)
    order = Window.partitionBy("series", "is_masked").orderBy(series_seed(seed + 1, "series", "pos"), "pos")
    more = F.greatest(F.lit(1), F.bround(F.lit(ratio) * F.count("*").over(Window.partitionBy("series"))))
    return rows.withColumn("is_masked", F.col("is_masked") | (F.row_number().over(order) <= more))


def mask_bernoulli(long: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Independent draws; a series without any gets one position."""
    drawn = long.withColumn("is_masked", uniform(seed, "series", "pos") < p)
    first = F.row_number().over(Window.partitionBy("series").orderBy(series_seed(seed, "series", "pos"), "pos")) == 1
    some = F.max("is_masked").over(Window.partitionBy("series"))
    return drawn.withColumn("is_masked", F.col("is_masked") | (~some & first))


def mask_contiguous_patches(long: DataFrame, patch: int, n_patches: int, ratio: float, seed: int = 0) -> DataFrame:
    """Slots of ``n_patches`` patches of ``patch`` positions: max(1, round(P * ratio / n_patches)) whole slots, where P is the
    series' number of patches; a series without a whole slot is masked whole."""
    size = patch * n_patches
    n = F.max("pos").over(Window.partitionBy("series")) + 1
    rows = long.withColumn("_slots", F.floor(n / size)).withColumn("_slot", F.floor(F.col("pos") / size)).withColumn("_p", F.floor(n / patch))
    order = Window.partitionBy("series").orderBy(series_seed(seed, "series", "_slot"), "_slot")
    slots = rows.filter("_slot < _slots").select("series", "_slot", "_slots", "_p").distinct().withColumn("_rank", F.row_number().over(order))
    wanted = F.greatest(F.lit(1), F.bround(F.col("_p") * ratio / n_patches))
    chosen = slots.filter(F.col("_rank") <= wanted).select("series", "_slot", F.lit(True).alias("_hit"))
    marked = rows.join(chosen, ["series", "_slot"], "left").withColumn("is_masked", F.coalesce("_hit", F.col("_slots") == 0))
    return marked.drop("_slot", "_slots", "_p", "_hit")


def adaptive_block(n_valid: Column, most: int) -> Column:
    """Patches per slot: a quarter of the valid ones, rounded up, at most ``most``."""
    return F.least(F.ceil(n_valid / 4), F.lit(most))


def adaptive_block_of_context(context: Column, patch: int, most: int) -> Column:
    """Patches per slot from a context length: a quarter of its patches and one more, between 1 and ``most``."""
    return F.greatest(F.lit(1), F.least(F.floor(F.ceil(context / patch) / 4) + 1, F.lit(most)))


def mask_tail(long: DataFrame, patch: int, n_patches: int, seed: int = 0) -> DataFrame:
    """Marks a tail whose length is drawn from [0, 4 * n_patches * patch) for each series."""
    n = F.max("pos").over(Window.partitionBy("series")) + 1
    return long.withColumn("is_tail", F.col("pos") >= n - F.pmod(series_seed(seed, "series"), F.lit(4 * n_patches * patch)))


def training_masks(rows: DataFrame) -> DataFrame:
    """``pred_mask`` and ``loss_mask`` from is_masked, is_tail, pad_mask and miss_mask."""
    rows = rows.withColumn("pred_mask", (F.col("is_masked") | F.col("is_tail")) & ~F.col("pad_mask"))
    return rows.withColumn("loss_mask", F.col("pred_mask") & ~F.col("pad_mask") & ~F.col("miss_mask"))


def apply_scenario(masked: DataFrame, values: DataFrame) -> DataFrame:
    """(series, variate, pos, y_true, y_masked, is_masked): one mask in time for every variate of a series."""
    return values.join(masked.select("series", "pos", "is_masked"), ["series", "pos"]).select(
        "series", "variate", "pos", F.col("y").alias("y_true"), F.when(~F.col("is_masked"), F.col("y")).alias("y_masked"), "is_masked"
    )
