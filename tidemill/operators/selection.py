"""Choosing series and windows: validation, observed contexts, cut-offs, exact hash order for splits and mixtures."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masking import series_seed, uniform

#: Buckets of the hash order: its offsets are one row per group and bucket.
BUCKETS = 4096


def min_length(packed: DataFrame, min_past: int, horizon: int = 0, check: bool = True) -> DataFrame:
    """Items of at least ``min_past + horizon`` values; ValueError if none is left."""
    out = packed.filter(F.size("target") >= min_past + horizon)
    if check and out.isEmpty():
        raise ValueError(f"no series of {min_past + horizon} values or more")
    return out


def validate_levels(levels: list[float], allowed: list[float]) -> None:
    lost = [q for q in levels if not any(abs(q - a) < 1e-9 for a in allowed)]
    if lost or not levels:
        raise ValueError(f"quantile levels {lost or 'missing'}: the model has {allowed}")


def validate_covariates(targets: DataFrame, covariates: DataFrame, horizon: int) -> None:
    """ValueError unless each covariate has exactly the positions of its series' context, or those and ``horizon`` more.

    Inputs: (series, pos) and (series, name, pos); names up to five offending pairs."""
    if horizon < 1:
        raise ValueError("horizon must be positive")
    n = targets.groupBy("series").agg((F.max("pos") + 1).alias("n"))
    have = covariates.groupBy("series", "name").agg(F.count("*").alias("k"), F.min("pos").alias("low"), (F.max("pos") + 1).alias("high"))
    wrong = have.join(n, "series", "left").filter("n is null or low <> 0 or k <> high or (k <> n and k <> n + {0})".format(int(horizon)))
    lost = [(r["series"], r["name"]) for r in wrong.orderBy("series", "name").limit(5).collect()]
    if lost:
        raise ValueError(f"covariates that do not fit their series: {lost}")


def validate_keys(task: dict) -> None:
    """ValueError for a task dictionary without target, with other keys, or with future covariates unknown in the past."""
    if "target" not in task:
        raise ValueError("a task needs a target")
    if other := set(task) - {"target", "past_covariates", "future_covariates"}:
        raise ValueError(f"unknown keys {sorted(other)}")
    if lost := set(task.get("future_covariates") or {}) - set(task.get("past_covariates") or {}):
        raise ValueError(f"future covariates without past values: {sorted(lost)}")


def select_datasets(rows: DataFrame, names: list[str] | None = None, exclude: list[str] = ()) -> DataFrame:
    """Data sets named exactly, less those whose name contains an excluded text."""
    keep = F.col("dataset").isin(names) if names is not None else F.lit(True)
    for text in exclude:
        keep = keep & ~F.col("dataset").contains(text)
    return rows.filter(keep)


def exclude_methods(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Rows whose ``model`` contains none of the texts."""
    keep = F.lit(True)
    for text in parts:
        keep = keep & ~F.col("model").contains(text)
    return rows.filter(keep)


def check_split_lengths(packed: DataFrame, test: int, val: int = 0) -> None:
    """ValueError if test or validation is longer than the shortest series, a warning above its half."""
    least = packed.agg(F.min(F.size("target"))).first()[0] or 0
    for name, n in (("test", test), ("validation", val)):
        if n > least:
            raise ValueError(f"{name} length {n} exceeds the shortest series ({least})")
        if n > least / 2:
            warnings.warn(f"{name} length {n} exceeds half of the shortest series ({least})", stacklevel=2)


def observed_context(long: DataFrame, covariates: DataFrame | None = None):
    """Observed values numbered by ``k`` from 0; with covariates also their values at those positions."""
    seen = long.filter("y is not null").withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy("pos")) - 1)
    return seen if covariates is None else (seen, covariates.join(seen.select("series", "pos", "k"), ["series", "pos"]))


def fill_by_resample(long: DataFrame, seed: int = 42) -> DataFrame:
    """Each missing position takes ``pos_used`` and ``y_hat`` of a drawn observed one of its series; NULL where none is observed."""
    seen = observed_context(long).select("series", "k", F.col("pos").alias("_pos"), F.col("y").alias("_y"))
    n = seen.groupBy("series").agg(F.count("*").alias("_n"))
    draw = F.floor(uniform(seed, "series", "pos") * F.col("_n")).cast("int")
    rows = long.join(n, "series", "left").withColumn("k", F.when(F.col("y").isNull(), draw))
    filled = rows.join(seen, ["series", "k"], "left")
    return filled.select("series", "pos", "y", F.coalesce(F.when(F.col("y").isNotNull(), F.col("pos")), "_pos").alias("pos_used"), F.coalesce("y", "_y").alias("y_hat"))


def keep_observed(pred: DataFrame, observed: DataFrame) -> DataFrame:
    """All quantiles (series, pos, q, y_hat) at an observed position become the observation."""
    seen = observed.filter("y is not null").select("series", "pos", F.col("y").alias("_y"))
    return pred.join(seen, ["series", "pos"], "left").withColumn("y_hat", F.coalesce("_y", "y_hat")).drop("_y")


def _lengths(long: DataFrame) -> DataFrame:
    return long.groupBy("series").agg((F.max("pos") + 1).alias("n"))


def val_windows(long: DataFrame, test_length: int, val_length: int, horizon: int) -> DataFrame:
    """Cut-offs of the validation windows, which lie before the test part."""
    rows = _lengths(long).select("series", "n", F.explode(F.sequence(F.lit(0), F.lit(max(1, val_length // horizon) - 1))).alias("window"))
    return rows.select("series", "window", (F.col("n") - test_length - val_length + F.col("window") * horizon).cast("int").alias("cutoff")).filter("cutoff > 0")


def prefix(long: DataFrame, horizon: int, windows: int) -> DataFrame:
    """Positions before the last ``windows`` horizons: validation's prefix; with one window more, training's."""
    n = F.max("pos").over(Window.partitionBy("series")) + 1
    return long.withColumn("_n", n).filter(F.col("pos") < F.col("_n") - horizon * windows).drop("_n")


def rolling_task_windows(long: DataFrame, horizon: int, num_windows: int, min_context: int = 1, initial_cutoff: int | None = None) -> DataFrame:
    """Cut-offs by ``horizon``: the last ``num_windows``, or as many from ``initial_cutoff``; contexts shorter than
    ``min_context`` and windows beyond the end go."""
    rows = _lengths(long).select("series", "n", F.explode(F.sequence(F.lit(0), F.lit(num_windows - 1))).alias("window"))
    first = F.col("n") - horizon * num_windows if initial_cutoff is None else F.lit(initial_cutoff)
    rows = rows.withColumn("cutoff", (first + F.col("window") * horizon).cast("int"))
    return rows.filter((F.col("cutoff") >= min_context) & (F.col("cutoff") + horizon <= F.col("n"))).select("series", "window", "cutoff")


def cut_context_future(packed: DataFrame, mode: str, context: int, horizon: int, min_past: int = 1, seed: int = 0, key: str = "item_id") -> DataFrame:
    """Adds ``split``, ``context`` (the last values before it) and ``future``.

    TRAIN draws the split from min_past ... n - horizon, VALIDATION takes n - horizon, TEST n without a future; items
    without a split of at least ``min_past`` values go (TEST keeps all)."""
    n = F.size("target")
    if mode == "TRAIN":
        split = min_past + F.floor(uniform(seed, key) * (n - horizon - min_past + 1)).cast("int")
    elif mode in ("VALIDATION", "TEST"):
        split = n - horizon if mode == "VALIDATION" else n
    else:
        raise ValueError(f"unknown mode {mode!r}")
    kept = packed if mode == "TEST" else packed.filter(n >= min_past + horizon)
    out = kept.withColumn("split", split)
    start = F.greatest(F.col("split") - context, F.lit(0))
    out = out.withColumn("context", F.slice("target", start + 1, F.col("split") - start))
    future = F.slice("target", F.col("split") + 1, F.lit(horizon)) if mode != "TEST" else F.lit(None).cast("array<double>")
    return out.withColumn("future", future)


def future_for_cut(rows: DataFrame, cutoffs: DataFrame, horizon: int) -> DataFrame:
    """(series, name, role, step, label, known) after each series' cut-off from (series, name, role, pos, x).

    Targets (role 0) have a label and are not known; known-future covariates (2) are known; past-only ones (1) have neither."""
    after = rows.join(cutoffs.select("series", "cutoff"), "series").withColumn("step", F.col("pos") - F.col("cutoff") + 1).filter(F.col("step").between(1, horizon))
    return after.select("series", "name", "role", "step", F.when(F.col("role") == 0, F.col("x")).alias("label"), F.when(F.col("role") == 2, F.col("x")).alias("known"))


def random_window(packed: DataFrame, most: int, least: int = 64, factor: Column | None = None, seed: int = 0, key: str = "item_id") -> DataFrame:
    """The target's window of a drawn length (``least`` ... ``most``, times ``factor`` for later down-sampling) before a drawn end."""
    n = F.size("target")
    want = F.lit(least) + F.floor(uniform(seed, key) * (most - least + 1)).cast("int")
    length = F.least(n, want * (factor if factor is not None else F.lit(1)))
    end = length + F.floor(uniform(seed + 1, key) * (n - length + 1)).cast("int")
    return packed.withColumn("window_start", end - length).withColumn("target", F.when(n > 0, F.slice("target", end - length + 1, length)).otherwise(F.col("target")))


def hash_order(rows: DataFrame, key: str, group: str | None = None, seed: int = 0) -> DataFrame:
    """Adds ``index`` (0, 1, ... in the order of the keys' draws within ``group``, or over all rows) and ``total``.

    Rows are ranked within hash buckets only, and buckets by their counts, so that a large group is no single task's.  Rows
    of equal keys stand next to each other."""
    rows = rows.withColumn("_group", F.col(group).cast("string") if group else F.lit("")).withColumn("_hash", series_seed(seed, key))
    rows = rows.withColumn("_bucket", F.shiftright("_hash", 48))
    counts = rows.groupBy("_group", "_bucket").agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.select(F.col("_group").alias("_g"), F.col("_bucket").alias("_b"), (F.sum("_c").over(order) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("_group")).alias("total"))
    rank = F.row_number().over(Window.partitionBy("_group", "_bucket").orderBy("_hash", key)) - 1
    joined = rows.withColumn("_rank", rank).join(counts, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("index", F.col("_before") + F.col("_rank")).drop("_group", "_bucket", "_hash", "_g", "_b", "_before", "_rank")


def split_series(rows: DataFrame, fraction: float, key: str = "item_id", seed: int = 0) -> DataFrame:
    """Adds ``is_validation``, true for exactly int(n * fraction) rows."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be in [0, 1]")
    return hash_order(rows, key, seed=seed).withColumn("is_validation", F.col("index") < F.floor(F.col("total") * F.lit(float(fraction)))).drop("index", "total")


def all_missing(long: DataFrame, on: str = "raise") -> DataFrame:
    """Series without any observation: ``raise`` a ValueError naming up to five, or set their values to ``zero``."""
    if on == "zero":
        return long.withColumn("y", F.when(F.count("y").over(Window.partitionBy("series")) == 0, 0.0).otherwise(F.col("y")))
    if on != "raise":
        raise ValueError(f"unknown choice {on!r}")
    lost = [r["series"] for r in long.groupBy("series").agg(F.count("y").alias("n")).filter("n = 0").orderBy("series").limit(5).collect()]
    if lost:
        raise ValueError(f"series without observations: {lost}")
    return long


def restore_missing(pred: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``keys`` that were dropped before a forecast come back with a forecast of 0."""
    return keys.join(pred, on, "left").withColumn("y_hat", F.coalesce("y_hat", F.lit(0.0)))
