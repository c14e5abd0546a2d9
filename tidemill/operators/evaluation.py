"""Metrics beyond the per-series point metrics: pooled, interval, scaled-space and masked scores, quantile tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masking import series_seed


def level(q: float) -> Column:
    """Predicate for one quantile level, compared in whole thousandths."""
    return F.round(F.col("q") * 1000).cast("int") == round(q * 1000)


def select_quantiles(pred: DataFrame, levels: list[float]) -> DataFrame:
    return pred.filter(F.round(F.col("q") * 1000).cast("int").isin([round(q * 1000) for q in levels]))


def quantiles_to_columns(pred: DataFrame, levels: list[float]) -> DataFrame:
    """One column per level, named q10, q50, ... (in hundredths), per (series, step)."""
    columns = [F.max(F.when(level(q), F.col("y_hat"))).alias(f"q{round(q * 100)}") for q in levels]
    return pred.groupBy("series", "step").agg(*columns)


def quantiles_to_rows(wide: DataFrame, levels: list[float]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{round(q * 100)}").alias("y_hat")) for q in levels])
    return wide.select("series", "step", F.explode(pairs).alias("p")).select("series", "step", "p.q", "p.y_hat")


def level_keys(pred: DataFrame) -> DataFrame:
    """Adds ``side`` (lo or hi) and ``interval``, the width in percent of the central interval a quantile bounds."""
    width = F.round(200 * (F.greatest("q", 1 - F.col("q")) - 0.5)).cast("int")
    return pred.withColumn("side", F.when(F.col("q") < 0.5, "lo").otherwise("hi")).withColumn("interval", width)


def point_estimate(pred: DataFrame, how: str = "mean") -> DataFrame:
    """(series, step, y_hat): the mean over the levels, or the median (the mean where a step has no 0.5 level)."""
    if how not in ("mean", "median"):
        raise ValueError(f"unknown point estimate {how!r}")
    mean = F.avg("y_hat")
    return pred.groupBy("series", "step").agg((mean if how == "mean" else F.coalesce(F.max(F.when(level(0.5), F.col("y_hat"))), mean)).alias("y_hat"))


def with_fallback(pred: DataFrame, fallback: DataFrame) -> DataFrame:
    """Series with any missing forecast are replaced whole by the fallback's rows."""
    bad = pred.groupBy("series").agg(F.max(F.col("y_hat").isNull() | F.isnan("y_hat")).alias("_bad")).filter("_bad").select("series")
    return pred.join(bad, "series", "left_anti").unionByName(fallback.join(bad, "series", "left_semi"))


def sanitize_forecast(pred: DataFrame) -> DataFrame:
    """Missing forecasts become 0; ``was_missing`` says where."""
    gone = F.col("y_hat").isNull() | F.isnan("y_hat")
    return pred.withColumn("was_missing", gone).withColumn("y_hat", F.when(gone, 0.0).otherwise(F.col("y_hat")))


def pooled_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row over everything with truth: MSE and MAE of the mean and of the 0.5 level, RMSE and NRMSE (over mean |y|) of the
    mean, weighted quantile loss (mean over levels).  Inputs: (series, step, q, y_hat) and (series, step, y)."""
    rows = truth.filter("y is not null").join(pred, ["series", "step"])
    spot = rows.groupBy("series", "step").agg(F.first("y").alias("y"), F.avg("y_hat").alias("mean"), F.max(F.when(level(0.5), F.col("y_hat"))).alias("mid"))
    a, b = F.col("y") - F.col("mean"), F.col("y") - F.col("mid")
    points = spot.agg(
        F.avg(a * a).alias("mse_mean"), F.avg(F.abs(a)).alias("mae_mean"), F.avg(b * b).alias("mse_median"), F.avg(F.abs(b)).alias("mae_median"),
        F.sqrt(F.avg(a * a)).alias("rmse"), F.try_divide(F.sqrt(F.avg(a * a)), F.avg(F.abs("y"))).alias("nrmse"),
    )
    wql = rows.groupBy("q").agg(F.try_divide(F.sum(pinball()), F.sum(F.abs("y"))).alias("l")).agg(F.avg("l").alias("wql"))
    return points.crossJoin(wql)  # one row each


def pinball() -> Column:
    """Twice the quantile loss of ``y_hat`` at level ``q``."""
    return 2 * F.abs((F.col("y") - F.col("y_hat")) * (F.when(F.col("y_hat") >= F.col("y"), 1.0).otherwise(0.0) - F.col("q")))


def weighted_losses(pred: DataFrame, truth: DataFrame, scale: DataFrame, eps: float = 1.0) -> DataFrame:
    """Per series: WAPE of the 0.5 level and WQL with ``eps`` added to the denominators, and the quantile loss over the seasonal error."""
    rows = truth.filter("y is not null").join(pred, ["series", "step"])
    by_level = rows.groupBy("series", "q").agg(F.sum(pinball()).alias("loss"), F.avg(pinball()).alias("mean"), F.sum(F.abs("y")).alias("size"), F.sum(F.abs(F.col("y") - F.col("y_hat"))).alias("error"))
    scores = by_level.groupBy("series").agg(F.max(F.when(level(0.5), F.col("error") / (F.col("size") + eps))).alias("wape"), F.avg(F.col("loss") / (F.col("size") + eps)).alias("wql"), F.avg("mean").alias("_mean"))
    return scores.join(scale, "series", "left").select("series", "wape", "wql", F.try_divide("_mean", "scale").alias("scaled_quantile_loss"))


def interval_scores(pred: DataFrame, truth: DataFrame, scale: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Per series: share of truth within the two levels (bounds included), mean width, and the scaled interval score."""
    wide = quantiles_to_columns(pred, [low, high]).withColumnsRenamed({f"q{round(low * 100)}": "lo", f"q{round(high * 100)}": "hi"})
    rows, alpha = truth.filter("y is not null").join(wide, ["series", "step"]), 1 - (high - low)
    width = F.col("hi") - F.col("lo")
    outside = F.greatest(F.lit(0.0), F.col("lo") - F.col("y")) + F.greatest(F.lit(0.0), F.col("y") - F.col("hi"))
    scores = rows.groupBy("series").agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"), F.avg(width).alias("width"), F.avg(width + outside * (2 / alpha)).alias("_score"))
    return scores.join(scale, "series", "left").select("series", "coverage", "width", F.try_divide("_score", "scale").alias("msis"))


def masked_eval(rows: DataFrame) -> DataFrame:
    """Imputation scores per series over masked positions with truth.  Input: (series, pos, y_true, y_hat, is_masked)."""
    error = F.col("y_true") - F.col("y_hat")
    return rows.filter("is_masked and y_true is not null").groupBy("series").agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.try_divide(F.sum(F.abs(error)), F.sum(F.abs("y_true"))).alias("nd")
    )


def normalized_eval(rows: DataFrame) -> DataFrame:
    """As :func:`masked_eval`, in units of the context's population deviation (positions that are not masked; 1e-5 if it is 0)."""
    spread = F.stddev_pop(F.when(~F.col("is_masked"), F.col("y_true"))).over(Window.partitionBy("series"))
    unit = F.when(spread == 0, 1e-5).otherwise(F.coalesce(spread, F.lit(1.0)))
    scaled = rows.withColumn("_e", (F.col("y_true") - F.col("y_hat")) / unit).filter("is_masked and y_true is not null")
    return scaled.groupBy("series").agg(F.avg(F.abs("_e")).alias("mae"), F.avg(F.col("_e") * F.col("_e")).alias("mse"))


def length_stats(packed: DataFrame, key: str) -> DataFrame:
    n = F.size("target")
    return packed.groupBy(key).agg(F.count("*").alias("n_series"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("avg_length"), F.sum(n).alias("total_length"))


def mixture_weights(sizes: DataFrame, strategy: str = "proportional") -> DataFrame:
    """Adds ``weight``, summing to 1: equal, by ``size``, or by a ``given`` column."""
    columns = {"uniform": F.lit(1.0), "proportional": F.col("size").cast("double"), "given": F.col("given").cast("double")}
    if strategy not in columns:
        raise ValueError(f"unknown strategy {strategy!r}")
    total = sizes.agg(F.sum(columns[strategy]).alias("_total"))
    return sizes.crossJoin(F.broadcast(total)).withColumn("weight", F.try_divide(columns[strategy], F.col("_total"))).drop("_total")  # one row


def corpus_inventory(packed: DataFrame, min_past: int) -> DataFrame:
    """Per data set: series, series of at least ``min_past`` values, values."""
    n = F.size("target")
    return packed.groupBy("dataset").agg(F.count("*").alias("n_series"), F.count_if(n >= min_past).alias("n_valid"), F.sum(n).alias("n_values"))


def dataset_weights(inventory: DataFrame, prefix: Column) -> DataFrame:
    """Adds ``weight``: 0.01 below 100 series, else 1; data sets that share a non-null prefix have 1 together; normalised to sum 1."""
    rows = inventory.withColumn("_prefix", prefix)
    raw = F.when(F.col("_prefix").isNotNull(), 1.0 / F.count("*").over(Window.partitionBy("_prefix"))).when(F.col("n_series") < 100, 0.01).otherwise(1.0)
    rows = rows.withColumn("_raw", raw)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("_raw").alias("_all")))).withColumn("weight", F.col("_raw") / F.col("_all")).drop("_prefix", "_raw", "_all")


def sample_series(packed: DataFrame, weights: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` series without replacement, drawn by data set weight: the smallest exponential keys -ln(u) / weight."""
    u = (F.pmod(series_seed(seed, "dataset", "item_id"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    counts = weights.select("dataset", (F.col("weight") / F.col("n_series")).alias("_w"))
    return packed.join(counts, "dataset").withColumn("_key", -F.ln(u) / F.col("_w")).orderBy("_key", "item_id").limit(n).drop("_key", "_w")


def summary_rows(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """The rows plus two summary rows, ``gmean`` and ``mean``, in the column ``dataset``."""
    gmean = [F.when(F.min(m) == 0, 0.0).otherwise(F.exp(F.avg(F.ln(m)))).alias(m) for m in metrics]
    mean = [F.avg(m).alias(m) for m in metrics]
    base = scores.select("dataset", *metrics)
    return base.unionByName(base.agg(F.lit("gmean").alias("dataset"), *gmean)).unionByName(base.agg(F.lit("mean").alias("dataset"), *mean))


def skill_score(scores: DataFrame, baseline: str, low: float = 0.01, high: float = 100.0) -> DataFrame:
    """1 - geometric mean of the scores over the baseline's, each ratio clipped to [low, high]."""
    base = scores.filter(F.col("model") == baseline).select("dataset", F.col("score").alias("_base"))
    ratio = F.least(F.greatest(F.try_divide("score", "_base"), F.lit(low)), F.lit(high))
    return scores.join(base, "dataset").groupBy("model").agg((1 - F.exp(F.avg(F.ln(ratio)))).alias("skill"))


def top_methods(wins: DataFrame, k: int) -> DataFrame:
    """The ``k`` models with the highest mean win rate (a top-k report); ties, to nine digits, go by name."""
    return wins.groupBy("model").agg(F.avg("win_rate").alias("mean_win_rate")).orderBy(F.round("mean_win_rate", 9).desc(), "model").limit(k)


def score_series(long: DataFrame, fn: Callable, schema: str, key: str = "series") -> DataFrame:
    """Apply ``fn(pandas frame of one series, ordered by pos)`` to every series; bound contexts first (``last_context``)."""
    return long.groupBy(key).applyInPandas(lambda group: fn(group.sort_values("pos", ignore_index=True)), schema)
