"""Ranking methods over data sets: frames (model, dataset, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_models(scores: DataFrame) -> DataFrame:
    """Rank 1 is the lowest score of a data set; ties go by model name; a NULL score has no rank."""
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy(F.col("score").asc_nulls_last(), "model"))
    return scores.withColumn("rank", F.when(F.col("score").isNotNull(), rank))


def normalize_by_baseline(scores: DataFrame, baseline: str) -> DataFrame:
    """Scores over the baseline's on the same data set; data sets without a baseline go, a zero baseline gives NULL."""
    base = scores.filter(F.col("model") == baseline).select("dataset", F.col("score").alias("base"))
    return scores.join(base, "dataset").withColumn("ratio", F.try_divide("score", "base"))


def gmean(column: str):
    """Geometric mean over rows with a value; 0 if one is 0."""
    return F.when(F.min(column) == 0, 0.0).otherwise(F.exp(F.avg(F.ln(column))))


def leaderboard(scores: DataFrame, baseline: str) -> DataFrame:
    ranked = rank_models(scores)
    normal = normalize_by_baseline(scores, baseline)
    board = normal.groupBy("model").agg(gmean("ratio").alias("gmean_ratio"))
    kept = ranked.join(normal.select("dataset").distinct(), "dataset", "left_semi").groupBy("model").agg(F.avg("rank").alias("avg_rank"))
    return board.join(kept, "model", "left")


def win_rate(scores: DataFrame) -> DataFrame:
    """Share of data sets in percent on which ``model`` beats ``other``; ties are halves, the diagonal 50."""
    other = scores.select("dataset", F.col("model").alias("other"), F.col("score").alias("theirs"))
    win = F.when(F.col("score") < F.col("theirs"), 1.0).when(F.col("score") == F.col("theirs"), 0.5).otherwise(0.0)
    return scores.join(other, "dataset").groupBy("model", "other").agg((100 * F.avg(win)).alias("win_rate"))
