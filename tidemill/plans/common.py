"""Inputs that the registered queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import shape

SEASON, HORIZON = 24, 24


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.regularize(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value")


GRID = """WITH h AS (SELECT event_type AS series, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS y FROM events GROUP BY 1, 2),
b AS (SELECT series, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1),
s AS (SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM b),
g AS (SELECT s.series, CAST(row_number() OVER (PARTITION BY s.series ORDER BY s.ts) - 1 AS INTEGER) AS pos, s.ts, h.y FROM s LEFT JOIN h USING (series, ts)),
m AS (SELECT series, max(pos) + 1 AS n FROM g GROUP BY 1),
f AS (SELECT series, pos, y, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY pos ROWS UNBOUNDED PRECEDING),
  first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS y_hat FROM g)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def split(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Context, and the last HORIZON positions as (series, step, y)."""
    rows = long.withColumn("n", F.max("pos").over(Window.partitionBy("series")) + 1)
    cutoff = F.col("n") - HORIZON
    return rows.filter(F.col("pos") < cutoff).drop("n"), rows.filter(F.col("pos") >= cutoff).select("series", (F.col("pos") - cutoff + 1).alias("step"), "y")


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value (as a score) per event type and user group: a table of models over data sets."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    dataset = F.concat(F.lit("d"), F.pmod("user_id", F.lit(7)).cast("string"))
    return events.groupBy(F.col("event_type").alias("model"), dataset.alias("dataset")).agg(F.round(F.avg("value"), 6).alias("score"))


SCORES = "WITH sc AS (SELECT event_type AS model, concat('d', user_id % 7) AS dataset, round(avg(value), 6) AS score FROM events GROUP BY 1, 2)\n"
