"""Queries of the rolling evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import forecast, rolling, shape

from .common import GRID, HORIZON, SCORES, SEASON, grid, model_scores, rounded, split

TEST = 72


def variates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means of two columns of the events as two variates of each series."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = [shape.regularize(events, "event_type", "ts", c).withColumn("variate", F.lit(c)) for c in ("value", "user_id")]
    return parts[0].unionByName(parts[1])


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.rolling_windows(variates(spark, sf_dir), TEST, HORIZON, most=480)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.forecast_rows(rolling.forecast(windows(spark, sf_dir), HORIZON, "seasonal_naive", season=SEASON)), 5)


def naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.forecast_rows(rolling.forecast(windows(spark, sf_dir), HORIZON, "naive")), 5)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rolling.forecast(windows(spark, sf_dir), HORIZON, "seasonal_naive", season=SEASON)
    return rounded(rolling.window_metrics(scored, SEASON), 5)


def separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with their windows: one window each, and every series at most once."""
    placed = rolling.scoring_batches(windows(spark, sf_dir), 4)
    return placed.select("series", "variate", "window", F.split("batch_id", "-")[0].cast("int").alias("batch_window"), "cutoff", F.size("context").alias("n_context"))


def pinball_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    context, truth = split(grid(spark, sf_dir))
    return rounded(rolling.wql_pinball(forecast.naive_quantiles(context, HORIZON, rolling.LEVELS), truth))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = model_scores(spark, sf_dir)
    return rolling.union_results(scores.withColumn("run", F.lit(1)), scores.filter("dataset = 'd0'").drop("score"))


def last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rolling.last_steps(forecast.seasonal_naive(grid(spark, sf_dir), HORIZON, SEASON), 5))


def _levels() -> str:
    return ", ".join(f"({q}::DOUBLE, {rolling.z_value(q)!r}::DOUBLE)" for q in rolling.LEVELS)


#: Both variates, their windows, contexts and filled contexts; a gap at a context's beginning takes its first value.
WINDOWS = (
    "WITH ev AS (SELECT event_type || '|value' AS event_type, ts, value FROM events UNION ALL SELECT event_type || '|user_id', ts, user_id::DOUBLE FROM events),\n"
    + GRID.removeprefix("WITH ").replace("FROM events", "FROM ev")
    + f""", w AS (SELECT series, n, CAST(k AS INTEGER) AS "window", CAST(n - {TEST} + k * {HORIZON} AS INTEGER) AS cutoff FROM m, range(0, {TEST // HORIZON}) AS r(k) WHERE n - {TEST} + k * {HORIZON} > 0),
o AS (SELECT series, min(ts) AS start FROM g GROUP BY 1),
c AS (SELECT w.series, "window", cutoff, g.pos, g.y, CASE WHEN count(g.y) OVER (PARTITION BY w.series, "window") > 0 THEN f.y_hat ELSE 0.0 END AS y_hat
  FROM w JOIN g ON g.series = w.series AND g.pos < cutoff AND g.pos >= cutoff - 480 JOIN f ON f.series = g.series AND f.pos = g.pos),
t AS (SELECT w.series, "window", g.pos - cutoff + 1 AS step, g.y FROM w JOIN g ON g.series = w.series AND g.pos >= cutoff AND g.pos < cutoff + {HORIZON}),
z(q, z) AS (VALUES {_levels()})
"""
)
_NAME = "split_part(series, '|', 1) AS series, split_part(series, '|', 2) AS variate"


def _predicted(lag: int) -> str:
    """CTEs sg (deviation) and p (series, window, step, q, y_hat) of the naive forecast with that season."""
    return f""", d AS (SELECT series, "window", cutoff, pos, y_hat, y_hat - lag(y_hat, {lag}) OVER (PARTITION BY series, "window" ORDER BY pos) AS d, min(pos) OVER (PARTITION BY series, "window") AS lo FROM c),
sg AS (SELECT series, "window", any_value(cutoff) AS cutoff, any_value(lo) AS lo, coalesce(sqrt(avg(d * d)), 0) AS sigma FROM d GROUP BY 1, 2),
p AS (SELECT sg.series, sg."window", CAST(k + 1 AS INTEGER) AS step, sg.cutoff, q, c.y_hat + z * sigma * sqrt(k // {lag} + 1) AS y_hat FROM sg CROSS JOIN z CROSS JOIN range(0, {HORIZON}) AS r(k)
  JOIN c ON c.series = sg.series AND c."window" = sg."window" AND c.pos = CASE WHEN sg.cutoff - lo >= {lag} THEN sg.cutoff - {lag} + k % {lag} ELSE sg.cutoff - 1 END)
"""


_ROWS = f'SELECT {_NAME}, "window", step, start + (cutoff + step - 1) * INTERVAL 1 HOUR AS ts, q, round(y_hat, 5) AS y_hat FROM p JOIN o USING (series)'
_NAIVE_PRED = f""", dd AS (SELECT g.series, f.pos, f.y_hat FROM g JOIN m USING (series) JOIN f ON f.series = g.series AND f.pos = g.pos WHERE g.pos < n - {HORIZON}),
df AS (SELECT series, pos, y_hat, y_hat - lag(y_hat) OVER (PARTITION BY series ORDER BY pos) AS d FROM dd),
l AS (SELECT series, max_by(y_hat, pos) AS last, coalesce(sqrt(avg(d * d)), 0) AS sigma FROM df GROUP BY 1),
t AS (SELECT g.series, pos - (n - {HORIZON}) + 1 AS step, y FROM g JOIN m USING (series) WHERE pos >= n - {HORIZON} AND y IS NOT NULL)
"""

QUERIES = {
    "h1_forecast": forecasts,
    "h2_naive_windows": naive,
    "h12_forecast_timestamps": lambda s, d: rolling.forecast_timestamps(windows(s, d), HORIZON),
    "i8_window_metrics": metrics,
    "f10_separate_windows": separate,
    "i13_wql_pinball": pinball_form,
    "j15_union_results": results,
    "j16_best_rows": lambda s, d: rolling.best_rows(model_scores(s, d), "score", 10, "model", "dataset"),
    "j16_last_steps": last,
}

ORACLE_SQL = {
    "h1_forecast": WINDOWS + _predicted(SEASON) + _ROWS,
    "h2_naive_windows": WINDOWS + _predicted(1) + _ROWS,
    "h12_forecast_timestamps": WINDOWS + f'SELECT {_NAME}, "window", CAST(k AS INTEGER) AS step, start + (cutoff + k - 1) * INTERVAL 1 HOUR AS ts FROM w JOIN o USING (series), range(1, {HORIZON + 1}) AS r(k)',
    "i8_window_metrics": WINDOWS
    + _predicted(SEASON)
    + f""", sd AS (SELECT series, "window", abs(y - lag(y, {SEASON}) OVER (PARTITION BY series, "window" ORDER BY pos)) AS d FROM c WHERE y IS NOT NULL),
sc AS (SELECT series, "window", nullif(avg(d), 0) AS scale FROM sd GROUP BY 1, 2),
e AS (SELECT p.series, p."window", p.step, q, y, y_hat, abs(y - y_hat) AS e FROM p JOIN t ON t.series = p.series AND t."window" = p."window" AND t.step = p.step WHERE y IS NOT NULL),
a AS (SELECT series, "window", avg(e * e) AS mse, avg(e) AS mae, avg(e / nullif(abs(y), 0)) AS mape, avg(2 * e / nullif(abs(y) + abs(y_hat), 0)) AS smape, sum(e) / nullif(sum(abs(y)), 0) AS nd FROM e WHERE q = 0.5 GROUP BY 1, 2),
l AS (SELECT series, "window", q, sum(2 * abs((y - y_hat) * (CASE WHEN y_hat >= y THEN 1.0 ELSE 0.0 END - q))) / nullif(sum(abs(y)), 0) AS l FROM e GROUP BY 1, 2, 3),
r AS (SELECT series, "window", avg(l) AS crps FROM l GROUP BY 1, 2)
SELECT {_NAME.replace("series,", "w.series,", 1).replace("(series, '|', 2)", "(w.series, '|', 2)")}, w."window", round(mse, 5) AS mse, round(mae, 5) AS mae, round(sqrt(mse), 5) AS rmse, round(mape, 5) AS mape, round(smape, 5) AS smape, round(mae / scale, 5) AS mase, round(nd, 5) AS nd, round(crps, 5) AS crps
FROM w LEFT JOIN a ON a.series = w.series AND a."window" = w."window" LEFT JOIN r ON r.series = w.series AND r."window" = w."window" LEFT JOIN sc ON sc.series = w.series AND sc."window" = w."window" """,
    "f10_separate_windows": WINDOWS + f'SELECT {_NAME}, "window", "window" AS batch_window, cutoff, least(cutoff, 480) AS n_context FROM w',
    "i13_wql_pinball": GRID + _NAIVE_PRED + f""", z(q, z) AS (VALUES {_levels()}),
e AS (SELECT series, q, y, y - (last + z * sigma * sqrt(step)) AS e FROM l JOIN t USING (series), z),
bl AS (SELECT series, q, 2 * sum(greatest(q * e, (q - 1) * e)) / nullif(sum(abs(y)), 0) AS l FROM e GROUP BY 1, 2)
SELECT series, round(avg(l), 6) AS wql FROM bl GROUP BY 1""",
    "i7_crps": GRID + _NAIVE_PRED + f""", z(q, z) AS (VALUES (0.1::DOUBLE, {rolling.z_value(0.1)!r}::DOUBLE), (0.5, 0.0), (0.9, {rolling.z_value(0.9)!r})),
e AS (SELECT series, q, y, last + z * sigma * sqrt(step) AS y_hat FROM l JOIN t USING (series), z),
bl AS (SELECT series, q, sum(2 * abs((y - y_hat) * (CASE WHEN y_hat >= y THEN 1.0 ELSE 0.0 END - q))) / nullif(sum(abs(y)), 0) AS l FROM e GROUP BY 1, 2)
SELECT series, round(avg(l), 6) AS crps FROM bl GROUP BY 1""",
    "j15_union_results": SCORES + "SELECT model, dataset, score, 1 AS run FROM sc UNION ALL SELECT model, dataset, NULL, NULL FROM sc WHERE dataset = 'd0'",
    "j16_best_rows": SCORES + "SELECT * FROM sc ORDER BY score NULLS LAST, model, dataset LIMIT 10",
    "j16_last_steps": GRID + f"SELECT series, pos - (n - {SEASON}) + 1 AS step, round(y_hat, 6) AS y_hat FROM f JOIN m USING (series) WHERE pos >= n - {SEASON} AND pos - (n - {SEASON}) + 1 > {HORIZON} - 5",
}
