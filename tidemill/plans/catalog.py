"""Registered queries of the time-series engine and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import forecast, leaderboard, missing, scaling, shape

from . import calendars, draws, fits, more, reconstruct, rolling, samples, wider
from .common import GRID, HORIZON, SCORES, SEASON, grid, model_scores, rounded, split


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means, last day held out, seasonal naive forecast, accuracy per series."""
    context, truth = split(grid(spark, sf_dir))
    pred = forecast.seasonal_naive(context, HORIZON, SEASON)
    return rounded(forecast.point_metrics(pred, truth, forecast.seasonal_error(context, SEASON)))


FLAGSHIP_SQL = GRID + f""", c AS (SELECT g.* FROM g JOIN m USING (series) WHERE pos < n - {HORIZON}),
t AS (SELECT g.series, pos - (n - {HORIZON}) + 1 AS step, y FROM g JOIN m USING (series) WHERE pos >= n - {HORIZON}),
cf AS (SELECT series, pos, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY pos ROWS UNBOUNDED PRECEDING),
  first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS y_hat FROM c),
p AS (SELECT series, pos - (n - {HORIZON} - {SEASON}) + 1 AS step, y_hat FROM cf JOIN m USING (series) WHERE pos >= n - {HORIZON} - {SEASON}),
d AS (SELECT series, abs(y - lag(y, {SEASON}) OVER (PARTITION BY series ORDER BY pos)) AS d FROM c WHERE y IS NOT NULL),
z AS (SELECT series, nullif(avg(d), 0) AS scale FROM d GROUP BY 1),
e AS (SELECT series, y, y_hat, abs(y - y_hat) AS e FROM t JOIN p USING (series, step))
SELECT series, round(avg(e * e), 6) AS mse, round(avg(e), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e / nullif(abs(y), 0)), 6) AS mape,
  round(avg(2 * e / nullif(abs(y) + abs(y_hat), 0)), 6) AS smape, round(sum(e) / nullif(sum(abs(y)), 0), 6) AS nd, round(avg(e) / any_value(scale), 6) AS mase
FROM e LEFT JOIN z USING (series) GROUP BY series"""


def crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    context, truth = split(grid(spark, sf_dir))
    return rounded(forecast.quantile_loss(forecast.naive_quantiles(context, HORIZON), truth))


def _fill(method: str, season: int | None = None):
    return lambda spark, d: rounded(missing.impute(grid(spark, d), method, season).select("series", "pos", "y_hat"))


QUERIES = {
    "seasonal_naive_eval": flagship,
    "b12_regularize": lambda s, d: rounded(grid(s, d)),
    "b10_time_grid": lambda s, d: rounded(shape.time_grid(grid(s, d)).select("series", "pos", "coord")),
    "b11_last_context": lambda s, d: rounded(shape.last_context(grid(s, d), 48)),
    "b1_b2_pack_unpack": lambda s, d: rounded(shape.unpack_series(shape.pack_series(grid(s, d)))),
    "b13_interleave_split": lambda s, d: rounded(shape.interleave_split(grid(s, d)).select("series", "sub", "pos", "y")),
    "f8_b20_downsample_pad": lambda s, d: shape.left_pad(shape.downsample(s.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "transform(embedding, v -> cast(v as double)) as target"), 8), 12).selectExpr("vec_id", "size(filter(pad_mask, x -> x)) as pads", "round(target[11], 6) as last_value"),
    "d3_fill_linear": _fill("linear"),
    "d4_fill_locf": _fill("locf"),
    "d5_fill_mean": _fill("mean"),
    "d6_fill_zero": _fill("zero"),
    "d10_fill_seasonal": _fill("seasonal", SEASON),
    "d9_gap_islands": lambda s, d: missing.gap_islands(grid(s, d)),
    "d12_missing_summary": lambda s, d: rounded(missing.missing_summary(grid(s, d))),
    "f1_test_windows": lambda s, d: forecast.test_windows(grid(s, d), 100, HORIZON),
    "g1_standard_scale": lambda s, d: rounded(scaling.standard_scale(grid(s, d)).select("series", "pos", "scaled")),
    "g2_minmax_scale": lambda s, d: rounded(scaling.minmax_scale(grid(s, d)).select("series", "pos", "scaled")),
    "g4_asinh": lambda s, d: rounded(scaling.asinh_scale(grid(s, d)).select("series", "pos", "scaled")),
    "h2_naive": lambda s, d: rounded(forecast.naive_quantiles(grid(s, d), HORIZON), 5),
    "h3_seasonal_naive": lambda s, d: rounded(forecast.seasonal_naive(grid(s, d), HORIZON, SEASON)),
    "i7_crps": crps,
    "j2_rank_models": lambda s, d: leaderboard.rank_models(model_scores(s, d)),
    "j3_normalize_by_baseline": lambda s, d: rounded(leaderboard.normalize_by_baseline(model_scores(s, d), "click")),
    "j6_leaderboard": lambda s, d: rounded(leaderboard.leaderboard(model_scores(s, d), "click")),
    "j9_win_rate": lambda s, d: rounded(leaderboard.win_rate(model_scores(s, d))),
}

_BACK = "OVER (PARTITION BY series ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_AHEAD = "OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"

ORACLE_SQL = {
    "seasonal_naive_eval": FLAGSHIP_SQL,
    "b12_regularize": GRID + "SELECT series, pos, ts, round(y, 6) AS y FROM g",
    "b10_time_grid": GRID + "SELECT series, pos, round(pos / (n - 1), 6) AS coord FROM g JOIN m USING (series)",
    "b11_last_context": GRID + "SELECT series, pos, ts, round(y, 6) AS y FROM g JOIN m USING (series) WHERE pos >= n - 48",
    "b1_b2_pack_unpack": GRID + "SELECT series, pos, ts, round(y, 6) AS y FROM g",
    "b13_interleave_split": GRID + "SELECT series, pos % 2 AS sub, pos // 2 AS pos, round(y, 6) AS y FROM g",
    "f8_b20_downsample_pad": "SELECT vec_id, 12 - (len(embedding) + 7) // 8 AS pads, round(embedding[((len(embedding) - 1) // 8) * 8 + 1]::DOUBLE, 6) AS last_value FROM embeddings",
    "d3_fill_linear": GRID + f""", x AS (SELECT series, pos, y, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) {_BACK} AS p0, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) {_AHEAD} AS p1,
  last_value(y IGNORE NULLS) {_BACK} AS v0, first_value(y IGNORE NULLS) {_AHEAD} AS v1 FROM g)
SELECT series, pos, round(coalesce(y, v0 + (v1 - v0) * (pos - p0) / (p1 - p0), v0, v1, 0.0), 6) AS y_hat FROM x""",
    "d4_fill_locf": GRID + "SELECT series, pos, round(y_hat, 6) AS y_hat FROM f",
    "d5_fill_mean": GRID + "SELECT series, pos, round(coalesce(y, avg(y) OVER (PARTITION BY series), 0.0), 6) AS y_hat FROM g",
    "d6_fill_zero": GRID + "SELECT series, pos, round(coalesce(y, 0.0), 6) AS y_hat FROM g",
    "d10_fill_seasonal": GRID + f"SELECT series, pos, round(coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY series, pos % {SEASON} ORDER BY pos ROWS UNBOUNDED PRECEDING), y_hat), 6) AS y_hat FROM f",
    "d9_gap_islands": GRID + ", i AS (SELECT series, pos, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS k FROM g WHERE y IS NULL) SELECT series, min(pos) AS gap_start, max(pos) AS gap_end, count(*) AS gap_len FROM i GROUP BY series, k",
    "d12_missing_summary": GRID + "SELECT series, count(*) AS n, count(*) FILTER (WHERE y IS NULL) AS n_missing, round(avg(CASE WHEN y IS NULL THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM g GROUP BY series",
    "f1_test_windows": GRID + f"SELECT series, CAST(w AS INTEGER) AS \"window\", CAST(n - 100 + w * {HORIZON} AS INTEGER) AS cutoff FROM m, range(0, {100 // HORIZON}) AS r(w) WHERE n - 100 + w * {HORIZON} > 0",
    "g1_standard_scale": GRID + "SELECT series, pos, round((y - avg(y) OVER w) / CASE WHEN stddev_pop(y) OVER w = 0 THEN 1e-5 ELSE stddev_pop(y) OVER w END, 6) AS scaled FROM g WINDOW w AS (PARTITION BY series)",
    "g2_minmax_scale": GRID + "SELECT series, pos, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w + 1e-8), 6) AS scaled FROM g WINDOW w AS (PARTITION BY series)",
    "g4_asinh": GRID + "SELECT series, pos, round(asinh((y - avg(y) OVER w) / CASE WHEN stddev_pop(y) OVER w = 0 THEN 1e-5 ELSE stddev_pop(y) OVER w END), 6) AS scaled FROM g WINDOW w AS (PARTITION BY series)",
    "h2_naive": GRID + f""", d AS (SELECT series, pos, y_hat, y_hat - lag(y_hat) OVER (PARTITION BY series ORDER BY pos) AS d FROM f),
l AS (SELECT series, max_by(y_hat, pos) AS last, coalesce(sqrt(avg(d * d)), 0) AS sigma FROM d GROUP BY 1),
z(q, z) AS (VALUES (0.1::DOUBLE, -1.2815515655446004::DOUBLE), (0.5, 0.0), (0.9, 1.2815515655446004))
SELECT series, CAST(k AS INTEGER) AS step, q, round(last + z * sigma * sqrt(k), 5) AS y_hat FROM l, z, range(1, {HORIZON + 1}) AS r(k)""",
    "h3_seasonal_naive": GRID + f"SELECT series, pos - (n - {SEASON}) + 1 AS step, round(y_hat, 6) AS y_hat FROM f JOIN m USING (series) WHERE pos >= n - {SEASON}",
    "j2_rank_models": SCORES + "SELECT model, dataset, score, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY dataset ORDER BY score NULLS LAST, model) END AS rank FROM sc",
    "j3_normalize_by_baseline": SCORES + "SELECT a.dataset, a.model, a.score, b.score AS base, round(a.score / nullif(b.score, 0), 6) AS ratio FROM sc a JOIN sc b ON a.dataset = b.dataset AND b.model = 'click'",
    "j6_leaderboard": SCORES + """, n AS (SELECT a.dataset, a.model, a.score / nullif(b.score, 0) AS ratio FROM sc a JOIN sc b ON a.dataset = b.dataset AND b.model = 'click'),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score NULLS LAST, model) AS rank FROM sc),
g AS (SELECT model, exp(avg(ln(ratio))) AS gmean_ratio FROM n GROUP BY 1), k AS (SELECT model, avg(rank) AS avg_rank FROM r WHERE dataset IN (SELECT dataset FROM n) GROUP BY 1)
SELECT model, round(gmean_ratio, 6) AS gmean_ratio, round(avg_rank, 6) AS avg_rank FROM g LEFT JOIN k USING (model)""",
    "j9_win_rate": SCORES + "SELECT a.model, b.model AS other, round(100 * avg(CASE WHEN a.score < b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS win_rate FROM sc a JOIN sc b ON a.dataset = b.dataset GROUP BY 1, 2",
}

QUERIES |= more.QUERIES | wider.QUERIES | rolling.QUERIES | draws.QUERIES | reconstruct.QUERIES | calendars.QUERIES | fits.QUERIES | samples.QUERIES
ORACLE_SQL |= more.ORACLE_SQL | wider.ORACLE_SQL | rolling.ORACLE_SQL | draws.ORACLE_SQL | reconstruct.ORACLE_SQL | calendars.ORACLE_SQL | fits.ORACLE_SQL | samples.ORACLE_SQL
