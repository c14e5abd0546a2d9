"""Queries of imputation with quantiles and covariates, its scores, and seasonal intervals; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import covariates, forecast, reconstruct, rolling

from .common import GRID, HORIZON, SEASON, grid, rounded
from .more import MASKED, ORDERS, order_counts


def masked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quantiles of the grid with every third position hidden, and its truth."""
    truth = grid(spark, sf_dir).withColumnRenamed("y", "y_true").withColumn("is_masked", F.pmod("pos", F.lit(3)) == 1)
    shown = truth.withColumn("y", F.when(~F.col("is_masked"), F.col("y_true")))
    return reconstruct.impute_quantiles(shown), truth


def by_covariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, x = order_counts(spark, sf_dir)
    return rounded(reconstruct.impute_quantiles(target, covariates.sparse_covariates(x, 3), auto_complete=True), 2)


def line_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, x = order_counts(spark, sf_dir)
    return rounded(reconstruct.impute_quantiles(target, x, levels=[0.5], keep_observed=False), 2)


_BACK = "OVER (PARTITION BY series ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_AHEAD = "OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_Z = "z(q, z) AS (VALUES " + ", ".join(f"({q}::DOUBLE, {rolling.z_value(q)!r}::DOUBLE)" for q in rolling.LEVELS) + ")"


def _between(table: str, value: str) -> str:
    """The table with the neighbours' places p0, p1 and values v0, v1."""
    spot = f"CASE WHEN {value} IS NOT NULL THEN pos END"
    return f"SELECT *, last_value({spot} IGNORE NULLS) {_BACK} AS p0, first_value({spot} IGNORE NULLS) {_AHEAD} AS p1, last_value({value} IGNORE NULLS) {_BACK} AS v0, first_value({value} IGNORE NULLS) {_AHEAD} AS v1 FROM {table}"


_LINEAR = "v0 + (v1 - v0) * (pos - p0) / (p1 - p0), v0, v1, 0.0"
QUANTILES = MASKED + f""", x AS ({_between("k", "y")}),
o AS (SELECT series, (y - lag(y) OVER w) ** 2 / (pos - lag(pos) OVER w) AS v FROM k WHERE y IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY pos)),
sg AS (SELECT series, sqrt(avg(v)) AS sigma FROM o GROUP BY 1), {_Z},
pr AS (SELECT x.series, pos, y_true, is_masked, q, coalesce(y, {_LINEAR}) + z * coalesce(sigma, 0) * sqrt(CASE WHEN y IS NOT NULL THEN 0 WHEN p0 IS NULL THEN coalesce(p1 - pos, 0) WHEN p1 IS NULL THEN pos - p0
  ELSE (pos - p0) * (p1 - pos) / (p1 - p0) END) AS y_hat FROM x LEFT JOIN sg ON sg.series = x.series CROSS JOIN z)
"""
_LINES = """r AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM c GROUP BY 1),
l AS (SELECT c.series, pos, y, a + b * x AS line FROM c JOIN r ON r.series = c.series)
"""

QUERIES = {
    "d8_impute_quantiles": lambda s, d: rounded(masked(s, d)[0], 8),
    "d8_impute_by_completed_covariate": by_covariate,
    "d8_reconstruct_everywhere": line_everywhere,
    "i12_masked_quantile_eval": lambda s, d: rounded(reconstruct.masked_quantile_eval(*masked(s, d), SEASON), 5),
    "h3_seasonal_quantiles": lambda s, d: rounded(forecast.seasonal_naive_quantiles(grid(s, d), HORIZON, SEASON), 5),
}

ORACLE_SQL = {
    "d8_impute_quantiles": QUANTILES + "SELECT series, pos, q, round(y_hat, 8) AS y_hat FROM pr",
    "d8_impute_by_completed_covariate": ORDERS
    + f""", s AS (SELECT series, pos, y, CASE WHEN pos % 3 = 2 THEN x END AS x FROM tg), n AS ({_between("s", "x")}), c AS (SELECT series, pos, y, coalesce(x, {_LINEAR}) AS x FROM n), {_LINES},
e AS (SELECT *, sqrt(avg((y - line) * (y - line)) OVER (PARTITION BY series)) AS s FROM l), {_Z} SELECT series, pos, q, round(coalesce(y, line + z * s), 2) AS y_hat FROM e CROSS JOIN z""",
    "d8_reconstruct_everywhere": ORDERS + f", c AS (SELECT * FROM tg), {_LINES} SELECT series, pos, 0.5::DOUBLE AS q, round(line, 2) AS y_hat FROM l",
    "i12_masked_quantile_eval": QUANTILES
    + f""", e AS (SELECT series, q, y_true AS y, y_hat, 2 * abs((y_true - y_hat) * (CASE WHEN y_hat >= y_true THEN 1.0 ELSE 0.0 END - q)) AS loss FROM pr WHERE is_masked AND y_true IS NOT NULL),
lv AS (SELECT series, q, sum(loss) / nullif(sum(abs(y)), 0) AS l FROM e GROUP BY 1, 2), cr AS (SELECT series, avg(l) AS crps FROM lv GROUP BY 1),
sd AS (SELECT series, abs(y - lag(y, {SEASON}) OVER (PARTITION BY series ORDER BY pos)) AS d FROM g WHERE y IS NOT NULL), sc AS (SELECT series, nullif(avg(d), 0) AS scale FROM sd GROUP BY 1)
SELECT e.series, count(*) AS n, round(avg(abs(y - y_hat)), 5) AS mae, round(sqrt(avg((y - y_hat) * (y - y_hat))), 5) AS rmse, round(sum(abs(y - y_hat)) / nullif(sum(abs(y)), 0), 5) AS nd,
  round(any_value(crps), 5) AS crps, round(avg(abs(y - y_hat)) / any_value(scale), 5) AS mase FROM e JOIN cr ON cr.series = e.series LEFT JOIN sc ON sc.series = e.series WHERE q = 0.5 GROUP BY 1""",
    "h3_seasonal_quantiles": GRID
    + f""", d AS (SELECT series, y_hat - lag(y_hat, {SEASON}) OVER (PARTITION BY series ORDER BY pos) AS d FROM f), sg AS (SELECT series, coalesce(sqrt(avg(d * d)), 0) AS sigma FROM d GROUP BY 1), {_Z}
SELECT f.series, pos - (n - {SEASON}) + 1 AS step, q, round(y_hat + z * sigma * sqrt((pos - (n - {SEASON})) // {SEASON} + 1), 5) AS y_hat FROM f JOIN m ON m.series = f.series JOIN sg ON sg.series = f.series CROSS JOIN z WHERE pos >= n - {SEASON}""",
}
