"""Further queries: covariates, masks, wider metrics, quantile tables, corpus statistics; with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import covariates, evaluation, forecast, leaderboard, missing

from .common import GRID, HORIZON, SCORES, grid, model_scores, rounded, split

LEVELS = [0.1, 0.5, 0.9]


def order_counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily highest price per priority (series, pos, y), and the number of orders that day as a covariate."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = orders.groupBy(F.col("o_orderpriority").alias("series"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("pos")).agg(
        F.max("o_totalprice").alias("top"), F.count("*").alias("n")
    )
    target = day.select("series", "pos", F.when(F.pmod("pos", F.lit(5)) != 0, F.col("top")).alias("y"))
    return target, day.select("series", F.lit("orders").alias("name"), "pos", F.col("n").cast("double").alias("x"))


ORDERS = """WITH dy AS (SELECT o_orderpriority AS series, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS pos, max(o_totalprice) AS top, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2),
tg AS (SELECT series, pos, CASE WHEN pos % 5 <> 0 THEN top END AS y, x FROM dy)
"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variates quantity and discount of daily line items per return flag: (series, variate, pos, y)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = items.groupBy(F.col("l_returnflag").alias("series"), F.datediff("l_shipdate", F.lit("1990-01-01")).alias("pos")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return day.unpivot(["series", "pos"], ["quantity", "discount"], "variate", "y").select("series", "variate", "pos", "y")


CHANNELS = """WITH ch AS (SELECT l_returnflag AS series, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::INTEGER AS pos, avg(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2)
"""


def select_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, others = covariates.select_channels(channels(spark, sf_dir), "quantity", ["discount"])
    return rounded(target.join(others, ["series", "pos"]))


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, x = order_counts(spark, sf_dir)
    out = covariates.assemble_covariates(x.filter("pos < 2000"), x.filter("pos >= 2000"))
    return out.groupBy("series", "name", "known_future").agg(F.count("*").alias("n"), F.sum("x").alias("total"))


def by_covariate_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, x = order_counts(spark, sf_dir)
    return rounded(covariates.forecast_by_covariate(target.filter("pos < 2000"), x, HORIZON), 2)


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series"), "event_id", F.pmod("user_id", F.lit(11)).cast("string").alias("category"), F.col("value").alias("y"), (F.pmod("event_id", F.lit(5)) == 0).alias("known_future"))
    held = rows.withColumn("y", F.when(~F.col("known_future"), F.col("y")))
    mean = covariates.target_encode(held).withColumnRenamed("code", "mean_code")
    return rounded(covariates.ordinal_encode(mean).select("series", "event_id", "mean_code", F.col("code").alias("ordinal_code")))


def pred_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    context, truth = split(grid(spark, sf_dir))
    return forecast.naive_quantiles(context, HORIZON), truth, forecast.seasonal_error(context, 24)


PRED = GRID + f""", c AS (SELECT g.* FROM g JOIN m USING (series) WHERE pos < n - {HORIZON}),
t AS (SELECT g.series, pos - (n - {HORIZON}) + 1 AS step, y FROM g JOIN m USING (series) WHERE pos >= n - {HORIZON}),
cf AS (SELECT series, pos, coalesce(y, last_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY pos ROWS UNBOUNDED PRECEDING),
  first_value(y IGNORE NULLS) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS y_hat FROM c),
cd AS (SELECT series, pos, y_hat, y_hat - lag(y_hat) OVER (PARTITION BY series ORDER BY pos) AS d FROM cf),
l AS (SELECT series, max_by(y_hat, pos) AS last, coalesce(sqrt(avg(d * d)), 0) AS sigma FROM cd GROUP BY 1),
z(q, z) AS (VALUES (0.1::DOUBLE, -1.2815515655446004::DOUBLE), (0.5, 0.0), (0.9, 1.2815515655446004)),
p AS (SELECT series, CAST(k AS INTEGER) AS step, q, last + z * sigma * sqrt(k) AS y_hat FROM l, z, range(1, {HORIZON + 1}) AS r(k)),
sd AS (SELECT series, abs(y - lag(y, 24) OVER (PARTITION BY series ORDER BY pos)) AS d FROM c WHERE y IS NOT NULL),
sc AS (SELECT series, nullif(avg(d), 0) AS scale FROM sd GROUP BY 1),
e AS (SELECT t.series, t.step, q, y, y_hat, 2 * abs((y - y_hat) * (CASE WHEN y_hat >= y THEN 1.0 ELSE 0.0 END - q)) AS loss FROM t JOIN p USING (series, step) WHERE y IS NOT NULL)
"""


def masked_scores(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    """Every third position hidden, filled by the series' mean, scored there."""
    truth = grid(spark, sf_dir).withColumn("is_masked", F.pmod("pos", F.lit(3)) == 1)
    filled = missing.impute(truth.withColumn("y_true", F.col("y")).withColumn("y", F.when(~F.col("is_masked"), F.col("y"))), "mean")
    return rounded(score(filled))


MASKED = GRID + """, k AS (SELECT series, pos, y AS y_true, pos % 3 = 1 AS is_masked, CASE WHEN pos % 3 <> 1 THEN y END AS y FROM g),
i AS (SELECT *, coalesce(y, avg(y) OVER (PARTITION BY series), 0.0) AS y_hat, CASE WHEN stddev_pop(y) OVER (PARTITION BY series) = 0 THEN 1e-5 ELSE coalesce(stddev_pop(y) OVER (PARTITION BY series), 1.0) END AS unit FROM k)
"""


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each user in time order, packed; the data set is the user's id modulo 5."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return events.groupBy(F.col("user_id").alias("item_id"), F.pmod("user_id", F.lit(5)).cast("string").alias("dataset")).agg(F.transform(ordered, lambda s: s["value"]).alias("target"))


USERS = "WITH u AS (SELECT user_id AS item_id, CAST(user_id % 5 AS VARCHAR) AS dataset, count(*) AS n FROM events GROUP BY 1, 2)\n"


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory = evaluation.corpus_inventory(user_series(spark, sf_dir), 3)
    return rounded(evaluation.dataset_weights(inventory, F.when(F.col("dataset") < "2", F.lit("low"))))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = evaluation.corpus_inventory(user_series(spark, sf_dir), 3).select("dataset", F.col("n_values").alias("size"))
    return rounded(evaluation.mixture_weights(sizes).select("dataset", "weight"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = model_scores(spark, sf_dir).groupBy("dataset").agg(F.avg("score").alias("score"))
    return rounded(evaluation.summary_rows(scores, ["score"]))


QUERIES = {
    "b14_select_channels": select_channels,
    "b16_assemble_covariates": assembled,
    "b19_sparse_covariates": lambda s, d: covariates.sparse_covariates(order_counts(s, d)[1], 3).select("series", "pos", "x"),
    "d11_fill_by_covariate": lambda s, d: rounded(covariates.fill_by_covariate(*order_counts(s, d)).select("series", "pos", "y_hat"), 2),
    "g5_scale_covariates": lambda s, d: rounded(covariates.scale_covariates(order_counts(s, d)[1], 2000).select("series", "pos", "scaled")),
    "h5_level_keys": lambda s, d: evaluation.level_keys(pred_truth(s, d)[0]).select("series", "step", "q", "side", "interval"),
    "h9_point_estimate": lambda s, d: rounded(evaluation.point_estimate(pred_truth(s, d)[0]), 5),
    "h13_quantile_columns": lambda s, d: rounded(evaluation.quantiles_to_columns(pred_truth(s, d)[0], LEVELS), 5),
    "h14_forecast_by_covariate": by_covariate_ahead,
    "i9_pooled_metrics": lambda s, d: rounded(evaluation.pooled_metrics(*pred_truth(s, d)[:2]), 5),
    "i11_weighted_losses": lambda s, d: rounded(evaluation.weighted_losses(*pred_truth(s, d)), 5),
    "i10_i14_interval_scores": lambda s, d: rounded(evaluation.interval_scores(*pred_truth(s, d)), 5),
    "i12_masked_eval": lambda s, d: masked_scores(s, d, evaluation.masked_eval),
    "i17_normalized_eval": lambda s, d: masked_scores(s, d, evaluation.normalized_eval),
    "j7_summary_rows": summary,
    "j10_top_methods": lambda s, d: rounded(evaluation.top_methods(leaderboard.win_rate(model_scores(s, d)), 3)),
    "j13_skill_score": lambda s, d: rounded(evaluation.skill_score(model_scores(s, d), "click")),
    "k1_corpus_inventory": lambda s, d: evaluation.corpus_inventory(user_series(s, d), 3),
    "k2_length_stats": lambda s, d: rounded(evaluation.length_stats(user_series(s, d), "dataset")),
    "k4_dataset_weights": weighted,
    "k6_mixture_weights": mixture,
    "l1_l2_encoders": encoded,
}

ORACLE_SQL = {
    "b14_select_channels": CHANNELS + "SELECT series, pos, round(quantity, 6) AS y, 'discount' AS name, round(discount, 6) AS x FROM ch",
    "b16_assemble_covariates": ORDERS + "SELECT series, 'orders' AS name, pos >= 2000 AS known_future, count(*) AS n, sum(x) AS total FROM tg GROUP BY ALL",
    "b19_sparse_covariates": ORDERS + "SELECT series, pos, CASE WHEN pos % 3 = 2 THEN x END AS x FROM tg",
    "d11_fill_by_covariate": ORDERS + ", r AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM tg GROUP BY 1) SELECT series, pos, round(coalesce(y, a + b * x), 2) AS y_hat FROM tg JOIN r USING (series)",
    "g5_scale_covariates": ORDERS + "SELECT series, pos, round((x - avg(x) FILTER (WHERE pos >= 2000) OVER w) / (stddev_pop(x) FILTER (WHERE pos >= 2000) OVER w + 1e-7), 6) AS scaled FROM tg WINDOW w AS (PARTITION BY series)",
    "h5_level_keys": PRED + "SELECT series, step, q, CASE WHEN q < 0.5 THEN 'lo' ELSE 'hi' END AS side, CASE WHEN q = 0.5 THEN 0 ELSE 80 END::INTEGER AS interval FROM p",
    "h9_point_estimate": PRED + "SELECT series, step, round(avg(y_hat), 5) AS y_hat FROM p GROUP BY 1, 2",
    "h13_quantile_columns": PRED + "SELECT series, step, round(max(y_hat) FILTER (WHERE q = 0.1), 5) AS q10, round(max(y_hat) FILTER (WHERE q = 0.5), 5) AS q50, round(max(y_hat) FILTER (WHERE q = 0.9), 5) AS q90 FROM p GROUP BY 1, 2",
    "h14_forecast_by_covariate": ORDERS + f""", cx AS (SELECT * FROM tg WHERE pos < 2000), r AS (SELECT series, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(pos) + 1 AS n FROM cx GROUP BY 1)
SELECT series, pos - n + 1 AS step, round(a + b * x, 2) AS y_hat FROM tg JOIN r USING (series) WHERE pos - n + 1 BETWEEN 1 AND {HORIZON}""",
    "i9_pooled_metrics": PRED + """, sp AS (SELECT series, step, any_value(y) AS y, avg(y_hat) AS a, max(y_hat) FILTER (WHERE q = 0.5) AS b FROM e GROUP BY 1, 2)
SELECT round(avg((y - a) * (y - a)), 5) AS mse_mean, round(avg(abs(y - a)), 5) AS mae_mean, round(avg((y - b) * (y - b)), 5) AS mse_median, round(avg(abs(y - b)), 5) AS mae_median,
  round(sqrt(avg((y - a) * (y - a))), 5) AS rmse, round(sqrt(avg((y - a) * (y - a))) / avg(abs(y)), 5) AS nrmse, (SELECT round(avg(l), 5) FROM (SELECT sum(loss) / sum(abs(y)) AS l FROM e GROUP BY q)) AS wql FROM sp""",
    "i11_weighted_losses": PRED + """, lv AS (SELECT series, q, sum(loss) AS loss, avg(loss) AS mean, sum(abs(y)) AS size, sum(abs(y - y_hat)) AS error FROM e GROUP BY 1, 2)
SELECT series, round(max(error / (size + 1)) FILTER (WHERE q = 0.5), 5) AS wape, round(avg(loss / (size + 1)), 5) AS wql, round(avg(mean) / any_value(scale), 5) AS scaled_quantile_loss FROM lv LEFT JOIN sc USING (series) GROUP BY series""",
    "i10_i14_interval_scores": PRED + """, w AS (SELECT series, step, any_value(y) AS y, max(y_hat) FILTER (WHERE q = 0.1) AS lo, max(y_hat) FILTER (WHERE q = 0.9) AS hi FROM e GROUP BY 1, 2)
SELECT series, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 5) AS coverage, round(avg(hi - lo), 5) AS width,
  round(avg(hi - lo + (greatest(0, lo - y) + greatest(0, y - hi)) * 10) / any_value(scale), 5) AS msis FROM w LEFT JOIN sc USING (series) GROUP BY series""",
    "i12_masked_eval": MASKED + "SELECT series, count(*) AS n, round(avg(abs(y_true - y_hat)), 6) AS mae, round(sqrt(avg((y_true - y_hat) * (y_true - y_hat))), 6) AS rmse, round(sum(abs(y_true - y_hat)) / sum(abs(y_true)), 6) AS nd FROM i WHERE is_masked AND y_true IS NOT NULL GROUP BY 1",
    "i17_normalized_eval": MASKED + "SELECT series, round(avg(abs(y_true - y_hat) / unit), 6) AS mae, round(avg(((y_true - y_hat) / unit) * ((y_true - y_hat) / unit)), 6) AS mse FROM i WHERE is_masked AND y_true IS NOT NULL GROUP BY 1",
    "j7_summary_rows": SCORES + ", s AS (SELECT dataset, avg(score) AS score FROM sc GROUP BY 1) SELECT dataset, round(score, 6) AS score FROM s UNION ALL SELECT 'gmean', round(exp(avg(ln(score))), 6) FROM s UNION ALL SELECT 'mean', round(avg(score), 6) FROM s",
    "j10_top_methods": SCORES + ", w AS (SELECT a.model, b.model AS other, 100 * avg(CASE WHEN a.score < b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS r FROM sc a JOIN sc b ON a.dataset = b.dataset GROUP BY 1, 2) SELECT model, round(avg(r), 6) AS mean_win_rate FROM w GROUP BY 1 ORDER BY round(avg(r), 9) DESC, model LIMIT 3",
    "j13_skill_score": SCORES + "SELECT a.model, round(1 - exp(avg(ln(least(greatest(a.score / b.score, 0.01), 100.0)))), 6) AS skill FROM sc a JOIN sc b ON a.dataset = b.dataset AND b.model = 'click' GROUP BY 1",
    "k1_corpus_inventory": USERS + "SELECT dataset, count(*) AS n_series, count(*) FILTER (WHERE n >= 3) AS n_valid, sum(n)::BIGINT AS n_values FROM u GROUP BY 1",
    "k2_length_stats": USERS + "SELECT dataset, count(*) AS n_series, min(n) AS min_length, max(n) AS max_length, round(avg(n), 6) AS avg_length, sum(n)::BIGINT AS total_length FROM u GROUP BY 1",
    "k4_dataset_weights": USERS + """, v AS (SELECT dataset, count(*) AS n_series, count(*) FILTER (WHERE n >= 3) AS n_valid, sum(n)::BIGINT AS n_values FROM u GROUP BY 1),
r AS (SELECT *, CASE WHEN dataset < '2' THEN 1.0 / count(*) OVER (PARTITION BY dataset < '2') WHEN n_series < 100 THEN 0.01 ELSE 1.0 END AS raw FROM v)
SELECT dataset, n_series, n_valid, n_values, round(raw / sum(raw) OVER (), 6) AS weight FROM r""",
    "k6_mixture_weights": USERS + "SELECT dataset, round(sum(n) / sum(sum(n)) OVER (), 6) AS weight FROM u GROUP BY 1",
    "l1_l2_encoders": """WITH r AS (SELECT event_type AS series, event_id, CAST(user_id % 11 AS VARCHAR) AS category, CASE WHEN event_id % 5 <> 0 THEN value END AS y, event_id % 5 = 0 AS fut FROM events),
o AS (SELECT series, category, dense_rank() OVER (PARTITION BY series ORDER BY category) - 1 AS code FROM (SELECT DISTINCT series, category FROM r WHERE NOT fut))
SELECT series, event_id, round((coalesce(sum(y) OVER g, 0) + avg(y) OVER s) / (count(y) OVER g + 1), 6) AS mean_code, code AS ordinal_code
FROM r LEFT JOIN o USING (series, category) WINDOW s AS (PARTITION BY series), g AS (PARTITION BY series, category)""",
}
