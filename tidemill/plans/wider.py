"""Queries of item layout, selection, windows, training tables and reports, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import evaluation, forecast, layout, missing, reports, scaling, selection, shape, training
from tidemill.sources import series as sources

from .common import GRID, HORIZON, SCORES, grid, model_scores, rounded
from .draws import draw
from .more import CHANNELS, ORDERS, PRED, USERS, channels, order_counts, pred_truth, user_series

DOUBLES = "transform(embedding, v -> cast(v as double))"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as items of two channels of 32 values."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.selectExpr("cast(vec_id as string) as item_id", f"array(slice({DOUBLES}, 1, 32), slice({DOUBLES}, 33, 32)) as target")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as item_id", f"{DOUBLES} as target")


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.infer_freq(grid(spark, sf_dir))
    return found.select("series", "step_seconds", "freq", layout.steps_per_day("step_seconds").alias("per_day"), layout.seasonality("freq").alias("season"), layout.default_horizon("freq", "medium").alias("horizon"))


def fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.fourier_features(shape.time_grid(grid(spark, sf_dir)), "coord", [2.0, 4.0], 2)
    # Adding 0 turns a rounded -0.0 into 0.0.
    return rows.select("series", "pos", *[(F.round(c, 6) + 0.0).alias(c) for c in ("sin_0_0", "cos_0_1", "sin_1_1")])


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, x = order_counts(spark, sf_dir)
    named = target.select("series", F.lit("price").alias("name"))
    return layout.group_ids(named, x.select("series", "name", (F.col("pos") >= 2000).alias("known_future")))


def resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = layout.resize_series(vectors(spark, sf_dir), 24).select("item_id", F.get("target", F.lit(9)).alias("near"))
    lin = layout.resize_series(vectors(spark, sf_dir), 100, "linear").select("item_id", F.get("target", F.lit(49)).alias("lin"))
    return rounded(near.join(lin, "item_id"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.patch(user_series(spark, sf_dir), 8, 4)
    return rounded(rows.select("item_id", F.size("patches").alias("n_patches"), F.size(F.filter("usable", lambda u: u)).alias("n_usable"), F.element_at(F.element_at("patches", -1), -1).alias("last_value")))


def event_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("dataset")).agg(F.count("*").alias("n"))


def validation_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.cut_context_future(user_series(spark, sf_dir), "VALIDATION", 6, 2, 3)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(rows.select("item_id", F.col("split").alias("cut"), F.size("context").alias("n_context"), total("context").alias("context_sum"), total("future").alias("future_sum")))


def future_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, x = order_counts(spark, sf_dir)
    rows = target.select("series", F.lit("price").alias("name"), F.lit(0).alias("role"), "pos", F.col("y").alias("x")).unionByName(x.withColumn("role", F.lit(2)))
    cutoffs = target.select("series").distinct().withColumn("cutoff", F.lit(2000))
    return rounded(selection.future_for_cut(rows, cutoffs, HORIZON), 2)


def kept_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth, _ = pred_truth(spark, sf_dir)
    return rounded(selection.keep_observed(pred.withColumnRenamed("step", "pos"), truth.withColumnRenamed("step", "pos")).select("series", "pos", "q", "y_hat"), 5)


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.split_series(user_series(spark, sf_dir), 0.2).select("item_id", "is_validation")


def masked_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).withColumn("is_masked", F.pmod("pos", F.lit(3)) == 1)
    return rounded(scaling.masked_instance_scale(rows).select("series", "pos", "scaled"))


def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = grid(spark, sf_dir)
    return rounded(scaling.display_scale(long.select("series", "pos", "y"), long.filter("pos < 200"), ["y"]))


def future_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = order_counts(spark, sf_dir)[1]
    x = x.join(x.groupBy("series").agg(F.max("pos").alias("_end")), "series").filter("pos <= _end - 30").drop("_end")
    ahead = training.forecast_covariates(x, lambda rows, h: forecast.seasonal_naive(rows, h, 1), HORIZON)
    return ahead.filter("forecast").select("series", "name", "pos", "x")


def loss_on_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred, truth, _ = pred_truth(spark, sf_dir)
    rows = pred.join(truth, ["series", "step"]).withColumn("loss_mask", F.pmod("step", F.lit(2)) == 0)
    return rounded(reports.masked_quantile_loss(rows, [0.1, 0.5, 0.9]), 5)


def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value of every event as a window's score: (model, dataset, term, MASE, CRPS)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("model"), F.concat(F.lit("d"), F.pmod("user_id", F.lit(7)).cast("string")).alias("dataset"), F.lit("short").alias("term"), F.col("value").alias("MASE"), (F.col("value") / 2).alias("CRPS")
    )


WINDOWS = "WITH wm AS (SELECT event_type AS model, concat('d', user_id % 7) AS dataset, value AS MASE, value / 2 AS CRPS FROM events)\n"


def scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = event_datasets(spark, sf_dir).filter("dataset <> 'click'").select(F.col("dataset").alias("model"), F.upper("dataset").alias("category"))
    return rounded(reports.score_scatter(window_metrics(spark, sf_dir), kinds, ["MASE", "CRPS"]))


QUERIES = {
    "a6_scale_factor": lambda s, d: rounded(sources.scaled_predictions(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("dataset"), "o_orderkey", F.col("o_totalprice").alias("y_hat")))),
    "a7_run_summary": lambda s, d: rounded(sources.run_summary(window_metrics(s, d), ["MASE", "CRPS"])),
    "b3_to_univariate": lambda s, d: rounded(layout.to_univariate(items(s, d)).select("item_id", F.get("target", F.lit(0)).alias("first_value"))),
    "b4_to_multivariate": lambda s, d: rounded(layout.to_multivariate(layout.to_univariate(items(s, d))).select("item_id", F.size("target").alias("n_channels"), F.get(F.get("target", F.lit(1)), F.lit(0)).alias("first_value"))),
    "b5_item_names": lambda s, d: layout.item_names(channels(s, d).select(F.col("series").alias("file"), "variate")).groupBy("item_id").agg(F.count("*").alias("n")),
    "b6_b9_frequency_rules": frequencies,
    "b15_cast_features": lambda s, d: layout.cast_features(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("number"), F.col("o_orderdate").cast("date").alias("day")), ["number", "day"]),
    "b21_patch": patches,
    "b22_time_index": lambda s, d: rounded(layout.time_index(grid(s, d), 512).select("series", "pos", "t")),
    "b23_fourier_features": fourier,
    "b24_group_ids": groups,
    "b25_resize": resized,
    "c1_min_length": lambda s, d: selection.min_length(user_series(s, d), 3, 2).select("item_id", F.size("target").alias("n")),
    "c2_all_missing_zero": lambda s, d: rounded(selection.all_missing(grid(s, d).withColumn("y", F.when(F.col("series") != "click", F.col("y"))), "zero")),
    "c4_select_datasets": lambda s, d: selection.select_datasets(event_datasets(s, d), None, ["c"]),
    "c6_exclude_methods": lambda s, d: rounded(selection.exclude_methods(model_scores(s, d), ["ew"])),
    "d1_observed_context": lambda s, d: rounded(selection.observed_context(grid(s, d)).select("series", "pos", "k", "y")),
    "d7_keep_observed": kept_observed,
    "f2_val_windows": lambda s, d: selection.val_windows(grid(s, d), 100, 72, HORIZON),
    "f3_train_prefix": lambda s, d: selection.prefix(grid(s, d), HORIZON, 5).groupBy("series").agg(F.count("*").alias("n")),
    "f4_rolling_task_windows": lambda s, d: selection.rolling_task_windows(grid(s, d), HORIZON, 10, 100),
    "f5_validation_cut": validation_cut,
    "f6_future_for_cut": future_roles,
    "f9_split_series": split_rows,
    "g3_masked_instance_scale": masked_scale,
    "g6_display_scale": display,
    "h7_complete_lookback": lambda s, d: rounded(forecast.seasonal_naive(training.complete_lookback(grid(s, d)), HORIZON, 24)),
    "h8_forecast_covariates": future_covariates,
    "i15_interval_bands": lambda s, d: rounded(reports.interval_bands(pred_truth(s, d)[0], [(0.1, 0.9)]), 5),
    "i16_masked_quantile_loss": loss_on_mask,
    "j1_dataset_scores": lambda s, d: rounded(reports.dataset_scores(window_metrics(s, d), ["model", "dataset"], ["MASE", "CRPS"])),
    "j8_metric_table": lambda s, d: rounded(reports.metric_table(model_scores(s, d), ["dataset"], ["click", "view"], {"score": "s"})),
    "j11_score_scatter": scatter,
    "j12_reference_score": lambda s, d: rounded(reports.reference_score(reports.dataset_scores(window_metrics(s, d), ["model", "dataset"], ["MASE", "CRPS"]))),
    "j14_align": lambda s, d: rounded(reports.align(evaluation.point_estimate(pred_truth(s, d)[0]), pred_truth(s, d)[1], ["series", "step"]), 5),
    "k3_flatten_channels": lambda s, d: rounded(training.flatten_channels(items(s, d)).select("item_id", "channel", F.get("target", F.lit(31)).alias("last_value"))),
    "p3_named_metrics": lambda s, d: rounded(training.evaluate(missing.impute(grid(s, d).withColumn("truth", F.col("y")).withColumn("y", F.when(F.pmod("pos", F.lit(3)) != 1, F.col("y"))), "mean").filter(F.pmod("pos", F.lit(3)) == 1).withColumn("y", F.col("truth")), ["mae", "rmse", "nmae"], ["series"])),
}

_SPAN = "OVER (PARTITION BY series ORDER BY pos ROWS"
SQL_LINEAR = f"""x AS (SELECT series, pos, y, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) {_SPAN} UNBOUNDED PRECEDING) AS p0, first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) {_SPAN} BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1,
  last_value(y IGNORE NULLS) {_SPAN} UNBOUNDED PRECEDING) AS v0, first_value(y IGNORE NULLS) {_SPAN} BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1 FROM g)"""

ORACLE_SQL = {
    "a6_scale_factor": "WITH t AS (SELECT o_orderpriority AS dataset, o_orderkey, o_totalprice AS v, max(abs(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS top FROM orders), f AS (SELECT *, CASE WHEN top > 60000 THEN pow(10.0, ceil(log10(top / 60000.0))) ELSE 1.0 END AS k FROM t) SELECT dataset, o_orderkey, round(v / k, 6) AS y_hat, k AS scale_factor FROM f",
    "a7_run_summary": WINDOWS + "SELECT model, dataset, count(*) AS nb_chunks, round(avg(MASE), 6) AS MASE, round(avg(CRPS), 6) AS CRPS FROM wm GROUP BY 1, 2",
    "b3_to_univariate": "SELECT concat(vec_id, '_dim0') AS item_id, round(embedding[1]::DOUBLE, 6) AS first_value FROM embeddings UNION ALL SELECT concat(vec_id, '_dim1'), round(embedding[33]::DOUBLE, 6) FROM embeddings",
    "b4_to_multivariate": "SELECT CAST(vec_id AS VARCHAR) AS item_id, 2 AS n_channels, round(embedding[33]::DOUBLE, 6) AS first_value FROM embeddings",
    "b5_item_names": CHANNELS + "SELECT concat(series, '_', v) AS item_id, count(*) AS n FROM ch, (VALUES ('quantity'), ('discount')) AS t(v) GROUP BY 1",
    "b6_b9_frequency_rules": GRID + ", d AS (SELECT series, date_diff('second', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts) AS d FROM g) SELECT series, max(d) AS step_seconds, 'H' AS freq, CAST(86400 / max(d) AS INTEGER) AS per_day, 24 AS season, 480 AS horizon FROM d GROUP BY series",
    "b15_cast_features": "SELECT o_orderkey, o_custkey::DOUBLE AS number, CAST(o_orderdate::DATE AS VARCHAR) AS day FROM orders",
    # A patch is all padding never: padding is shorter than a patch.
    "b21_patch": "WITH u AS (SELECT user_id AS item_id, count(*) AS n, arg_max(value, (ts, event_id)) AS l FROM events GROUP BY 1) SELECT item_id, CAST((ceil(n / 8.0) * 8 - 8) / 4 + 1 AS INTEGER) AS n_patches, CAST((ceil(n / 8.0) * 8 - 8) / 4 + 1 AS INTEGER) AS n_usable, round(l, 6) AS last_value FROM u",
    "b22_time_index": GRID + "SELECT series, pos, round((pos - n) / 512.0, 6) AS t FROM g JOIN m USING (series)",
    "b23_fourier_features": GRID + "SELECT series, pos, round(sin(pos / (n - 1) * pi()), 6) + 0.0::DOUBLE AS sin_0_0, round(cos(pos / (n - 1) * (4 * pi())), 6) + 0.0::DOUBLE AS cos_0_1, round(sin(pos / (n - 1) * (16 * pi())), 6) + 0.0::DOUBLE AS sin_1_1 FROM g JOIN m USING (series)",
    "b24_group_ids": ORDERS + ", r AS (SELECT DISTINCT series, 'price' AS name, 0 AS role FROM tg UNION ALL SELECT series, 'orders', max(CASE WHEN pos >= 2000 THEN 2 ELSE 1 END) FROM tg GROUP BY 1) SELECT series, name, role, dense_rank() OVER (ORDER BY series) - 1 AS group_id, row_number() OVER (PARTITION BY series ORDER BY role, name) - 1 AS place FROM r",
    "b25_resize": "SELECT vec_id AS item_id, round(embedding[25]::DOUBLE, 6) AS near, round(embedding[32]::DOUBLE * (1 - 0.18) + embedding[33]::DOUBLE * 0.18, 6) AS lin FROM embeddings",
    "c1_min_length": USERS + "SELECT item_id, CAST(n AS INTEGER) AS n FROM u WHERE n >= 5",
    "c2_all_missing_zero": GRID + "SELECT series, pos, ts, CASE WHEN series = 'click' THEN 0.0 ELSE round(y, 6) END AS y FROM g",
    "c4_select_datasets": "SELECT event_type AS dataset, count(*) AS n FROM events WHERE event_type NOT LIKE '%c%' GROUP BY 1",
    "c6_exclude_methods": SCORES + "SELECT * FROM sc WHERE model NOT LIKE '%ew%'",
    "d1_observed_context": GRID + "SELECT series, pos, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS k, round(y, 6) AS y FROM g WHERE y IS NOT NULL",
    "d7_keep_observed": PRED + "SELECT p.series, p.step AS pos, q, round(coalesce(t.y, p.y_hat), 5) AS y_hat FROM p LEFT JOIN t USING (series, step)",
    "f2_val_windows": GRID + f"SELECT series, CAST(w AS INTEGER) AS \"window\", CAST(n - 172 + w * {HORIZON} AS INTEGER) AS cutoff FROM m, range(0, {72 // HORIZON}) AS r(w) WHERE n - 172 + w * {HORIZON} > 0",
    "f3_train_prefix": GRID + f"SELECT series, count(*) AS n FROM g JOIN m USING (series) WHERE pos < n - {HORIZON * 5} GROUP BY series",
    "f4_rolling_task_windows": GRID + f"SELECT series, CAST(w AS INTEGER) AS \"window\", CAST(n - {HORIZON * 10} + w * {HORIZON} AS INTEGER) AS cutoff FROM m, range(0, 10) AS r(w) WHERE n - {HORIZON * 10} + w * {HORIZON} >= 100",
    "f5_validation_cut": "WITH e AS (SELECT user_id AS item_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT item_id, CAST(any_value(n) - 2 AS INTEGER) AS cut, CAST(count(*) FILTER (WHERE pos < n - 2 AND pos >= n - 8) AS INTEGER) AS n_context, round(sum(value) FILTER (WHERE pos < n - 2 AND pos >= n - 8), 6) AS context_sum, round(sum(value) FILTER (WHERE pos >= n - 2), 6) AS future_sum FROM e WHERE n >= 5 GROUP BY 1",
    "f6_future_for_cut": ORDERS + f"SELECT series, 'price' AS name, 0 AS role, pos - 1999 AS step, round(y, 2) AS label, NULL::DOUBLE AS known FROM tg WHERE pos BETWEEN 2000 AND {1999 + HORIZON} UNION ALL SELECT series, 'orders', 2, pos - 1999, NULL, x FROM tg WHERE pos BETWEEN 2000 AND {1999 + HORIZON}",
    "f9_split_series": USERS + f"SELECT item_id, row_number() OVER (ORDER BY {draw(0, 'item_id')}, item_id) <= floor(count(*) OVER () * 0.2) AS is_validation FROM u",
    "g3_masked_instance_scale": GRID + ", st AS (SELECT series, avg(y) AS a, stddev_pop(y) AS b FROM g WHERE pos % 3 <> 1 GROUP BY 1) SELECT series, pos, round((y - a) / CASE WHEN b > 1e-5 THEN b ELSE 1.0 END, 6) AS scaled FROM g JOIN st USING (series)",
    "g6_display_scale": GRID + ", st AS (SELECT series, avg(y) AS a, stddev_pop(y) AS b FROM g WHERE pos < 200 GROUP BY 1) SELECT series, pos, round((y - a) / (b + 1e-6), 6) AS y FROM g JOIN st USING (series)",
    "h7_complete_lookback": GRID + f", {SQL_LINEAR} SELECT series, CAST(pos - (n - 24) + 1 AS INTEGER) AS step, round(coalesce(y, v0 + (v1 - v0) * (pos - p0) / (p1 - p0), v0, v1, 0.0), 6) AS y_hat FROM x JOIN m USING (series) WHERE pos >= n - 24",
    "h8_forecast_covariates": ORDERS + f", l AS (SELECT series, max(pos) + 1 AS n, arg_max(x, pos) AS x FROM tg WHERE pos <= (SELECT max(pos) FROM tg b WHERE b.series = tg.series) - 30 GROUP BY 1) SELECT series, 'orders' AS name, CAST(n + k AS INTEGER) AS pos, x FROM l, range(0, {HORIZON}) AS r(k)",
    "i15_interval_bands": PRED + "SELECT series, step, round(max(y_hat) FILTER (WHERE q = 0.1), 5) AS low_10_90, round(max(y_hat) FILTER (WHERE q = 0.9), 5) AS high_10_90 FROM p GROUP BY 1, 2",
    "i16_masked_quantile_loss": PRED + ", lq AS (SELECT series, q, avg(loss) AS l, avg((y - y_hat) * (y - y_hat)) AS s, avg(abs(y - y_hat)) AS a FROM e WHERE step % 2 = 0 GROUP BY 1, 2) SELECT series, round(sum(l) / sqrt(3), 5) AS loss, round(max(s) FILTER (WHERE q = 0.5), 5) AS mse, round(max(a) FILTER (WHERE q = 0.5), 5) AS mae FROM lq GROUP BY 1",
    "j1_dataset_scores": WINDOWS + "SELECT model, dataset, round(avg(MASE), 6) AS MASE, round(avg(CRPS), 6) AS CRPS FROM wm GROUP BY 1, 2",
    "j8_metric_table": SCORES + "SELECT dataset, max(score) FILTER (WHERE model = 'click') AS s_click, max(score) FILTER (WHERE model = 'view') AS s_view FROM sc GROUP BY 1",
    "j11_score_scatter": WINDOWS + "SELECT model, round(avg(MASE), 6) AS MASE, round(avg(CRPS), 6) AS CRPS, CASE WHEN model = 'click' THEN 'Unknown' ELSE upper(model) END AS category FROM wm GROUP BY 1",
    "j12_reference_score": WINDOWS + f", d AS (SELECT model, dataset, avg(MASE) AS a, avg(CRPS) AS b FROM wm GROUP BY 1, 2) SELECT model, round(exp(avg(ln(a))) / {reports.NAIVE['MASE']!r}::DOUBLE, 6) AS MASE, round(exp(avg(ln(b))) / {reports.NAIVE['CRPS']!r}::DOUBLE, 6) AS CRPS FROM d GROUP BY 1",
    "j14_align": PRED + ", a AS (SELECT series, step, avg(y_hat) AS y_hat FROM p GROUP BY 1, 2) SELECT series, step, round(y_hat, 5) AS y_hat, round(y, 5) AS y FROM a JOIN t USING (series, step)",
    "k3_flatten_channels": "SELECT CAST(vec_id AS VARCHAR) AS item_id, 0 AS channel, round(embedding[32]::DOUBLE, 6) AS last_value FROM embeddings UNION ALL SELECT CAST(vec_id AS VARCHAR), 1, round(embedding[64]::DOUBLE, 6) FROM embeddings",
    "p3_named_metrics": GRID + ", a AS (SELECT series, avg(y) AS a FROM g WHERE pos % 3 <> 1 GROUP BY 1) SELECT series, round(avg(abs(y - a)), 6) AS mae, round(sqrt(avg((y - a) * (y - a))), 6) AS rmse, round(sum(abs(y - a)) / sum(abs(y)), 6) AS nmae FROM g JOIN a USING (series) WHERE pos % 3 = 1 AND y IS NOT NULL GROUP BY 1",
}
