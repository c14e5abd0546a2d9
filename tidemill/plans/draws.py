"""Queries of drawn masks, windows and samples, and of small forecast helpers, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import covariates, evaluation, forecast, masking, missing, selection, training

from .common import GRID, HORIZON, SEASON, grid, rounded
from .more import CHANNELS, LEVELS, ORDERS, PRED, USERS, channels, order_counts, pred_truth, user_series


def draw(seed: int, *keys: str) -> str:
    """SQL of ``masking.series_seed``."""
    return f"('0x' || substr(md5(concat_ws('|', {seed}, {', '.join(keys)})), 1, 15))::BIGINT"


def unit(seed: int, *keys: str) -> str:
    """SQL of ``masking.uniform``."""
    return f"({draw(seed, *keys)} % 2147483648 / 2147483648::DOUBLE)"


def marked(df: DataFrame, mark: str = "is_masked") -> DataFrame:
    return df.select("series", "pos", mark)


def two_variates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).selectExpr("series", "pos", "stack(2, 'once', y, 'twice', 2 * y) as (variate, y)")


def scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A default scenario for contexts of 480 values, on two variates."""
    blocks = masking.default_scenarios(spark, 480).filter("scenario = 'two_blocks'").first()
    mask = masking.mask_blocks(grid(spark, sf_dir), blocks.n_blocks, blocks.block_size, 7)
    return rounded(masking.apply_scenario(mask, two_variates(spark, sf_dir)))


def masks_for_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = masking.mask_tail(grid(spark, sf_dir).withColumn("is_masked", F.pmod("pos", F.lit(3)) == 1), 8, 3, 7)
    rows = masking.training_masks(rows.withColumn("pad_mask", F.col("pos") < 5).withColumn("miss_mask", F.col("y").isNull()))
    return rows.select("series", "pos", "pred_mask", "loss_mask")


def seasonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.seasonal_naive(grid(spark, sf_dir), HORIZON, SEASON)


def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seasonal(spark, sf_dir)
    return rounded(selection.restore_missing(rows.filter("series <> 'click'"), rows.select("series", "step"), ["series", "step"]))


def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = seasonal(spark, sf_dir).withColumn("y_hat", F.when(~((F.col("series") == "click") & (F.col("step") == 3)), F.col("y_hat")))
    plain = forecast.naive_quantiles(grid(spark, sf_dir), HORIZON).filter("q = 0.5").select("series", "step", "y_hat")
    return rounded(evaluation.with_fallback(holes, plain))


def sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seasonal(spark, sf_dir).withColumn("y_hat", F.when(F.pmod("step", F.lit(4)) != 0, F.col("y_hat")))
    return rounded(evaluation.sanitize_forecast(rows))


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(training.rollout(grid(spark, sf_dir), forecast.naive_quantiles, HORIZON, HORIZON // 2), 5)


def drawn_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.random_window(user_series(spark, sf_dir), 8, 3, seed=5)
    return rounded(rows.select("item_id", "window_start", F.size("target").alias("n"), F.element_at("target", -1).alias("last_value")))


def train_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.cut_context_future(user_series(spark, sf_dir), "TRAIN", 6, 2, 3).select("item_id", "split", F.size("context").alias("n_context"))


def test_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.cut_context_future(user_series(spark, sf_dir), "TEST", 6, 2, 3).select("item_id", "split", F.size("context").alias("n_context"))


def drawn_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = user_series(spark, sf_dir)
    weights = evaluation.dataset_weights(evaluation.corpus_inventory(packed, 3), F.lit(None).cast("string"))
    return evaluation.sample_series(packed, weights, 20, 3).select("item_id", "dataset")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training.motif_tile(user_series(spark, sf_dir), 3, 8, 4)
    return rounded(rows.select("item_id", F.size("target").alias("n"), F.element_at("target", 1).alias("first_value"), F.element_at("target", 8).alias("last_value")))


def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("target")
    return user_series(spark, sf_dir).select("item_id", masking.adaptive_block(n, 4).alias("of_valid"), masking.adaptive_block_of_context(n, 8, 6).alias("of_context"))


def shared_covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = channels(spark, sf_dir)
    return rounded(covariates.broadcast_covariates(rows, covariates.select_channels(rows, "quantity", ["discount"])[1]))


def past(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, x = order_counts(spark, sf_dir)
    return covariates.past_only(x, target.filter("pos < 2000"))


QUERIES = {
    "b17_broadcast_covariates": shared_covariates,
    "b18_past_only": past,
    "c2_restore_missing": restored,
    "d2_fill_by_resample": lambda s, d: rounded(selection.fill_by_resample(grid(s, d))),
    "e1_mask_pointwise": lambda s, d: marked(missing.mask_pointwise(grid(s, d), 0.3, 7)),
    "e2_series_seed": lambda s, d: grid(s, d).select("series").distinct().select("series", masking.series_seed(3, "series").alias("draw")),
    "e3_mask_blocks": lambda s, d: marked(masking.mask_blocks(grid(s, d), 2, 48, 7)),
    "e4_mask_mixed": lambda s, d: marked(masking.mask_mixed(grid(s, d), 2, 24, 0.1, 7)),
    "e5_e6_apply_scenario": scenario,
    "e7_mask_contiguous_patches": lambda s, d: marked(masking.mask_contiguous_patches(grid(s, d), 8, 3, 0.4, 7)),
    "e8_adaptive_block": block_lengths,
    "e9_mask_tail": lambda s, d: marked(masking.mask_tail(grid(s, d), 8, 3, 7), "is_tail"),
    "e10_training_masks": masks_for_training,
    "e11_mask_bernoulli": lambda s, d: marked(masking.mask_bernoulli(grid(s, d), 0.2, 5)),
    "f5_train_cut": train_cut,
    "f5_test_cut": test_cut,
    "f7_random_window": drawn_window,
    "h4_with_fallback": fallback,
    "h6_rollout": chained,
    "h10_select_quantiles": lambda s, d: rounded(evaluation.select_quantiles(pred_truth(s, d)[0], [0.1, 0.9]), 5),
    "h11_sanitize_forecast": sanitized,
    "h13_quantile_rows": lambda s, d: rounded(evaluation.quantiles_to_rows(evaluation.quantiles_to_columns(pred_truth(s, d)[0], LEVELS), LEVELS), 5),
    "k5_sample_series": drawn_series,
    "k8_motif_tile": tiles,
}


def _two_blocks(size: int) -> str:
    """CTE mb (series, pos, is_masked) of two blocks with seed 7: the first try, and the first that does not overlap it."""
    return f""", tr AS (SELECT series, k, {draw(7, "series", "k")} % (greatest(n - {size}, 0) + 1) AS s FROM m, range(0, 200) AS r(k)),
b0 AS (SELECT series, s FROM tr WHERE k = 0), b1 AS (SELECT tr.series, arg_min(tr.s, tr.k) AS s FROM tr JOIN b0 USING (series) WHERE abs(tr.s - b0.s) >= {size} GROUP BY 1),
bl AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1),
mb AS (SELECT g.series, g.pos, bool_or(g.pos >= bl.s AND g.pos < bl.s + {size}) AS is_masked FROM g JOIN bl USING (series) GROUP BY 1, 2)
"""


EVENTS = "WITH e AS (SELECT user_id AS item_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_SEASONAL = f"SELECT series, pos - (n - {SEASON}) + 1 AS step, y_hat FROM f JOIN m USING (series) WHERE pos >= n - {SEASON}"

ORACLE_SQL = {
    "b17_broadcast_covariates": CHANNELS + "SELECT series, v AS variate, 'discount' AS name, pos, round(discount, 6) AS x FROM ch, (VALUES ('quantity'), ('discount')) AS t(v)",
    "b18_past_only": ORDERS + ", e AS (SELECT series, max(pos) AS p FROM tg WHERE pos < 2000 GROUP BY 1) SELECT series, 'orders' AS name, pos, x FROM tg JOIN e USING (series) WHERE pos <= p",
    "c2_restore_missing": GRID + f"SELECT series, step, CASE WHEN series = 'click' THEN 0.0 ELSE round(y_hat, 6) END AS y_hat FROM ({_SEASONAL})",
    "d2_fill_by_resample": GRID + f""", o AS (SELECT series, pos, y, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS k FROM g WHERE y IS NOT NULL), q AS (SELECT series, count(y) AS c FROM g GROUP BY 1)
SELECT g.series, g.pos, round(g.y, 6) AS y, CASE WHEN g.y IS NOT NULL THEN g.pos ELSE o.pos END AS pos_used, round(coalesce(g.y, o.y), 6) AS y_hat
FROM g JOIN q USING (series) LEFT JOIN o ON o.series = g.series AND g.y IS NULL AND o.k = CAST(floor({unit(42, "g.series", "g.pos")} * c) AS BIGINT)""",
    "e1_mask_pointwise": GRID + f"SELECT series, pos, row_number() OVER (PARTITION BY series ORDER BY {draw(7, 'series', 'pos')}, pos) <= round_even(0.3 * n, 0) AS is_masked FROM g JOIN m USING (series)",
    "e2_series_seed": GRID + f"SELECT series, {draw(3, 'series')} AS draw FROM m",
    "e3_mask_blocks": GRID + _two_blocks(48) + "SELECT series, pos, is_masked FROM mb",
    "e4_mask_mixed": GRID + _two_blocks(24) + f"SELECT series, pos, is_masked OR row_number() OVER (PARTITION BY series, is_masked ORDER BY {draw(8, 'series', 'pos')}, pos) <= greatest(1, round_even(0.1 * n, 0)) AS is_masked FROM mb JOIN m USING (series)",
    "e5_e6_apply_scenario": GRID + _two_blocks(32) + """SELECT series, v AS variate, pos, round(k * y, 6) AS y_true, CASE WHEN NOT is_masked THEN round(k * y, 6) END AS y_masked, is_masked
FROM g JOIN mb USING (series, pos), (VALUES ('once', 1), ('twice', 2)) AS t(v, k)""",
    "e7_mask_contiguous_patches": GRID + f""", sl AS (SELECT DISTINCT series, pos // 24 AS slot, n FROM g JOIN m USING (series) WHERE pos // 24 < n // 24),
rk AS (SELECT series, slot, row_number() OVER (PARTITION BY series ORDER BY {draw(7, "series", "slot")}, slot) <= greatest(1, round_even((n // 8) * 0.4 / 3, 0)) AS hit FROM sl)
SELECT g.series, pos, coalesce(hit, n // 24 = 0) AS is_masked FROM g JOIN m USING (series) LEFT JOIN rk ON rk.series = g.series AND rk.slot = pos // 24""",
    "e8_adaptive_block": USERS + "SELECT item_id, least(ceil(n / 4.0), 4)::BIGINT AS of_valid, greatest(1, least(floor(ceil(n / 8.0) / 4) + 1, 6))::BIGINT AS of_context FROM u",
    "e9_mask_tail": GRID + f"SELECT series, pos, pos >= n - {draw(7, 'series')} % 96 AS is_tail FROM g JOIN m USING (series)",
    "e10_training_masks": GRID + f", p AS (SELECT series, pos, y, (pos % 3 = 1 OR pos >= n - {draw(7, 'series')} % 96) AND pos >= 5 AS pred_mask FROM g JOIN m USING (series)) SELECT series, pos, pred_mask, pred_mask AND y IS NOT NULL AS loss_mask FROM p",
    "e11_mask_bernoulli": GRID + f", hh AS (SELECT series, pos, {unit(5, 'series', 'pos')} < 0.2 AS hit FROM g) SELECT series, pos, hit OR (NOT bool_or(hit) OVER (PARTITION BY series) AND row_number() OVER (PARTITION BY series ORDER BY {draw(5, 'series', 'pos')}, pos) = 1) AS is_masked FROM hh",
    "f5_train_cut": USERS + f", s AS (SELECT item_id, CAST(3 + floor({unit(0, 'item_id')} * (n - 4)) AS INTEGER) AS split FROM u WHERE n >= 5) SELECT item_id, split, least(split, 6) AS n_context FROM s",
    "f5_test_cut": USERS + "SELECT item_id, CAST(n AS INTEGER) AS split, CAST(least(n, 6) AS INTEGER) AS n_context FROM u",
    "f7_random_window": EVENTS + f""", w AS (SELECT DISTINCT item_id, n, least(n, 3 + floor({unit(5, "item_id")} * 6)) AS k FROM e), z AS (SELECT item_id, k, CAST(k + floor({unit(6, "item_id")} * (n - k + 1)) AS INTEGER) AS stop FROM w)
SELECT item_id, CAST(stop - k AS INTEGER) AS window_start, CAST(k AS INTEGER) AS n, round(value, 6) AS last_value FROM z JOIN e USING (item_id) WHERE pos = stop - 1""",
    "h4_with_fallback": GRID + f", l AS (SELECT series, y_hat AS last FROM f JOIN m USING (series) WHERE pos = n - 1) SELECT series, step, round(CASE WHEN series = 'click' THEN last ELSE y_hat END, 6) AS y_hat FROM ({_SEASONAL}) JOIN l USING (series)",
    # The second half starts from the first half's mean, the last value, whose differences of zero count.
    "h6_rollout": GRID + f""", d AS (SELECT series, pos, y_hat, y_hat - lag(y_hat) OVER (PARTITION BY series ORDER BY pos) AS d FROM f),
l AS (SELECT series, max_by(y_hat, pos) AS last, coalesce(sum(d * d), 0) AS ss, count(d) AS c FROM d GROUP BY 1), z(q, z) AS (VALUES (0.1::DOUBLE, -1.2815515655446004::DOUBLE), (0.5, 0.0), (0.9, 1.2815515655446004))
SELECT series, CAST(k AS INTEGER) AS step, q, round(last + z * sqrt(ss / CASE WHEN k > {HORIZON // 2} THEN c + {HORIZON // 2} ELSE c END) * sqrt((k - 1) % {HORIZON // 2} + 1), 5) AS y_hat FROM l, z, range(1, {HORIZON + 1}) AS r(k)""",
    "h10_select_quantiles": PRED + "SELECT series, step, q, round(y_hat, 5) AS y_hat FROM p WHERE q <> 0.5",
    "h11_sanitize_forecast": GRID + f"SELECT series, step, step % 4 = 0 AS was_missing, CASE WHEN step % 4 = 0 THEN 0.0 ELSE round(y_hat, 6) END AS y_hat FROM ({_SEASONAL})",
    "h13_quantile_rows": PRED + "SELECT series, step, q, round(y_hat, 5) AS y_hat FROM p",
    "k5_sample_series": USERS + f""", v AS (SELECT dataset, count(*) AS k, CASE WHEN count(*) < 100 THEN 0.01 ELSE 1.0 END::DOUBLE AS raw FROM u GROUP BY 1), w AS (SELECT dataset, raw / sum(raw) OVER () / k AS w FROM v)
SELECT item_id, dataset FROM u JOIN w USING (dataset) ORDER BY -ln(({draw(3, "dataset", "item_id")} % {1 << 40} + 1) / {1 << 40}::DOUBLE) / w, item_id LIMIT 20""",
    "k8_motif_tile": EVENTS + f""", w AS (SELECT DISTINCT item_id, CAST(floor({unit(4, "item_id")} * (n - 2)) AS BIGINT) AS start FROM e WHERE n >= 3)
SELECT item_id, 8 AS n, round(max(value) FILTER (WHERE pos = start), 6) AS first_value, round(max(value) FILTER (WHERE pos = start + 1), 6) AS last_value FROM w JOIN e USING (item_id) GROUP BY 1""",
}
