"""Queries of weighted draws and training tables, with the SQL that says the same, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import evaluation, sampling

from .common import rounded
from .draws import draw, unit
from .more import USERS, user_series

N, LENGTH, PATCH, MOST, RATIO = 64, 16, 2, 3, 0.4


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values as items of (dataset, file): the user's id modulo 5, and modulo 3."""
    return user_series(spark, sf_dir).withColumn("file", F.pmod("item_id", F.lit(3)).cast("string"))


def weights(rows: DataFrame) -> DataFrame:
    return evaluation.dataset_weights(evaluation.corpus_inventory(rows, 1), F.when(F.col("dataset") < "2", F.lit("low")))


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_series(spark, sf_dir).select(F.col("dataset").alias("source"), "item_id", F.size("target").alias("n"))
    return sampling.sample_mixture(rows, rows.groupBy("source").agg(F.sum("n").cast("double").alias("weight")), 50, 8)


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return sampling.sample_hierarchy(rows, weights(rows), N).select("dataset", "file", "item_id")


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.sample_resolution(user_series(spark, sf_dir), LENGTH, 3, seed=10)
    return rounded(rows.select("item_id", "resolution", "window_start", F.size("target").alias("n"), F.element_at("target", 1).alias("first_value"), F.element_at("target", -1).alias("last_value")))


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table, a row for each position."""
    rows = items(spark, sf_dir)
    # Every seventh value is missing, by its place.
    rows = rows.withColumn("target", F.transform("target", lambda v, i: F.when(F.pmod(i, F.lit(7)) != 6, v)))
    made = sampling.training_table(rows, weights(rows.filter(F.size("target") >= 3)), N, LENGTH, 3, PATCH, MOST, RATIO)
    each = F.posexplode(F.arrays_zip("target", "pad_mask", "miss_mask", "pred_mask", "loss_mask")).alias("pos", "z")
    return rounded(made.select("dataset", "item_id", "resolution", each).select("dataset", "item_id", "resolution", "pos", F.col("z.target").alias("y"), "z.pad_mask", "z.miss_mask", "z.pred_mask", "z.loss_mask"))


QUERIES = {"k7_sample_mixture": mixture, "k5_sample_hierarchy": hierarchy, "f8_sample_resolution": resolutions, "k9_training_table": table}

ITEMS = """WITH u AS (SELECT user_id AS item_id, CAST(user_id % 5 AS VARCHAR) AS dataset, CAST(user_id % 3 AS VARCHAR) AS file, list(value ORDER BY ts, event_id) AS vals, count(*) AS n FROM events GROUP BY 1)
"""


def _shares(rows: str, name: str, weight: str, group: str | None = None) -> str:
    own = f"PARTITION BY {group} " if group else ""
    return f"""SELECT *, coalesce(lag(hi) OVER ({own}ORDER BY {name}), 0) AS lo, CASE WHEN row_number() OVER ({own}ORDER BY {name} DESC) = 1 THEN 2 ELSE hi END AS up
FROM (SELECT *, sum({weight}) OVER ({own}ORDER BY {name} ROWS UNBOUNDED PRECEDING) / sum({weight}) OVER ({f'PARTITION BY {group}' if group else ''}) AS hi FROM {rows})"""


def _hierarchy(rows: str) -> str:
    """CTE picked (dataset, file, item_id): seeds 0 and 1 for the draws, 2 for rows of a file, 3 for what a data set makes up."""
    file_key = "concat_ws('/', dataset, file)"
    return f"""iv AS (SELECT dataset, count(*) AS k FROM {rows} GROUP BY 1), rw AS (SELECT dataset, CASE WHEN dataset < '2' THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY dataset < '2') WHEN k < 100 THEN 0.01 ELSE 1.0 END::DOUBLE AS r FROM iv),
dw AS (SELECT dataset, r / sum(r) OVER () AS w FROM rw), ds AS ({_shares("dw", "dataset", "w")}), fl AS (SELECT dataset, file, count(*)::DOUBLE AS c FROM {rows} GROUP BY 1, 2), fs AS ({_shares("fl", "file", "c", "dataset")}),
dr AS (SELECT id, {unit(0, "id")} AS p, {unit(1, "id")} AS v FROM range(0, {N}) AS t(id)),
wanted AS (SELECT ds.dataset, fs.file, count(*) AS q FROM dr JOIN ds ON p >= ds.lo AND p < ds.up JOIN fs ON fs.dataset = ds.dataset AND v >= fs.lo AND v < fs.up GROUP BY 1, 2),
lacking AS (SELECT dataset, sum(greatest(q - c, 0)) AS q FROM wanted JOIN fl USING (dataset, file) GROUP BY 1),
rk AS (SELECT dataset, file, item_id, row_number() OVER (PARTITION BY {file_key} ORDER BY {draw(2, "item_id")}, item_id) AS k FROM {rows}),
tk AS (SELECT rk.*, k <= coalesce(q, 0) AS taken FROM rk LEFT JOIN wanted USING (dataset, file)),
mo AS (SELECT dataset, file, item_id, row_number() OVER (PARTITION BY dataset ORDER BY {draw(3, "item_id")}, item_id) AS k FROM tk WHERE NOT taken),
picked AS (SELECT dataset, file, item_id FROM tk WHERE taken UNION ALL SELECT mo.dataset, file, item_id FROM mo JOIN lacking USING (dataset) WHERE k <= q)
"""


def _resolved(rows: str) -> str:
    """CTE cu (..., r, start, k values, w): windows at drawn resolutions, seeds 10 to 12."""
    total = sum(1 / r for r in range(1, 16))
    bounds, upto = [], 0.0
    for r in range(1, 15):
        upto += 1 / r / total
        bounds.append(f"WHEN d < {upto!r}::DOUBLE THEN {r}")
    return f"""re AS (SELECT *, CASE {' '.join(bounds)} ELSE 15 END AS r FROM (SELECT *, {unit(10, "item_id")} AS d FROM {rows})),
wn AS (SELECT *, least(n, (3 + floor({unit(11, "item_id")} * {LENGTH - 2})) * r)::BIGINT AS len FROM re), st AS (SELECT *, (floor({unit(12, "item_id")} * (n - len + 1)))::BIGINT AS start FROM wn),
cu AS (SELECT *, list_transform(range(0, len, r), lambda i: vals[start + i + 1]) AS w FROM st)
"""


ORACLE_SQL = {
    "k7_sample_mixture": USERS
    + f""", w AS (SELECT dataset AS source, sum(n)::DOUBLE AS weight FROM u GROUP BY 1), s AS ({_shares("w", "source", "weight")}), b AS (SELECT batch_id, {unit(0, "batch_id")} AS p FROM range(0, 50) AS t(batch_id)),
c AS (SELECT batch_id, source, row_number() OVER (PARTITION BY source ORDER BY {draw(0, "batch_id")}, batch_id) - 1 AS turn FROM b JOIN s ON p >= lo AND p < up),
r AS (SELECT dataset AS source, item_id, n, row_number() OVER (PARTITION BY dataset ORDER BY {draw(1, "item_id")}, item_id) - 1 AS k, count(*) OVER (PARTITION BY dataset) AS total FROM u)
SELECT c.source, batch_id, CAST(slot AS INTEGER) AS slot, item_id, CAST(n AS INTEGER) AS n FROM c, range(0, 8) AS q(slot) JOIN r ON r.source = c.source AND r.k = (turn * 8 + slot) % r.total""",
    "k5_sample_hierarchy": ITEMS + f", {_hierarchy('u')} SELECT dataset, file, item_id FROM picked",
    "f8_sample_resolution": ITEMS + f", {_resolved('u')} SELECT item_id, r AS resolution, CAST(start AS INTEGER) AS window_start, CAST(len(w) AS INTEGER) AS n, round(w[1], 6) AS first_value, round(w[-1], 6) AS last_value FROM cu",
    "k9_training_table": ITEMS
    + f""", lg AS (SELECT item_id, dataset, file, n, list_transform(vals, lambda v, i: CASE WHEN i % 7 <> 0 THEN v END) AS vals FROM u WHERE n >= 3), {_hierarchy('lg')}, sm AS (SELECT lg.* FROM lg JOIN picked USING (dataset, file, item_id)), {_resolved('sm')},
bk AS (SELECT *, len(w) AS ctx, greatest(1, least(floor(ceil(len(w) / {PATCH}.0) / 4) + 1, {MOST}))::INTEGER AS block FROM cu), ns AS (SELECT *, greatest(1, {LENGTH // PATCH} // block) AS slots FROM bk),
nb AS (SELECT *, least(greatest(1, round_even({LENGTH // PATCH} * {RATIO} / block, 0)), slots)::INTEGER AS blocks, {draw(21, "item_id")} % (4 * block * {PATCH} + 1) AS tail FROM ns),
sl AS (SELECT item_id, s, row_number() OVER (PARTITION BY item_id ORDER BY {draw(20, "item_id", "s")}, s) <= blocks AS hit FROM (SELECT item_id, blocks, unnest(range(0, slots)) AS s FROM nb)),
ps AS (SELECT dataset, item_id, r AS resolution, i AS pos, CASE WHEN i >= {LENGTH} - ctx THEN w[i - ({LENGTH} - ctx) + 1] END AS y, i < {LENGTH} - ctx AS pad, i >= {LENGTH} - tail AS in_tail, (i // {PATCH}) // block AS slot FROM nb, range(0, {LENGTH}) AS t(i)),
pm AS (SELECT ps.*, y IS NULL AND NOT pad AS miss, (in_tail OR coalesce(hit, false)) AND NOT pad AS pred FROM ps LEFT JOIN sl ON sl.item_id = ps.item_id AND sl.s = ps.slot)
SELECT dataset, item_id, resolution, CAST(pos AS INTEGER) AS pos, round(y, 6) AS y, pad AS pad_mask, miss AS miss_mask, pred AS pred_mask, pred AND NOT miss AS loss_mask FROM pm""",
}
