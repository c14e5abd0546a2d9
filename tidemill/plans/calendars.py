"""Queries of calendars and of long series by blocks, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import frequency, layout, segmented

from .common import HORIZON, rounded

#: Frequencies of events and of orders, with SQL of a period's label and of the next one's.
_SECONDS = "make_timestamp(CAST(floor(epoch({t}) / {n}) AS BIGINT) * {n} * 1000000)"
EVENTS = {"15T": (_SECONDS.format(t="ts", n=900), "INTERVAL 15 MINUTE"), "6H": (_SECONDS.format(t="ts", n=21_600), "INTERVAL 6 HOUR")}
ORDERS = {
    "W-SUN": "CAST({d} + CAST(7 - isodow({d}) AS INTEGER) AS TIMESTAMP)", "ME": "CAST(last_day({d}) AS TIMESTAMP)", "QE-DEC": "CAST(last_day(CAST(date_trunc('quarter', {d}) AS DATE) + INTERVAL 2 MONTH) AS TIMESTAMP)",
    "B": "CAST({d} - CAST(greatest(isodow({d}) - 5, 0) AS INTEGER) AS TIMESTAMP)", "MS": "CAST(date_trunc('month', {d}) AS TIMESTAMP)",
}


def of_events(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    return frequency.regularize(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", freq)


def of_orders(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    return frequency.regularize(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", freq)


def of_items(spark: SparkSession, sf_dir: str, freq: str) -> DataFrame:
    return frequency.regularize(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "l_shipdate", "l_quantity", freq)


def several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed series of orders by week, month end, quarter and business day, each with its own frequency."""
    out = None
    for freq in ("W-SUN", "ME", "QE-DEC", "B"):
        one = frequency.pack(of_orders(spark, sf_dir, freq), freq).withColumn("series", F.concat(F.lit(freq + " "), "series"))
        out = one if out is None else out.unionByName(one)
    return out


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies found from the labels alone, their seasons, steps and default horizons; and of raw events, which have none."""
    times = of_events(spark, sf_dir, "6H").select(F.concat(F.lit("6H "), "series").alias("series"), "ts").unionByName(frequency.unpack(several(spark, sf_dir)).select("series", "ts"))
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("raw "), "event_type").alias("series"), "ts")
    found = frequency.infer(times.unionByName(raw))
    return found.select("series", "freq", layout.seasonality("freq").alias("season"), layout.default_horizon("freq").alias("horizon"), layout.default_horizon("freq", "long").alias("long_horizon"))


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of some 43,000 minutes, most of them empty."""
    return of_events(spark, sf_dir, "T").select("series", "pos", "y")


#: Positions of a block in the queries: ten or more blocks a series.
BLOCK = 4096


def _filled(method: str, season: int | None = None):
    return lambda s, d: rounded(segmented.impute(minutes(s, d), method, season, BLOCK).select("series", "pos", "y_hat"))


QUERIES = {
    **{f"b12_every_{f.lower()}": lambda s, d, f=f: rounded(of_events(s, d, f)) for f in EVENTS},
    **{f"b12_orders_{f.split('-')[0].lower()}": lambda s, d, f=f: rounded(of_orders(s, d, f)) for f in ORDERS},
    "b12_items_b": lambda s, d: rounded(of_items(s, d, "B")),
    "b12_items_w": lambda s, d: rounded(of_items(s, d, "W-SUN")),
    "b2_unpack_by_freq": lambda s, d: rounded(frequency.unpack(several(s, d))),
    "h12_times_by_freq": lambda s, d: frequency.forecast_times(several(s, d), HORIZON),
    "b6_b9_calendars": inferred,
    "d3_blocks_linear": _filled("linear"),
    "d4_blocks_locf": _filled("locf"),
    "d5_blocks_mean": _filled("mean"),
    "d10_blocks_seasonal": _filled("seasonal", 1440),
    "d9_blocks_islands": lambda s, d: segmented.gap_islands(minutes(s, d), BLOCK),
    "b10_blocks_grid": lambda s, d: rounded(segmented.time_grid(minutes(s, d), BLOCK).select("series", "pos", "coord"), 8),
    "g1_blocks_scale": lambda s, d: rounded(segmented.standard_scale(minutes(s, d), block=BLOCK).filter("y is not null").select("series", "pos", "scaled")),
    "g2_blocks_scale": lambda s, d: rounded(segmented.minmax_scale(minutes(s, d), block=BLOCK).filter("y is not null").select("series", "pos", "scaled")),
    "i4_blocks_seasonal_error": lambda s, d: rounded(segmented.seasonal_error(minutes(s, d), 24, 512)),
}


def regular(table: str, series: str, day: str, value: str, label: str, following: str) -> str:
    """CTEs l (labels' means) and g (series, pos, ts, y): spine from each series' first label to its last.  ``following`` is SQL of
    the labels between lo and hi."""
    return f"""WITH e AS (SELECT {series} AS series, {day}, {value} AS v FROM {table}), l AS (SELECT series, {label} AS ts, avg(v) AS y FROM e GROUP BY 1, 2),
b AS (SELECT series, min(ts) AS lo, max(ts) AS hi FROM l GROUP BY 1), s AS (SELECT DISTINCT series, ts FROM (SELECT series, lo, hi, {following} AS ts FROM b) WHERE ts BETWEEN lo AND hi),
g AS (SELECT s.series, CAST(row_number() OVER (PARTITION BY s.series ORDER BY s.ts) - 1 AS INTEGER) AS pos, s.ts, l.y FROM s LEFT JOIN l ON l.series = s.series AND l.ts = s.ts)
"""


def _events(freq: str) -> str:
    label, step = EVENTS[freq]
    return regular("events", "event_type", "ts", "value", label, f"unnest(generate_series(lo, hi, {step}))")


def _days(table: str, series: str, day: str, value: str, freq: str) -> str:
    """Labels of all days between are the spine."""
    days = "unnest(generate_series(lo - INTERVAL 100 DAY, hi + INTERVAL 100 DAY, INTERVAL 1 DAY))"
    made = regular(table, series, f"CAST({day} AS DATE) AS d", value, ORDERS[freq].format(d="d"), "@")
    return made.replace("(SELECT series, lo, hi, @ AS ts FROM b)", f"(SELECT series, lo, hi, {ORDERS[freq].format(d='x')} AS ts FROM (SELECT series, lo, hi, CAST({days} AS DATE) AS x FROM b))")


def _orders(freq: str) -> str:
    return _days("orders", "o_orderpriority", "o_orderdate", "o_totalprice", freq)


_ROWS = "SELECT series, pos, ts, round(y, 6) AS y FROM g"
_MIN = regular("events", "event_type", "ts", "value", "date_trunc('minute', ts)::TIMESTAMP", "unnest(generate_series(lo, hi, INTERVAL 1 MINUTE))")
_BACK = "OVER (PARTITION BY series ORDER BY pos ROWS UNBOUNDED PRECEDING)"
_AHEAD = "OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_SPOT = "CASE WHEN y IS NOT NULL THEN pos END"
_NEAR = f""", x AS (SELECT series, pos, y, last_value({_SPOT} IGNORE NULLS) {_BACK} AS p0, first_value({_SPOT} IGNORE NULLS) {_AHEAD} AS p1, last_value(y IGNORE NULLS) {_BACK} AS v0, first_value(y IGNORE NULLS) {_AHEAD} AS v1,
  last_value(y IGNORE NULLS) OVER (PARTITION BY series, pos % 1440 ORDER BY pos ROWS UNBOUNDED PRECEDING) AS same FROM g)
"""


def _several() -> tuple[str, str]:
    """The four calendars' g, as CTEs of their own, and their union with the frequency before the series' name."""
    ctes, union = [], []
    for k, freq in enumerate(("W-SUN", "ME", "QE-DEC", "B")):
        ctes.append(f"c{k} AS ({_orders(freq)} SELECT series, pos, ts, y FROM g)")
        union.append(f"SELECT concat('{freq} ', series) AS series, '{freq}' AS freq, pos, ts, y FROM c{k}")
    return "WITH " + ",\n".join(ctes), " UNION ALL ".join(union)


_CTES, _UNION = _several()
#: Labels of the spine run on: enough days behind a series' last label to hold its next 24.
_AHEAD_LABELS = {"W-SUN": 200, "ME": 800, "QE-DEC": 2300, "B": 60}


def _times() -> str:
    parts = []
    for k, freq in enumerate(("W-SUN", "ME", "QE-DEC", "B")):
        days = f"CAST(unnest(generate_series(hi, hi + INTERVAL {_AHEAD_LABELS[freq]} DAY, INTERVAL 1 DAY)) AS DATE)"
        parts.append(
            f"SELECT concat('{freq} ', series) AS series, CAST(row_number() OVER (PARTITION BY series ORDER BY ts) AS INTEGER) AS step, ts FROM (SELECT DISTINCT series, ts FROM "
            f"(SELECT series, hi, {ORDERS[freq].format(d='x')} AS ts FROM (SELECT series, hi, {days} AS x FROM (SELECT series, max(ts) AS hi FROM c{k} GROUP BY 1))) WHERE ts > hi)"
        )
    return _CTES + f" SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE step <= {HORIZON}"


ORACLE_SQL = {
    **{f"b12_every_{f.lower()}": _events(f) + _ROWS for f in EVENTS},
    **{f"b12_orders_{f.split('-')[0].lower()}": _orders(f) + _ROWS for f in ORDERS},
    "b12_items_b": _days("lineitem", "l_returnflag", "l_shipdate", "l_quantity", "B") + _ROWS,
    "b12_items_w": _days("lineitem", "l_returnflag", "l_shipdate", "l_quantity", "W-SUN") + _ROWS,
    "b2_unpack_by_freq": _CTES + f" SELECT series, pos, ts, round(y, 6) AS y FROM ({_UNION})",
    "h12_times_by_freq": _times(),
    "b6_b9_calendars": _CTES
    + f""", n AS (SELECT series, freq FROM ({_UNION}) GROUP BY 1, 2 UNION ALL SELECT DISTINCT concat('6H ', event_type), '6H' FROM events UNION ALL SELECT DISTINCT concat('raw ', event_type), NULL FROM events),
v(freq, season, horizon) AS (VALUES ('W-SUN', 1, 8), ('ME', 12, 12), ('QE-DEC', 4, 8), ('B', 5, 21), ('6H', 4, 48))
SELECT series, n.freq, coalesce(season, 1) AS season, horizon, horizon * 15 AS long_horizon FROM n LEFT JOIN v ON v.freq = n.freq""",
    "d3_blocks_linear": _MIN + _NEAR + "SELECT series, pos, round(coalesce(y, v0 + (v1 - v0) * (pos - p0) / (p1 - p0), v0, v1, 0.0), 6) AS y_hat FROM x",
    "d4_blocks_locf": _MIN + _NEAR + "SELECT series, pos, round(coalesce(y, v0, v1, 0.0), 6) AS y_hat FROM x",
    "d5_blocks_mean": _MIN + "SELECT series, pos, round(coalesce(y, avg(y) OVER (PARTITION BY series), 0.0), 6) AS y_hat FROM g",
    "d10_blocks_seasonal": _MIN + _NEAR + "SELECT series, pos, round(coalesce(y, same, v0, v1, 0.0), 6) AS y_hat FROM x",
    "d9_blocks_islands": _MIN + ", i AS (SELECT series, pos, pos - row_number() OVER (PARTITION BY series ORDER BY pos) AS k FROM g WHERE y IS NULL) SELECT series, min(pos) AS gap_start, max(pos) AS gap_end, count(*) AS gap_len FROM i GROUP BY series, k",
    "b10_blocks_grid": _MIN + "SELECT series, pos, round(pos / (count(*) OVER (PARTITION BY series) - 1), 8) AS coord FROM g",
    "g1_blocks_scale": _MIN + "SELECT * FROM (SELECT series, pos, round((y - avg(y) OVER w) / CASE WHEN stddev_pop(y) OVER w = 0 THEN 1e-5 ELSE stddev_pop(y) OVER w END, 6) AS scaled FROM g WINDOW w AS (PARTITION BY series)) WHERE scaled IS NOT NULL",
    "g2_blocks_scale": _MIN + "SELECT * FROM (SELECT series, pos, round((y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w + 1e-8), 6) AS scaled FROM g WINDOW w AS (PARTITION BY series)) WHERE scaled IS NOT NULL",
    "i4_blocks_seasonal_error": _MIN + ", d AS (SELECT series, abs(y - lag(y, 24) OVER (PARTITION BY series ORDER BY pos)) AS d FROM g WHERE y IS NOT NULL) SELECT series, round(nullif(avg(d), 0), 6) AS scale FROM d GROUP BY 1",
}
