"""Queries of joint least squares and of fitted scaling, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import half, reconstruct, regression, rolling, scalers
from tidemill.sources import series as sources

from .common import GRID, HORIZON, grid, rounded


def order_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily highest price per priority (every fifth day hidden), and two covariates: the number of orders and their lowest price."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = orders.groupBy(F.col("o_orderpriority").alias("series"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("pos")).agg(
        F.max("o_totalprice").alias("top"), F.count("*").cast("double").alias("orders"), F.min("o_totalprice").alias("least")
    )
    target = day.select("series", "pos", F.when(F.pmod("pos", F.lit(5)) != 0, F.col("top")).alias("y"))
    return target, day.unpivot(["series", "pos"], ["orders", "least"], "name", "x").select("series", "name", "pos", "x")


def hours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The hourly grid without its last day, and the hour and the weekday as covariates, known for that day too."""
    long = grid(spark, sf_dir)
    known = long.select("series", "pos", F.hour("ts").cast("double").alias("hour"), F.weekday("ts").cast("double").alias("weekday")).unpivot(["series", "pos"], ["hour", "weekday"], "name", "x")
    n = long.groupBy("series").agg((F.max("pos") + 1).alias("_n"))
    return long.join(n, "series").filter(F.col("pos") < F.col("_n") - HORIZON).select("series", "pos", "y"), known.select("series", "name", "pos", "x")


def joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reconstruct.impute_quantiles(*order_pair(spark, sf_dir)), 2)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regression.fill_by_covariates(*order_pair(spark, sf_dir)).select("series", "pos", "y_hat"), 2)


def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit itself: slopes by name's order, least then orders."""
    fits = regression.fit(*order_pair(spark, sf_dir))
    return rounded(fits.select("series", "n", F.get("slopes", F.lit(0)).alias("of_least"), F.get("slopes", F.lit(1)).alias("of_orders")), 4)


def ahead(spark: SparkSession, sf_dir: str, context: int | None = None) -> DataFrame:
    target, known = hours(spark, sf_dir)
    return rounded(regression.forecast(target, HORIZON, known, context_length=context, levels=[0.1, 0.5, 0.9]), 5)


def round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Statistics of the first 200 hours scale the rest, and bring it back."""
        long = grid(spark, sf_dir).select("series", "pos", "y")
        fitted = scalers.fit(long.filter("pos < 200"), kind)
        there = scalers.transform(long.filter("pos >= 200 and y is not null"), fitted, ["y"])
        back = scalers.inverse(there.withColumn("back", F.col("y")), fitted, ["back"])
        return rounded(back.select("series", "pos", F.col("y").alias("scaled"), "back"), 5)

    return run


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("dataset"), "o_orderkey", F.col("o_totalprice").alias("y_hat"))
    scaled = sources.scaled_predictions(rows).withColumn("bits", half.to_bits(F.col("y_hat")))
    return rounded(scaled.select("o_orderkey", F.col("bits").cast("int").alias("bits"), (half.from_bits(F.col("bits")) * F.col("scale_factor")).alias("read_back")))


QUERIES = {
    "d8_joint": joint,
    "d11_joint_fill": filled,
    "d11_joint_slopes": slopes,
    "h1_covariates": ahead,
    "h1_covariates_capped": lambda s, d: ahead(s, d, 240),
    "g1_inverse": round_trip("standard"),
    "g2_inverse": round_trip("minmax"),
    "g4_inverse": round_trip("asinh"),
    "a6_half_precision": halves,
}

_ORDERS = """WITH dy AS (SELECT o_orderpriority AS series, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS pos, max(o_totalprice) AS top, count(*)::DOUBLE AS x2, min(o_totalprice) AS x1 FROM orders GROUP BY 1, 2),
c AS (SELECT series, pos, CASE WHEN pos % 5 <> 0 THEN top END AS y, x1, x2 FROM dy)"""


def _pair(rows: str, within: str = "y IS NOT NULL") -> str:
    """CTE k: the closed form of least squares on two covariates over the rows of c."""
    return f"""{rows}, q AS (SELECT series, count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS a, covar_pop(x1, x2) AS b, var_pop(x2) AS cc, covar_pop(x1, y) AS d, covar_pop(x2, y) AS e FROM c WHERE {within} GROUP BY 1),
k AS (SELECT *, (d * cc - e * b) / (a * cc - b * b) AS s1, (e * a - d * b) / (a * cc - b * b) AS s2 FROM q),
ln AS (SELECT c.series, pos, y, my + s1 * (x1 - m1) + s2 * (x2 - m2) AS line FROM c JOIN k ON k.series = c.series)
"""


_Z = "z(q, z) AS (VALUES " + ", ".join(f"({q}::DOUBLE, {rolling.z_value(q)!r}::DOUBLE)" for q in rolling.LEVELS) + ")"


def _hours(most: str) -> str:
    rows = GRID + f", c AS (SELECT g.series, pos, CASE WHEN pos < n - {HORIZON} THEN y END AS y, hour(ts)::DOUBLE AS x1, (isodow(ts) - 1)::DOUBLE AS x2, n FROM g JOIN m ON m.series = g.series WHERE {most})"
    return _pair(rows) + f""", sg AS (SELECT series, sqrt(avg((y - line) * (y - line))) AS s FROM ln WHERE y IS NOT NULL GROUP BY 1), {_Z}
SELECT ln.series, CAST(pos - (n - {HORIZON}) + 1 AS INTEGER) AS step, q, round(line + z * s, 5) AS y_hat, round(line, 5) AS point FROM ln JOIN m ON m.series = ln.series JOIN sg ON sg.series = ln.series CROSS JOIN z WHERE pos >= n - {HORIZON} AND q IN (0.1, 0.5, 0.9)"""


def _scaled(centre: str, spread: str, bend: str = "{u}") -> str:
    unit = f"((y - {centre}) / {spread})"
    return GRID + f""", o AS (SELECT series, avg(y) AS a, CASE WHEN stddev_pop(y) = 0 THEN 1e-5 ELSE stddev_pop(y) END AS b, min(y) AS lo, max(y) - min(y) + 1e-8 AS hi FROM g WHERE pos < 200 GROUP BY 1)
SELECT g.series, pos, round({bend.format(u=unit)}, 5) AS scaled, round(y, 5) AS back FROM g JOIN o ON o.series = g.series WHERE pos >= 200 AND y IS NOT NULL"""


ORACLE_SQL = {
    "d8_joint": _pair(_ORDERS) + f""", e2 AS (SELECT *, sqrt(avg((y - line) * (y - line)) OVER (PARTITION BY series)) AS s FROM ln), {_Z} SELECT series, pos, q, round(coalesce(y, line + z * s), 2) AS y_hat FROM e2 CROSS JOIN z""",
    "d11_joint_fill": _pair(_ORDERS) + "SELECT series, pos, round(coalesce(y, line), 2) AS y_hat FROM ln",
    "d11_joint_slopes": _pair(_ORDERS) + "SELECT series, n, round(s1, 4) AS of_least, round(s2, 4) AS of_orders FROM k",
    "h1_covariates": _hours("true"),
    "h1_covariates_capped": _hours(f"pos >= n - {HORIZON} - 240"),
    "g1_inverse": _scaled("a", "b"),
    "g2_inverse": _scaled("lo", "hi"),
    "g4_inverse": _scaled("a", "b", "asinh({u})"),
    "a6_half_precision": """WITH t AS (SELECT o_orderkey, o_totalprice AS v, max(abs(o_totalprice)) OVER (PARTITION BY o_orderpriority) AS top FROM orders),
f AS (SELECT *, CASE WHEN top > 60000 THEN pow(10.0, ceil(log10(top / 60000))) ELSE 1.0 END AS factor FROM t), a AS (SELECT *, v / factor AS x, greatest(floor(log2(v / factor)), -14)::INTEGER AS e0 FROM f),
b AS (SELECT *, e0 + CASE WHEN x >= pow(2.0, e0 + 1) THEN 1 ELSE 0 END - CASE WHEN x < pow(2.0, e0) AND e0 > -14 THEN 1 ELSE 0 END AS e FROM a), c AS (SELECT *, round_even(x / pow(2.0, e - 10), 0) AS u FROM b)
SELECT o_orderkey, CAST((e + 15) * 1024 + u - 1024 AS INTEGER) AS bits, round(u * pow(2.0, e - 10) * factor, 6) AS read_back FROM c""",
}
