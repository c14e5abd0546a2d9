"""Joint least squares of a target on any number of covariates, per series, and what is filled and forecast with it.

Sums of products are aggregates that merge, so a series is never gathered: its rows are reduced where they lie to a
Gram matrix of a row and a column for each covariate.  That is solved by a Cholesky factorisation on arrays, inside the
engine.  Covariates are centred and brought to unit length first; where they are dependent (a pivot all but vanishes) a
small ridge is added, and a covariate that is constant has no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import forecast as baselines
from . import reconstruct, shape
from .common import checkpointed
from .missing import impute
from .rolling import LEVELS, checked_levels, computed, z_value

#: Least pivot of a matrix with unit diagonal that counts as independent, and the ridge added otherwise.
PIVOT, RIDGE = 1e-9, 1e-6


def _zero() -> Column:
    return F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _zero(), lambda s, v: s + v)


def cholesky(a: Column) -> Column:
    """The lower factor, row by row (each of its own length), of a symmetric matrix given as an array of rows."""
    empty = F.array().cast("array<double>")

    def row(factor, target):
        """One row more: each entry from the ones before it; the last is the root of what is left (0 where that is negative)."""
        i = F.size(factor)
        before = F.aggregate(
            F.sequence(F.lit(0), i), empty,
            lambda own, j: F.when(F.size(own) >= i, own).otherwise(
                F.concat(own, F.array(F.coalesce(F.try_divide(F.get(target, j) - dot(own, F.slice(F.get(factor, j), 1, F.size(own))), F.get(F.get(factor, j), j)), _zero())))
            ),
        )
        return F.concat(before, F.array(F.sqrt(F.greatest(_zero(), F.get(target, i) - dot(before, before)))))

    return F.aggregate(a, F.array().cast("array<array<double>>"), lambda factor, target: F.concat(factor, F.array(row(factor, target))))


def solve(factor: Column, b: Column) -> Column:
    """x of L L' x = b: forward, then backward substitution.  A zero pivot gives a zero."""
    empty = F.array().cast("array<double>")
    forward = F.aggregate(
        factor, empty, lambda y, row: F.concat(y, F.array(F.coalesce(F.try_divide(F.get(b, F.size(y)) - dot(F.slice(row, 1, F.size(y)), y), F.get(row, F.size(y))), _zero())))
    )

    def back(x, i):
        """x holds the entries after i, in order; column i of L below the diagonal is what multiplies them."""
        below = F.transform(F.slice(factor, i + 2, F.size(factor)), lambda row: F.get(row, i))
        return F.concat(F.array(F.coalesce(F.try_divide(F.get(forward, i) - dot(below, x), F.get(F.get(factor, i), i)), _zero())), x)

    return F.aggregate(F.reverse(F.sequence(F.lit(0), F.size(factor) - 1)), empty, back)


def _vectors(covariates: DataFrame) -> DataFrame:
    """(series, pos, xs): the values of a series' covariates in the order of their names, at positions where all are there."""
    names = covariates.groupBy("series").agg(F.count_distinct("name").alias("_k"))
    rows = covariates.filter("x is not null and not isnan(x)").groupBy("series", "pos").agg(F.sort_array(F.collect_list(F.struct("name", "x"))).alias("_v"))
    rows = rows.join(names, "series").filter(F.size("_v") == F.col("_k"))
    return rows.select("series", "pos", F.transform("_v", lambda v: v["x"]).alias("xs"))


def fit(long: DataFrame, covariates: DataFrame) -> DataFrame:
    """(series, n, y_mean, x_means, slopes): least squares of y on all covariates and a constant.

    ``long`` is (series, pos, y), ``covariates`` (series, name, pos, x).  Positions count where y and all covariates are there.
    Slopes follow the covariates' names in order.  A series without such positions has no row."""
    rows = long.filter("y is not null and not isnan(y)").select("series", "pos", "y").join(_vectors(covariates), ["series", "pos"])
    each = rows.select("series", "y", F.posexplode("xs").alias("i", "x"))
    means = each.groupBy("series", "i").agg(F.avg("x").alias("m"), F.avg("y").alias("y_mean"), F.count("*").alias("n"))
    means = means.groupBy("series").agg(F.max("n").alias("n"), F.max("y_mean").alias("y_mean"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("x_means"))
    # y stands behind the covariates, so one set of sums holds both sides of the equations.
    centred = rows.join(means, "series").select("series", "n", "y_mean", "x_means", F.concat(F.zip_with("xs", "x_means", lambda x, m: x - m), F.array(F.col("y") - F.col("y_mean"))).alias("v"))
    pairs = F.filter(
        F.flatten(F.transform("v", lambda a, i: F.transform("v", lambda b, j: F.struct(i.alias("i"), j.alias("j"), (a * b).alias("p"))))), lambda s: (s["i"] <= s["j"])
    )
    known = ["n", "y_mean", "x_means"]
    sums = centred.select("series", *known, F.explode(pairs).alias("s")).groupBy("series", "s.i", "s.j").agg(F.sum("s.p").alias("p"), *[F.first(c).alias(c) for c in known])
    # Each sum below the diagonal stands above it too.
    ends = F.when(F.col("i") < F.col("j"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    both = sums.select("series", *known, "p", F.explode(ends).alias("at")).select("series", *known, "p", "at.*")
    grams = both.groupBy("series").agg(*[F.first(c).alias(c) for c in known], F.sort_array(F.collect_list(F.struct("i", "j", "p"))).alias("_g"))
    grams = computed(grams.select("series", *known, F.transform("_g", lambda s: s["p"]).alias("_all")), ["series"])
    side_by_side = F.transform(F.sequence(F.lit(0), F.size("x_means")), lambda i: F.slice("_all", i * (F.size("x_means") + 1) + 1, F.size("x_means") + 1))
    grams = grams.select("series", *known, side_by_side.alias("g"))
    k = F.size("g") - 1
    grams = computed(grams.withColumn("unit", F.transform(F.slice("g", 1, k), lambda row, i: F.sqrt(F.get(row, i)))), ["series"])
    # A constant covariate has no length: its row and column become those of the identity, and its side 0.
    real = lambda i: F.get(F.col("unit"), i) > 0

    def scaled(ridge: float) -> Column:
        return F.transform(
            F.slice("g", 1, k),
            lambda row, i: F.transform(F.slice(row, 1, k), lambda v, j: F.when(i == j, 1.0 + ridge).otherwise(F.when(real(i) & real(j), v / (F.get("unit", i) * F.get("unit", j))).otherwise(_zero()))),
        )

    side = F.transform(F.slice("g", 1, k), lambda row, i: F.when(real(i), F.get(row, k) / F.get("unit", i)).otherwise(_zero()))
    solved = computed(grams.withColumn("side", side).withColumn("plain", cholesky(scaled(0.0))), ["series"])
    weak = F.exists(F.transform("plain", lambda row: F.element_at(row, -1)), lambda d: d * d <= PIVOT)
    solved = computed(solved.withColumn("factor", F.when(weak, cholesky(scaled(RIDGE))).otherwise(F.col("plain"))), ["series"])
    solved = computed(solved.withColumn("x", solve(F.col("factor"), F.col("side"))), ["series"])
    slopes = F.transform("x", lambda v, i: F.when(real(i), v / F.get("unit", i)).otherwise(_zero()))
    # A row for each series, used wherever its line is: computed once.
    return checkpointed(solved.select("series", "n", "y_mean", "x_means", slopes.alias("slopes")))


def lines(fits: DataFrame, covariates: DataFrame) -> DataFrame:
    """(series, pos, line): the fitted value wherever all covariates of a fitted series are there."""
    rows = _vectors(covariates).join(fits, "series")
    return rows.select("series", "pos", (F.col("y_mean") + dot(F.zip_with("xs", "x_means", lambda x, m: x - m), F.col("slopes"))).alias("line"))


def fill_by_covariates(long: DataFrame, covariates: DataFrame) -> DataFrame:
    """Adds ``y_hat``: observed values, else the joint fit on all covariates, else linear interpolation."""
    rows = impute(long, "linear").withColumnRenamed("y_hat", "_linear")
    rows = rows.join(lines(fit(long, covariates), covariates), ["series", "pos"], "left")
    return rows.withColumn("y_hat", F.coalesce("y", "line", "_linear")).drop("_linear", "line")


def ahead(context: DataFrame, covariates: DataFrame, horizon: int, method: str, season: int) -> DataFrame:
    """``covariates`` and, for those that end with the context, ``horizon`` more values by ``method``."""
    ends = context.groupBy("series").agg((F.max("pos") + 1).alias("_n"))
    known = covariates.filter("x is not null").groupBy("series", "name").agg(F.max("pos").alias("_end")).join(ends, "series")
    past_only = known.filter(F.col("_end") < F.col("_n")).select("series", "name")
    own = covariates.join(past_only, ["series", "name"], "left_semi").join(ends, "series").filter(F.col("pos") < F.col("_n"))
    packed = own.select(F.struct("series", "name").alias("series"), "pos", F.col("x").alias("y"))
    made = (baselines.seasonal_naive(packed, horizon, season) if method == "seasonal_naive" else baselines.seasonal_naive(packed, horizon, 1)).select("series.*", "step", "y_hat")
    made = made.join(ends, "series").select("series", "name", (F.col("_n") + F.col("step") - 1).cast("int").alias("pos"), F.col("y_hat").alias("x"))
    return covariates.select("series", "name", "pos", "x").unionByName(made)


def forecast(
    long: DataFrame, horizon: int, covariates: DataFrame | None = None, context_length: int | None = None, method: str = "seasonal_naive", season: int = 24,
    levels: list[float] = LEVELS, point: str = "mean", auto_complete: bool = False, forecast_covariates: bool = False,
) -> DataFrame:
    """(series, step, q, y_hat, point) of the ``horizon`` positions after each series' end.

    The context is the last ``context_length`` positions, of the covariates too.  ``auto_complete`` closes its gaps and those of the
    covariates first (linear).  With covariates a joint least-squares fit on the context gives the middle where all of a
    series' covariates are known, with the root mean square of the fit's residuals as deviation; elsewhere, and without covariates, the
    method does: ``naive`` or ``seasonal_naive``, with the deviations of those.  Covariates that end with the context are left out of the fit, or,
    with ``forecast_covariates``, are forecast by the method and then count as known; others must be there for all of the horizon, or ValueError names their series.
    ``point`` is the mean over the levels or the median.
    """
    if horizon < 1 or season < 1 or context_length is not None and context_length < 1:
        raise ValueError("horizon, season and context length must be positive")
    if method not in ("naive", "seasonal_naive") or point not in ("mean", "median"):
        raise ValueError("method is naive or seasonal_naive, point mean or median")
    wanted = checked_levels(levels)
    context = long.select("series", "pos", "y")
    if context_length is not None:
        context = shape.last_context(context, context_length)
    if auto_complete:
        context = impute(context, "linear").select("series", "pos", F.col("y_hat").alias("y"))
    # Positions of the context count from 0, as the baselines want it.
    first = context.groupBy("series").agg(F.min("pos").alias("_first"), F.max("pos").alias("_last"))
    context = context.join(first, "series").select("series", (F.col("pos") - F.col("_first")).cast("int").alias("pos"), "y")
    plain = baselines.naive_quantiles(context, horizon, wanted) if method == "naive" else baselines.seasonal_naive_quantiles(context, horizon, season, wanted)
    out = plain.select("series", "step", "q", "y_hat")
    if covariates is not None:
        n = F.col("_last") - F.col("_first") + 1
        x = covariates.join(first, "series").withColumn("pos", (F.col("pos") - F.col("_first")).cast("int")).filter((F.col("pos") >= 0) & (F.col("pos") < n + horizon))
        reach = x.groupBy("series", "name").agg(F.max("pos").alias("_end"), F.first(n).alias("_n"))
        short = reach.filter((F.col("_end") >= F.col("_n")) & (F.col("_end") < F.col("_n") + horizon - 1)).select("series").limit(5).collect()
        if short:
            raise ValueError(f"covariates of series {[r['series'] for r in short]} end within the horizon")
        x = x.select("series", "name", "pos", "x")
        if auto_complete:
            x = reconstruct.complete_covariates(x)
        if forecast_covariates:
            x = ahead(context, x, horizon, method, season)
        else:
            x = x.join(reach.filter(F.col("_end") >= F.col("_n")).select("series", "name"), ["series", "name"], "left_semi")
        line = lines(fit(context, x), x)
        residual = F.sqrt(F.avg((F.col("y") - F.col("line")) * (F.col("y") - F.col("line"))))
        spread = context.join(line, ["series", "pos"]).groupBy("series").agg(F.coalesce(residual, F.lit(0.0)).alias("_spread"))
        ends = context.groupBy("series").agg((F.max("pos") + 1).alias("_n"))
        middle = line.join(ends, "series").join(spread, "series").select("series", (F.col("pos") - F.col("_n") + 1).cast("int").alias("step"), "line", "_spread").filter(F.col("step") >= 1)
        z = F.coalesce(*[F.when(F.abs(F.col("q") - q) < 1e-9, F.lit(z_value(q))) for q in wanted])
        out = out.join(middle, ["series", "step"], "left").withColumn("y_hat", F.coalesce(F.col("line") + z * F.col("_spread"), "y_hat")).drop("line", "_spread")
    each = Window.partitionBy("series", "step")
    value = F.avg("y_hat").over(each) if point == "mean" else F.max(F.when(F.abs(F.col("q") - 0.5) < 1e-9, F.col("y_hat"))).over(each)
    return out.withColumn("point", value)
