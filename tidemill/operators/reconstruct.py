"""Imputation with quantiles and covariates, and the scores of imputed positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import level, pinball
from .forecast import seasonal_error
from .missing import back, first_ahead, impute, whole
from .rolling import LEVELS, checked_levels, z_value


def complete_covariates(covariates: DataFrame, method: str = "linear", season: int | None = None) -> DataFrame:
    """Missing values of each covariate (series, name, pos, x) imputed on its own; observed ones are kept."""
    own = covariates.select(F.struct("series", "name").alias("series"), "pos", F.col("x").alias("y"))
    return impute(own, method, season).select("series.*", "pos", F.col("y_hat").alias("x"))


def covariate_lines(long: DataFrame, covariates: DataFrame) -> DataFrame:
    """(series, pos, line): the joint least-squares fit on all of a series' covariates, where they are all there; constant ones do not count."""
    from .regression import fit, lines

    return lines(fit(long, covariates), covariates)


def impute_quantiles(
    long: DataFrame, covariates: DataFrame | None = None, method: str = "linear", season: int | None = None,
    levels: list[float] = LEVELS, keep_observed: bool = True, auto_complete: bool = False,
) -> DataFrame:
    """(series, pos, q, y_hat) at every position of ``long`` (series, pos, y).

    The middle is the joint fit on the covariates where there is one, else the method's value.  Its deviation is the root mean square
    of the line's residuals, else that of a random walk tied to the observed neighbours: sigma^2 (mean squared difference of
    neighbours over their distance) times d1 d2 / (d1 + d2), d the distances to them, or the distance to the only one.
    Without observed values all is 0.  ``keep_observed`` puts the observed value at every level; otherwise the line
    stands there too (methods without covariates pass through observed values anyway).  ``auto_complete`` first imputes
    the covariates, one by one; they are on the target's grid, NULL where missing.
    """
    wanted = checked_levels(levels)
    earlier = Window.partitionBy("series").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("y").isNotNull(), F.col("pos"))
    before, after = F.last(seen, True).over(back()) - F.col("pos"), first_ahead(seen) - F.col("pos")
    neighbour = F.last(F.when(F.col("y").isNotNull(), F.struct("pos", "y")), True).over(earlier)
    rows = impute(long.select("series", "pos", "y"), method, season).withColumn("_d1", -before).withColumn("_d2", after).withColumn("_last", neighbour)
    jump = F.col("y") - F.col("_last.y")
    sigma = F.coalesce(F.sqrt(F.avg(jump * jump / (F.col("pos") - F.col("_last.pos"))).over(whole())), F.lit(0.0))
    wide = F.coalesce(F.try_divide(F.col("_d1") * F.col("_d2"), F.col("_d1") + F.col("_d2")), F.when(F.col("y").isNull(), F.coalesce("_d1", "_d2")), F.lit(0.0))
    rows = rows.withColumn("_spread", sigma * F.sqrt(wide)).withColumnRenamed("y_hat", "_middle")
    if covariates is not None:
        known = complete_covariates(covariates, method, season) if auto_complete else covariates
        rows = rows.join(covariate_lines(long, known), ["series", "pos"], "left")
        residual = F.col("y") - F.col("line")
        rows = rows.withColumn("_residual", F.sqrt(F.avg(residual * residual).over(whole())))
        rows = rows.withColumn("_spread", F.when(F.col("line").isNotNull(), F.col("_residual")).otherwise(F.col("_spread")))
        rows = rows.withColumn("_middle", F.coalesce("line", "_middle"))
    if keep_observed:
        rows = rows.withColumn("_spread", F.when(F.col("y").isNotNull(), 0.0).otherwise(F.col("_spread"))).withColumn("_middle", F.coalesce("y", "_middle"))
    pairs = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(z_value(q)).alias("z")) for q in wanted])
    each = rows.select("series", "pos", "_middle", "_spread", F.explode(pairs).alias("p"))
    return each.select("series", "pos", "p.q", (F.col("_middle") + F.col("p.z") * F.col("_spread")).alias("y_hat"))


def masked_quantile_eval(pred: DataFrame, truth: DataFrame, season: int) -> DataFrame:
    """n, MAE, RMSE, ND and MASE of the 0.5 level and CRPS over the levels, per series, over masked positions with truth.

    ``pred`` is (series, pos, q, y_hat), ``truth`` (series, pos, y_true, is_masked).  MASE is scaled by the seasonal error of
    the full truth, masked positions included; NULL where that is zero or the series too short.
    """
    full = truth.select("series", "pos", F.col("y_true").alias("y"), "is_masked")
    rows = full.filter("is_masked and y is not null").join(pred, ["series", "pos"])
    error = F.col("y") - F.col("y_hat")
    by_level = rows.groupBy("series", "q").agg(
        F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.try_divide(F.sum(F.abs(error)), F.sum(F.abs("y"))).alias("nd"), F.try_divide(F.sum(pinball()), F.sum(F.abs("y"))).alias("_loss"),
    )
    middle = [F.max(F.when(level(0.5), F.col(c))).alias(c) for c in ("n", "mae", "rmse", "nd")]
    scores = by_level.groupBy("series").agg(*middle, F.avg("_loss").alias("crps"))
    return scores.join(seasonal_error(full, season), "series", "left").withColumn("mase", F.col("mae") / F.col("scale")).drop("scale")
