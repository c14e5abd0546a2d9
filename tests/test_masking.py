"""Masks and covariates on small hand-made series."""

import pytest

from tidemill.operators import covariates, evaluation, masking


def long(spark, n, series="a"):
    return spark.createDataFrame([(series, k, float(k)) for k in range(n)], "series string, pos int, y double")


def masked(df):
    return sorted(r.pos for r in df.filter("is_masked").collect())


def test_blocks_do_not_overlap_and_ignore_partitions(spark):
    rows = long(spark, 60)
    got = masked(masking.mask_blocks(rows, 3, 5, 1))
    assert len(got) == 15 and got == masked(masking.mask_blocks(rows.repartition(7), 3, 5, 1))
    assert masked(masking.mask_blocks(long(spark, 3), 1, 5)) == [0, 1, 2]
    with pytest.raises(ValueError):
        masking.mask_blocks(rows, 0, 5)


def test_mixed_masks_blocks_then_points(spark):
    assert len(masked(masking.mask_mixed(long(spark, 40), 1, 5, 0.1))) == 5 + 4


def test_bernoulli_masks_at_least_one(spark):
    assert len(masked(masking.mask_bernoulli(long(spark, 10), 0.0))) == 1
    assert len(masked(masking.mask_bernoulli(long(spark, 10), 1.0))) == 10


def test_patches_are_aligned(spark):
    got = masked(masking.mask_contiguous_patches(long(spark, 24), 2, 3, 0.5))
    assert len(got) == 12 and all(p % 6 == k % 6 for k, p in enumerate(got))
    assert len(masked(masking.mask_contiguous_patches(long(spark, 4), 2, 3, 0.5))) == 4


def test_scenarios_and_application(spark):
    assert masking.default_scenarios(spark, 256).filter("block_size = 17").count() == 2
    values = spark.createDataFrame([("a", v, k, 1.0) for v in "xy" for k in range(4)], "series string, variate string, pos int, y double")
    rows = masking.apply_scenario(masking.mask_blocks(long(spark, 4), 1, 2), values).collect()
    assert len(rows) == 8 and sum(r.y_masked is None for r in rows) == 4 and all((r.y_masked is None) == r.is_masked for r in rows)


def test_fill_by_covariate_falls_back_to_interpolation(spark):
    y = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 5.0), ("b", 0, 1.0), ("b", 1, None), ("b", 2, 3.0)], "series string, pos int, y double")
    x = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 10.0), ("a", 2, 2.0)], "series string, pos int, x double")
    got = {(r.series, r.pos): r.y_hat for r in covariates.fill_by_covariate(y, x).collect()}
    assert got["a", 1] == 21.0 and got["b", 1] == 2.0 and got["a", 2] == 5.0


def test_fallback_replaces_whole_series(spark):
    pred = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 1, 2.0)], "series string, step int, y_hat double")
    other = spark.createDataFrame([("a", 1, 7.0), ("a", 2, 8.0), ("b", 1, 9.0)], "series string, step int, y_hat double")
    assert sorted(tuple(r) for r in evaluation.with_fallback(pred, other).collect()) == [("a", 1, 7.0), ("a", 2, 8.0), ("b", 1, 2.0)]


def test_past_and_sparse_and_broadcast(spark):
    x = spark.createDataFrame([("a", "t", k, float(k)) for k in range(6)], "series string, name string, pos int, x double")
    assert covariates.past_only(x, long(spark, 4)).count() == 4
    assert [r.x for r in covariates.sparse_covariates(x, 3).orderBy("pos").collect()] == [None, None, 2.0, None, None, 5.0]
    targets = spark.createDataFrame([("a", "u"), ("a", "v")], "series string, variate string")
    assert covariates.broadcast_covariates(targets, x).count() == 12


def test_score_series_calls_one_frame_per_series(spark):
    out = evaluation.score_series(long(spark, 5), lambda g: g.tail(1)[["series", "y"]], "series string, y double")
    assert [tuple(r) for r in out.collect()] == [("a", 4.0)]


def test_sampling_is_exact_and_repeatable(spark):
    packed = spark.createDataFrame([(k, "p" if k < 8 else "q", [1.0]) for k in range(10)], "item_id int, dataset string, target array<double>")
    weights = evaluation.mixture_weights(spark.createDataFrame([("p", 8, 8), ("q", 2, 2)], "dataset string, size int, n_series int"), "uniform")
    ids = lambda df: sorted(r.item_id for r in evaluation.sample_series(df, weights, 4, 3).collect())
    assert len(set(ids(packed))) == 4 and ids(packed) == ids(packed.repartition(5))
