from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import half, sampling, scalers


def test_intervals_and_draws(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 2.0), ("d", None), ("e", 1.0)], "source string, weight double")
    got = {r.source: (r.low, r.high) for r in sampling.intervals(weights, "source", "weight").collect()}
    assert got == {"a": (0.0, 0.25), "c": (0.25, 0.75), "e": (0.75, 2.0)}
    draws = spark.range(4000).select((F.col("id") / 4000).alias("u"))
    counts = Counter(r.source for r in sampling.draw_by_weight(draws, "u", sampling.intervals(weights, "source", "weight"), "source").collect())
    assert counts == {"a": 1000, "c": 2000, "e": 1000}
    many = spark.range(3000).selectExpr("id as source", "1.0D + id % 7 as weight")
    assert sampling.draw_by_weight(draws, "u", sampling.intervals(many, "source", "weight"), "source").count() == 4000
    for bad in ([("a", -1.0), ("b", 2.0)], [("a", 0.0)], [("a", float("nan"))], []):
        with pytest.raises(ValueError):
            sampling.intervals(spark.createDataFrame(bad, "source string, weight double"), "source", "weight")


def test_mixture(spark):
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("z", 4)], "source string, item_id long")
    weights = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", 0.0)], "source string, weight double")
    got = sampling.sample_mixture(rows, weights, 200, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch_id, []).append((r.slot, r.source))
    assert len(by) == 200 and all(sorted(k for k, _ in b) == [0, 1, 2] and len({s for _, s in b}) == 1 for b in by.values())
    assert 110 < sum(b[0][1] == "x" for b in by.values()) < 190 and not any(s == "z" for b in by.values() for _, s in b)
    used = Counter(r.item_id for r in got)
    assert abs(used[1] - used[2]) <= 1  # rows of a source take turns
    with pytest.raises(ValueError):
        sampling.sample_mixture(rows, weights, 0, 3)


def test_hierarchy(spark):
    rows = spark.createDataFrame([(d, f, f"{d}{f}{k}", 9) for d, f, n in (("a", "x", 50), ("a", "y", 150), ("b", "z", 5), ("c", "w", 40)) for k in range(n)], "dataset string, file string, item_id string, extra int")
    weights = spark.createDataFrame([("a", 0.6), ("b", 0.2), ("c", 0.2), ("gone", 9.0)], "dataset string, weight double")
    got = sampling.sample_hierarchy(rows, weights, 60, 4).collect()
    assert len({r.item_id for r in got}) == len(got) and got[0].extra == 9
    by = Counter(r.dataset for r in got)
    assert by["b"] == 5 and 20 < by["a"] < 50 and 2 < by["c"] < 25 and sum(by.values()) < 60  # b is used up
    files = Counter(r.file for r in got if r.dataset == "a")
    assert files["y"] > files["x"] > 0
    assert sampling.sample_hierarchy(rows, weights, 0, 4).count() == 0
    assert sampling.sample_hierarchy(rows, weights, 100_000, 4).count() == 245
    # A small file that is drawn more often than it has rows is made up for from the data set's other rows.
    lopsided = rows.filter("dataset = 'a'").limit(0).unionByName(rows.filter("dataset = 'c'")).unionByName(spark.createDataFrame([("c", "tiny", "t", 9)], rows.schema))
    assert sampling.sample_hierarchy(lopsided, weights, 41, 1).count() == 41


def test_resolutions(spark):
    rows = spark.range(2000).select(F.col("id").cast("string").alias("item_id"), F.transform(F.sequence(F.lit(0), F.lit(399)), lambda v: v.cast("double")).alias("target"))
    got = sampling.sample_resolution(rows, 20, seed=3).collect()
    count = Counter(r.resolution for r in got)
    share = 1 / sum(1 / k for k in range(1, 16))
    assert set(count) == set(range(1, 16)) and abs(count[1] / 2000 - share) < 0.04 and abs(count[4] / 2000 - share / 4) < 0.03
    for r in got:
        assert len(r.target) == 20 and all(b - a == r.resolution for a, b in zip(r.target, r.target[1:])) and r.target[0] == r.window_start
    assert {r.resolution for r in sampling.sample_resolution(rows.limit(50), 20, factors=[7]).collect()} == {7}
    short = spark.createDataFrame([("s", [1.0, 2.0]), ("n", [])], "item_id string, target array<double>")
    assert all(len(r.target) <= 2 for r in sampling.sample_resolution(short, 20, 5).collect())
    with pytest.raises(ValueError):
        sampling.sample_resolution(rows, 20, factors=[0])


def test_training_masks(spark):
    rows = [(f"i{k}", [None] * (24 - n) + [None if (k + j) % 5 == 0 else float(j) for j in range(n)], [j < 24 - n for j in range(24)]) for k, n in enumerate([0, 1, 5, 12, 24, 24, 24, 23] * 4)]
    got = sampling.packed_masks(spark.createDataFrame(rows, "item_id string, target array<double>, pad_mask array<boolean>"), 2, 3, 0.4, seed=6).collect()
    hidden = []
    for r in got:
        pad, n = r.pad_mask, 24 - sum(r.pad_mask)
        assert r.miss_mask == [t is None and not p for t, p in zip(r.target, pad)] and not any(p and h for p, h in zip(pad, r.pred_mask))
        assert r.loss_mask == [h and not m for h, m in zip(r.pred_mask, r.miss_mask)]
        block = max(1, min(-(-n // 2) // 4 + 1, 3))
        hidden.append((n, block, sum(r.pred_mask)))
        free = [h for h, p in zip(r.pred_mask, pad) if not p]
        # Apart from the tail, hidden patches come in whole blocks from the left edge.
        tail = 8 * block
        for p in range(0, 24 - tail - 2 * block + 1, 2 * block):
            here = [r.pred_mask[j] for j in range(p, p + 2 * block) if not pad[j]]
            assert len(set(here)) <= 1
        assert free or n == 0
    full = [(b, h) for n, b, h in hidden if n == 24]
    assert all(h >= 2 * b * max(1, min(round(12 * 0.4 / b), 12 // b)) for b, h in full) and len({h for _, h in full}) > 1


def test_half(spark):
    edges = [0.0, -0.0, 1.0, -1.0, 65504.0, 65519.9, 65520.0, -65520.0, 1e300, 2**-24, 2**-25, 1.0000001 * 2**-25, 2**-14, 2**-14 - 2**-25, 6.1e-5, 1 + 2**-11, 1 + 3 * 2**-11, 2047.5, 2048.5, 2049.0, 0.1, -1 / 3, float("inf"), float("-inf"), float("nan"), 5e-324]
    rng = np.random.default_rng(2)
    values = [*edges, *(rng.normal(size=3000) * 10.0 ** rng.integers(-9, 6, 3000)).tolist(), *[2.0**e * (1 - 2**-53) for e in range(-26, 17)], *[2.0**e for e in range(-26, 17)]]
    frame = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)] + [(-1, None)], "k long, x double")
    got = {r.k: (r.b, r.back) for r in frame.withColumn("b", half.to_bits(F.col("x"))).withColumn("back", half.from_bits(F.col("b"))).collect()}
    assert got.pop(-1) == (None, None)
    with np.errstate(over="ignore"):
        want = np.array(values, dtype=np.float64).astype(np.float16)
    for k, h in enumerate(want):
        assert (np.isnan(h) and got[k][0] == 0x7E00) or got[k][0] == int(h.view(np.int16)), values[k]
        assert (np.isnan(h) and np.isnan(got[k][1])) or got[k][1] == float(h)
    every = spark.range(-32768, 32768).select(F.col("id").cast("smallint").alias("b")).withColumn("x", half.from_bits(F.col("b")))
    assert every.filter("not isnan(x)").filter(half.to_bits(F.col("x")) != F.col("b")).count() == 0


def test_scalers(spark):
    rows = spark.createDataFrame([("a", 0, 1.0, False), ("a", 1, 3.0, False), ("a", 2, 99.0, True), ("b", 0, None, False), ("c", 0, 5.0, False), ("c", 1, 5.0, False)], "series string, pos int, y double, hidden boolean")
    later = spark.createDataFrame([("a", 10.0, -2.0), ("b", 1.0, 2.0), ("c", 5.5, 4.0), ("new", 1.0, 1.0)], "series string, q1 double, q9 double")
    fitted = {k: scalers.fit(rows, k, mask="hidden") for k in scalers.KINDS}
    stats = {r.series: (r.centre, r.spread) for r in fitted["standard"].collect()}
    assert stats == {"a": (2.0, 1.0), "b": (0.0, 1.0), "c": (5.0, 1e-5)}
    assert {r.series: (r.centre, r.spread) for r in fitted["minmax"].collect()} == {"a": (1.0, 2 + 1e-8), "b": (None, None), "c": (5.0, 1e-8)}
    for kind, table in fitted.items():
        there = scalers.transform(later, table, ["q1", "q9"])
        back = {r.series: (r.q1, r.q9) for r in scalers.inverse(there, table, ["q1", "q9"]).collect()}
        assert back.pop("new") == (None, None)
        if kind == "minmax":
            assert back.pop("b") == (None, None)
        assert all(back[r.series] == pytest.approx((r.q1, r.q9)) for r in later.collect() if r.series in back)
        if kind == "asinh":
            assert {r.series: r.q1 for r in there.collect()}["a"] == pytest.approx(np.arcsinh(8.0))
    with pytest.raises(ValueError):
        scalers.fit(rows, "other")
