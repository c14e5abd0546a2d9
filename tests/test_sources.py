"""Readers and writers over files made by the tests."""

import numpy as np
import pyarrow as pa
import pytest

from tidemill.sources import series as sources


def test_wide_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,x,y\n2024-01-01,1.0,2\n2024-01-02,,4\n")
    (tmp_path / "b.csv").write_text("time,x,y\n2024-01-01,nan,6\n")
    (tmp_path / "c.csv").write_text("time,z\n2024-01-01,word\n")
    got = {(r.item_id, r.variate, str(r.ts)[:10]): r.y for r in sources.read_wide_csv(spark, str(tmp_path)).collect()}
    assert got == {("a", "x", "2024-01-01"): 1.0, ("a", "y", "2024-01-01"): 2.0, ("a", "x", "2024-01-02"): None, ("a", "y", "2024-01-02"): 4.0, ("b", "x", "2024-01-01"): None, ("b", "y", "2024-01-01"): 6.0, ("c", "z", "2024-01-01"): None}
    names = {r.item_id for r in sources.read_wide_csv(spark, str(tmp_path / "a.csv"), to_univariate=True).collect()}
    assert names == {"x", "y"}


def test_matrices(spark, tmp_path):
    (tmp_path / "m.csv").write_text(",0,1\n0,1,2\n1,3,\n")
    (tmp_path / "m.tsv").write_text("\t0\n0\t7\n")
    np.save(tmp_path / "m.npy", np.arange(12, dtype="float32").reshape(1, 2, 6))
    np.arange(3, dtype="<f4").tofile(tmp_path / "m.dat")
    got = {}
    for r in sources.read_matrix(spark, str(tmp_path / "m.*")).collect():
        got.setdefault(r.file.rsplit(".", 1)[1], {})[r.row, r.pos, r.variate] = r.y
    assert got["csv"] == {(0, 0, 0): 1.0, (0, 1, 0): 2.0, (1, 0, 0): 3.0, (1, 1, 0): None} and got["tsv"] == {(0, 0, 0): 7.0}
    assert got["npy"][0, 5, 1] == 11.0 and len(got["npy"]) == 12 and got["dat"] == {(0, k, 0): float(k) for k in range(3)}
    (tmp_path / "m.xyz").write_text("x")
    with pytest.raises(ValueError):
        sources.read_matrix(spark, str(tmp_path / "m.xyz"))


def test_arrow_series_and_repack(spark, tmp_path):
    flat = pa.table({"target": pa.array([[1.0, 2.0], [3.0]], pa.list_(pa.float32())), "other": [1, 2]})
    deep = pa.table({"target": pa.array([[[1.0, 2.0], [3.0, 4.0]]], pa.list_(pa.list_(pa.float32())))})
    for folder, table, make in (("one", flat, pa.ipc.new_stream), ("two", deep, pa.ipc.new_file)):
        (tmp_path / "in" / folder / "x").mkdir(parents=True)
        with pa.OSFile(str(tmp_path / "in" / folder / "x" / "data-0.arrow"), "wb") as f, make(f, table.schema) as w:
            w.write_table(table)
    (tmp_path / "in" / "two" / "data-1.arrow").write_bytes(b"no arrow")
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    got = sorted((r.dataset, r.row if r.row is not None else -1, r.channel, r.target) for r in sources.read_arrow_series(spark, root).collect())
    assert got == [("one", 0, 0, [1.0, 2.0]), ("one", 1, 0, [3.0]), ("two", -1, None, None), ("two", 0, 0, [1.0, 2.0]), ("two", 0, 1, [3.0, 4.0])]
    assert [r.dataset for r in sources.repack_series(spark, root, out).collect()] == ["two"]
    sources.repack_series(spark, root, out)
    assert sources.read_repacked(spark, out).count() == 4


def test_a_killed_repack_is_taken_up_again(spark, tmp_path):
    table = pa.table({"target": pa.array([[1.0, 2.0], [3.0]], pa.list_(pa.float32()))})
    for name in ("a", "b"):
        (tmp_path / "in" / name).mkdir(parents=True)
        with pa.OSFile(str(tmp_path / "in" / name / "data-0.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table)
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    # A run that was killed after one of its two source files: data without a manifest.
    half = sources.read_arrow_series(spark, root).filter("dataset = 'a'")
    half.write.partitionBy("dataset").parquet(f"{out}/data/run=killed")
    assert sources.repack_series(spark, root, out).collect() == []
    got = sorted((r.dataset, r.row, r.target) for r in sources.read_repacked(spark, out).collect())
    assert got == [(d, k, t) for d in ("a", "b") for k, t in enumerate([[1.0, 2.0], [3.0]])]
    # A later source file is added by the next run; the others stay as they are.
    with pa.OSFile(str(tmp_path / "in" / "b" / "data-1.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    sources.repack_series(spark, root, out)
    assert sources.read_repacked(spark, out).count() == 6 and spark.read.parquet(f"{out}/manifest").count() == 3


def test_precedence_of_trees_equals_sql(spark, tmp_path):
    import duckdb

    rows = [("m", "d", "short", 1.0), ("m", "d", "short", 2.0), ("m", "e", "long", 3.0)]
    more = [("m", "d", "short", 9.0), ("m", "f", "long", 4.0), ("n", "d", "short", 5.0), (None, "d", "short", 6.0)]
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    for path, r in ((first, rows), (second, more)):
        spark.createDataFrame(r, "model string, dataset string, term string, MASE double").write.partitionBy("model", "dataset", "term").parquet(path)
    roots = [str(tmp_path / "absent"), first, second]
    got = sorted((str(r.model), r.dataset, r.term, r.MASE, r.root) for r in sources.read_results_by_precedence(spark, roots, ["model", "dataset", "term"]).collect())
    union = " UNION ALL ".join(f"SELECT nullif(model, '__HIVE_DEFAULT_PARTITION__') AS model, dataset, term, MASE, {k} AS root FROM read_parquet('{p}/*/*/*/*.parquet', hive_partitioning = true)" for k, p in ((1, first), (2, second)))
    want = duckdb.sql(f"WITH u AS ({union}) SELECT coalesce(model, 'None'), dataset, term, MASE, root FROM u QUALIFY root = min(root) OVER (PARTITION BY model, dataset, term)").fetchall()
    assert got == sorted(want) and len(got) == 6
    with pytest.raises(ValueError):
        sources.read_results_by_precedence(spark, roots[:1], ["model"])


def test_results(spark, tmp_path):
    pred = spark.createDataFrame([("m", "d", "short", 1e6), ("m", "e", "long", 5.0), ("m", "f", "long", None)], "model string, dataset string, term string, y_hat double")
    sources.write_predictions(pred, str(tmp_path / "p"))
    got = {r.dataset: (r.y_half, r.scale_factor) for r in sources.read_results_tree(spark, str(tmp_path / "p")).collect()}
    assert got == {"d": (0x70E2, 100.0), "e": (0x4500, 1.0), "f": (None, 1.0)}
    assert {r.dataset: r.y_hat for r in sources.read_predictions(spark, str(tmp_path / "p")).collect()} == {"d": 1e6, "e": 5.0, "f": None}
    assert [r.dataset for r in sources.read_results_tree(spark, str(tmp_path / "p"), ["short"]).collect()] == ["d"]
    sources.write_metrics(pred, str(tmp_path / "m"), {"seed": 1})
    assert {r.config for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {'{"seed":"1"}'}
    sources.write_leaderboard(pred.select("model", "y_hat"), str(tmp_path / "l"), "y_hat")
    assert spark.read.csv(str(tmp_path / "l"), header=True).count() == 3


def test_settings(spark, tmp_path):
    settings = spark.createDataFrame([("a/H", "short", 8), ("a/H", "long", 80), ("b", "short", 3)], "dataset string, term string, prediction_length int")
    items = spark.createDataFrame([("a/H", 1), ("b/D", 2)], "dataset string, k int")
    assert {r.k: r.prediction_length for r in sources.task_settings(items, settings, "short").collect()} == {1: 8, 2: 3}
    assert {r.k for r in sources.task_settings(items, settings, "long").collect()} == {1}
    with pytest.raises(ValueError):
        sources.task_settings(spark.createDataFrame([("z", 1)], "dataset string, k int"), settings, "short")
    spark.createDataFrame([("a", "H"), ("a", "D")], "dataset string, freq string").write.parquet(str(tmp_path / "i"))
    with pytest.raises(ValueError):
        sources.read_items(spark, str(tmp_path / "i"))
