"""Readers and writers of series, forecasts and results.  Paths go to Spark's readers, so that any store they know will do."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.half import from_bits, to_bits
from tidemill.operators.layout import item_names

#: Largest magnitude kept in half-precision forecasts, with a margin (fixed value).
HALF_MAX = 60_000.0


def read_wide_csv(spark: SparkSession, paths: list[str] | str, to_univariate: bool = False) -> DataFrame:
    """(item_id, variate, ts, y) of CSV files whose first column is the time and whose others are variates.

    Files are grouped by header, one scan each.  The item is the file's name, or with ``to_univariate`` the name by
    ``item_names``.  ValueError when there are no files; values that are no numbers are NULL."""
    listed = spark.read.format("binaryFile").load(paths).select("path").inputFiles() if isinstance(paths, str) else sum((spark.read.format("binaryFile").load(p).inputFiles() for p in paths), [])
    if not listed:
        raise ValueError(f"no files at {paths}")
    heads = spark.read.option("wholetext", False).text(listed).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min_by("value", F.col("_metadata.file_block_start")).alias("head"))
    by_head: dict[str, list[str]] = {}
    # One row per file is read here: its name and header.
    for row in heads.toLocalIterator():
        by_head.setdefault(row["head"], []).append(row["file"])
    out = None
    for files in by_head.values():
        wide = spark.read.csv(files, header=True)
        time, *names = wide.columns
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
        rows = wide.select(stem.alias("file"), F.col(f"`{time}`").try_cast("timestamp_ntz").alias("ts"), *[F.col(f"`{n}`").try_cast("double").alias(n) for n in names])
        rows = rows.unpivot(["file", "ts"], [F.col(f"`{n}`") for n in names], "variate", "y")
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    named = item_names(out) if to_univariate else out.withColumn("item_id", F.col("file"))
    return named.select("item_id", "variate", "ts", "y")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, pos, variate, y) of matrices by suffix: csv and tsv (index column dropped, rows are series), npy, dat (flat float32).

    Of three axes the longer of the last two is time.  One file is decoded by one task, and files of no bytes have no rows; ValueError for other suffixes."""
    found = spark.read.format("binaryFile").load(path)
    wrong = found.select(F.regexp_extract("path", r"\.([^./]*)$", 1).alias("s"), "path").filter(~F.lower("s").isin("csv", "tsv", "npy", "dat")).limit(3).collect()
    if wrong:
        raise ValueError(f"unknown formats: {[r['path'] for r in wrong]}")

    def decode(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                kind = name.rsplit(".", 1)[-1].lower()
                if kind in ("csv", "tsv"):
                    x = pd.read_csv(io.BytesIO(content), index_col=0, sep="," if kind == "csv" else "\t").to_numpy("float32")
                else:
                    x = np.load(io.BytesIO(content), allow_pickle=False) if kind == "npy" else np.frombuffer(content, "<f4")
                x = x.reshape(1, -1) if x.ndim == 1 else x
                x = x[:, :, None] if x.ndim == 2 else x
                if x.ndim != 3:
                    raise ValueError(f"{name}: {x.ndim} axes")
                x = x.transpose(0, 2, 1) if x.shape[1] < x.shape[2] else x
                for k, series in enumerate(x):
                    n, c = series.shape
                    yield pd.DataFrame({"file": name, "row": k, "pos": np.repeat(np.arange(n, dtype="int32"), c), "variate": np.tile(np.arange(c, dtype="int32"), n), "y": series.reshape(-1).astype("float64")})

    rows = found.select("path", "content").mapInPandas(decode, "file string, row long, pos int, variate int, y double")
    return rows.withColumn("y", F.when(~F.isnan("y"), F.col("y")))


def read_arrow_series(spark: SparkSession, root: str, pattern: str = "data-*.arrow") -> DataFrame:
    """(dataset, file, row, channel, target) of Arrow IPC streams or files under ``<root>/<dataset>/``; only ``target`` is read.

    Unreadable files are one row with a NULL row number each, so that they can be counted; lists of lists are channels."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)

    def decode(frames: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    reader = pa.ipc.open_file(content) if content[:6] == b"ARROW1" else pa.ipc.open_stream(content)
                    batches = [reader.get_batch(k) for k in range(reader.num_record_batches)] if content[:6] == b"ARROW1" else list(reader)
                    columns = [b.column(b.schema.get_field_index("target")) for b in batches]
                except (pa.ArrowException, KeyError, IndexError):
                    yield pd.DataFrame({"file": [name], "row": pd.array([None], "Int64"), "channel": pd.array([None], "Int32"), "target": [None]})
                    continue
                row = 0
                for column in columns:
                    out = []
                    for value in column.to_pylist():
                        nested = bool(value) and isinstance(value[0], list)
                        out += [(name, row, k, v) for k, v in enumerate(value if nested else [value])]
                        row += 1
                    yield pd.DataFrame(out, columns=["file", "row", "channel", "target"])

    rows = found.select("path", "content").mapInPandas(decode, "file string, row long, channel int, target array<float>")
    folder = F.element_at(F.split("file", "/"), -2)
    under = F.regexp_extract("file", rf"/{base.rstrip('/').rsplit('/', 1)[-1]}/([^/]+)/", 1)
    return rows.select(F.coalesce(F.nullif(under, F.lit("")), folder).alias("dataset"), "file", "row", "channel", "target")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def repack_series(spark: SparkSession, root: str, target: str, rows_per_file: int = 512, pattern: str = "data-*.arrow") -> DataFrame:
    """Arrow series to parquet, files of at most ``rows_per_file`` rows; returns the unreadable files.

    Every run writes a folder of its own under ``<target>/data`` and, when that is complete, one file of ``<target>/manifest`` with the
    source files that it holds.  What a run that was killed left behind is in no manifest: :func:`read_repacked` does not read it, and the next run takes
    those source files again.  Source files in the manifest are skipped."""
    rows = read_arrow_series(spark, root, pattern)
    if _exists(spark, f"{target}/manifest"):
        rows = rows.join(spark.read.parquet(f"{target}/manifest").select("file"), "file", "left_anti").select("dataset", "file", "row", "channel", "target")
    run, readable = uuid.uuid4().hex, rows.filter("row is not null")
    readable.write.option("maxRecordsPerFile", rows_per_file).partitionBy("dataset").parquet(f"{target}/data/run={run}")
    written = spark.read.schema(readable.schema).parquet(f"{target}/data/run={run}")
    # One file, so that it is there whole or not at all: a row for each source file.
    written.groupBy("file").agg(F.count("*").alias("rows")).withColumn("run", F.lit(run)).coalesce(1).write.mode("append").parquet(f"{target}/manifest")
    return rows.filter("row is null").select("dataset", "file")


def read_repacked(spark: SparkSession, target: str) -> DataFrame:
    """(dataset, file, row, channel, target) of the runs that :func:`repack_series` completed."""
    runs = spark.read.parquet(f"{target}/manifest").select("run").distinct()
    rows = spark.read.option("basePath", f"{target}/data").parquet(f"{target}/data")
    return rows.join(runs, "run", "left_semi").select("dataset", "file", "row", "channel", "target")


def read_items(spark: SparkSession, path: str, key: str = "dataset") -> DataFrame:
    """Packed rows; ValueError if a data set has more than one ``freq``."""
    rows = spark.read.parquet(path)
    if {"freq", key} <= set(rows.columns):
        mixed = rows.groupBy(key).agg(F.min("freq").alias("a"), F.max("freq").alias("b")).filter("a <> b").limit(5).collect()
        if mixed:
            raise ValueError(f"more than one frequency: {[r[key] for r in mixed]}")
    return rows


def scaled_predictions(pred: DataFrame, by: str = "dataset") -> DataFrame:
    """``y_hat`` over ``scale_factor``, a power of ten of its own per data set that keeps magnitudes within half precision."""
    top = pred.groupBy(by).agg(F.max(F.abs("y_hat")).alias("_top"))
    factor = F.when(F.col("_top") > HALF_MAX, F.pow(F.lit(10.0), F.ceil(F.log10(F.col("_top") / HALF_MAX)))).otherwise(1.0)
    return pred.join(top, by).withColumn("scale_factor", factor).withColumn("y_hat", F.col("y_hat") / F.col("scale_factor")).drop("_top")


def write_predictions(pred: DataFrame, path: str) -> None:
    """Partitioned by model, dataset and term; values are half precision, ``y_half`` of two bytes, scaled by :func:`scaled_predictions`."""
    halves = scaled_predictions(pred).withColumn("y_half", to_bits(F.col("y_hat"))).drop("y_hat")
    halves.write.mode("overwrite").partitionBy("model", "dataset", "term").parquet(path)


def read_predictions(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """What :func:`write_predictions` wrote, with ``y_hat`` in its own units."""
    rows = read_results_tree(spark, path, terms)
    return rows.withColumn("y_hat", from_bits(F.col("y_half")) * F.col("scale_factor")).drop("y_half", "scale_factor")


def write_metrics(metrics: DataFrame, path: str, config: dict | None = None) -> None:
    """Per-window metrics partitioned by model and dataset, with the run's configuration as JSON in the column ``config``."""
    pairs = [F.lit(str(v)).alias(k) for k, v in sorted((config or {}).items())]
    out = metrics.withColumn("config", F.to_json(F.struct(*pairs)) if pairs else F.lit("{}"))
    out.write.mode("overwrite").partitionBy("model", "dataset").parquet(path)


def run_summary(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Per model and dataset: rows (series x windows x variates) and means of the metrics."""
    return metrics.groupBy("model", "dataset").agg(F.count("*").alias("nb_chunks"), *[F.avg(n).alias(n) for n in names])


def read_results_tree(spark: SparkSession, root: str, terms: list[str] | None = None) -> DataFrame:
    """Results under partition folders (model=.../dataset=...); only the wanted terms' folders are read."""
    rows = spark.read.option("basePath", root).parquet(root)
    return rows.filter(F.col("term").isin(terms)) if terms is not None else rows


def read_results_by_precedence(spark: SparkSession, roots: list[str], keys: list[str]) -> DataFrame:
    """Results of several trees: each key (as of model, dataset, term) comes whole from the first of ``roots`` that has it, which
    ``root`` numbers from 0.  Roots that are not there are passed over; ValueError when none is."""
    trees = [read_results_tree(spark, root).withColumn("root", F.lit(k)) for k, root in enumerate(roots) if _exists(spark, root)]
    if not trees:
        raise ValueError(f"no results at {roots}")
    rows = trees[0]
    for tree in trees[1:]:
        rows = rows.unionByName(tree, allowMissingColumns=True)
    return first_by_precedence(rows, keys, "root")


def first_by_precedence(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The rows of each key's smallest ``rank``; null keys are keys like others."""
    best = rows.groupBy(*keys).agg(F.min(rank).alias("_best"))
    named = best.select(*[F.col(k).alias(f"_{k}") for k in keys], "_best")
    same = F.col(rank) == F.col("_best")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, same, "left_semi")


def task_settings(items: DataFrame, settings: DataFrame, term: str) -> DataFrame:
    """Items (dataset, ...) with the settings of the term: by ``dataset``, else by its part before the slash.

    Settings are one row per data set and term; data sets without that term go, and ValueError names those without any."""
    known = settings.select(F.col("dataset").alias("_key")).distinct()
    bare = F.substring_index("dataset", "/", 1)
    keys = items.select("dataset").distinct()
    exact = keys.join(known, keys["dataset"] == known["_key"])
    loose = keys.join(exact, "dataset", "left_anti").join(known, bare == F.col("_key"))
    lost = [r["dataset"] for r in keys.join(exact, "dataset", "left_anti").join(loose, "dataset", "left_anti").orderBy("dataset").limit(5).collect()]
    if lost:
        raise ValueError(f"no settings for {lost}")
    wanted = settings.filter(F.col("term") == term).withColumnRenamed("dataset", "_key")
    return items.join(exact.unionByName(loose).join(wanted, "_key").drop("_key"), "dataset")


def write_leaderboard(board: DataFrame, path: str, order: str) -> None:
    """One CSV file of a leaderboard (a row per model), numbers to three digits."""
    rounded = [F.round(c, 3).alias(c) if t == "double" else F.col(c) for c, t in board.dtypes]
    board.select(*rounded).orderBy(order).coalesce(1).write.mode("overwrite").csv(path, header=True)
