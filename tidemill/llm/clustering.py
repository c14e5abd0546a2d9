"""Centroid clustering (k-means on whole numbers) with geometric drift tightening.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of that to any other.  When
centroids move, the upper bound grows by the own centroid's drift.  The lower bound falls by less than the other
centroids' drift: the vectors of a cluster lie in a sphere, and seen from the path of a moving centroid that sphere fills
a cone, so a vector in it comes nearer by at most the drift times the largest cosine between the path and the cone.
That is a problem in the plane through the path and the sphere's middle.  Where the bounds cannot tell, the vector is
scanned exactly; all distances that decide are whole numbers.

The vectors are written once, bucketed by a row number.  A round reads them beside the small table of bounds, bucketed
alike, so nothing is shuffled; it writes new bounds and, for each task, what vectors that changed their cluster take
from and add to the sums.  Centroids, drifts and radii (a row for each cluster) are all that the driver sees.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path
from .vectors import sound, squared_distances, whole

#: Vectors of a bucket, and the largest number of buckets.
BUCKET_ROWS, MOST_BUCKETS = 250_000, 50_000
#: Room for rounding in the comparison of bounds, relative to them and absolute (distances are roots of whole numbers).
ROUNDING, STEP = 1e-9, 1e-6


def nearer(old: np.ndarray, new: np.ndarray, middle: np.ndarray, radius: float) -> float:
    """How much nearer at most a vector within ``radius`` of ``middle`` comes to a centroid that moves from ``old`` to ``new``.

    Never more than the drift, and below zero where the centroid moves away from the whole sphere.  The change is the
    drift times the mean cosine, along the path, between the path and the direction to the vector.  Along a stretch the angle to
    the middle is smallest at its begin, and the cone is widest where the path is nearest to the middle."""
    path = new - old
    drift = float(np.sqrt((path**2).sum()))
    if drift == 0:
        return 0.0
    along = float((middle - old) @ path) / drift  # plane coordinates of the middle, from the path's begin
    aside = float(np.sqrt(max(0.0, ((middle - old) ** 2).sum() - along**2)))
    stretches, total = 8, 0.0
    for k in range(stretches):
        a, b = drift * k / stretches, drift * (k + 1) / stretches
        nearest = np.hypot(min(max(along, a), b) - along, aside)
        if nearest <= radius:
            total += b - a
            continue
        angle = np.arctan2(aside, along - a) - np.arcsin(radius / nearest)
        total += (b - a) * (1.0 if angle <= 0 else float(np.cos(min(angle, np.pi))))
    return min(total + 1e-9 * drift, drift)


def drifts(old: np.ndarray, new: np.ndarray, radius: dict[int, float]) -> tuple[list[float], list[float]]:
    """Of each cluster: its centroid's drift, and what its vectors' lower bounds lose."""
    own = np.sqrt(((new - old) ** 2).sum(1))
    lose = [max((nearer(old[j], new[j], old[i], radius[i]) for j in range(len(old)) if j != i), default=0.0) if i in radius else 0.0 for i in range(len(old))]
    return own.tolist(), lose


def start_rank(id_col: str, seed: int) -> Column:
    """The hash by which first centroids are chosen; a null id counts as an empty one."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)


class Tables:
    """Bucketed tables in the shared folder, under passing names in the session's catalog."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, name: str, spread: bool = False) -> str:
        table = f"{name}_{uuid.uuid4().hex}"
        df = df.repartition(self.buckets, "row") if spread else df
        df.write.format("parquet").bucketBy(self.buckets, "row").option("path", new_path(self.spark, name)).saveAsTable(table)
        self.names.append(table)
        return table

    def drop(self, table: str) -> None:
        """The table's name and, as nothing reads them any more, its files."""
        self.names.remove(table)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.spark.table(table).inputFiles()[0].rsplit("/", 1)[0]) if self.spark.table(table).inputFiles() else None
        self.spark.sql(f"DROP TABLE {table}")
        if path is not None:
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


STATE = "row bigint, cluster int, upper double, lower double, was int, sums array<bigint>, moved bigint, scanned bigint"


def assign(batch: pa.RecordBatch, centres: np.ndarray, own: list[float], lose: list[float], sums: np.ndarray, counts: np.ndarray) -> tuple[pa.RecordBatch, int]:
    """A batch's new state and the number of rows that were scanned; changes of the sums go to ``sums`` and ``counts``."""
    dim = centres.shape[1]
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype="<i4").astype(np.int64).reshape(-1, dim)
    was = batch.column("cluster").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = was >= 0
    cluster = np.where(known, was, 0)
    upper = np.where(known, batch.column("upper").fill_null(0).to_numpy(zero_copy_only=False) + np.array(own)[cluster], np.inf)
    lower = np.where(known, batch.column("lower").fill_null(0).to_numpy(zero_copy_only=False) - np.array(lose)[cluster], -np.inf)
    unclear = upper * (1 + ROUNDING) + STEP >= lower
    tight = np.nonzero(unclear & known)[0]
    if len(tight):  # the true distance may already tell
        for c in np.unique(cluster[tight]).tolist():
            rows = tight[cluster[tight] == c]
            upper[rows] = np.sqrt(squared_distances(x[rows], centres[c : c + 1])[:, 0].astype(np.float64))
        unclear &= ~(known & (upper * (1 + ROUNDING) + STEP < lower))
    rows = np.nonzero(unclear)[0]
    if len(rows):
        far = squared_distances(x[rows], centres)
        best = far.argmin(1)
        near = far[np.arange(len(rows)), best]
        far[np.arange(len(rows)), best] = np.iinfo(np.int64).max
        cluster[rows], upper[rows], lower[rows] = best, np.sqrt(near.astype(np.float64)), np.sqrt(far.min(1).astype(np.float64))
    changed = np.nonzero(cluster != was)[0]
    for c in np.unique(cluster[changed]).tolist():
        rows_in = changed[cluster[changed] == c]
        sums[c] += x[rows_in].sum(0)
        counts[c] += len(rows_in)
    for c in np.unique(was[changed][was[changed] >= 0]).tolist():
        rows_out = changed[was[changed] == c]
        sums[c] -= x[rows_out].sum(0)
        counts[c] -= len(rows_out)
    n = len(x)
    out = pa.RecordBatch.from_arrays(
        [batch.column("row"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(was.astype(np.int32)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
        names=["row", "cluster", "upper", "lower", "was", "sums", "moved", "scanned"],
    )
    return out, int(unclear.sum())


def one_round(rows: DataFrame, centres: np.ndarray, own: list[float], lose: list[float]) -> DataFrame:
    """State rows, and behind those of each task a row for each cluster with what its sum and count change by."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, scanned = np.zeros(centres.shape, np.int64), np.zeros(len(centres), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                out, unclear = assign(batch, centres, own, lose, sums, counts)
                scanned += unclear
                yield out
        at = [c for c in range(len(centres)) if counts[c] or sums[c].any()] or [0]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(at), pa.int64()), pa.array(at, pa.int32()), pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.int32()),
             pa.array([sums[c].tolist() for c in at], pa.list_(pa.int64())), pa.array([int(counts[c]) for c in at], pa.int64()), pa.array([scanned] + [0] * (len(at) - 1), pa.int64())],
            names=["row", "cluster", "upper", "lower", "was", "sums", "moved", "scanned"],
        )

    return rows.mapInArrow(step, STATE)


def cluster_vectors(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", log: list[dict] | None = None
) -> DataFrame:
    """id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256`` per kept vector.

    Kept are vectors of exactly ``dim`` entries, none null, non-finite or of 2**17 and more (beyond that, sums of squares
    do not fit whole numbers of 64 bits).  Each entry becomes floor(1024 * entry).  The first centroids are the ``k`` vectors with the smallest
    sha256 of ``seed:id`` (a null id counts as empty; rows of one id are taken in the order of their entries); with fewer vectors
    there are fewer centroids.  Ties of distance go to the smaller number; a centroid without vectors stays where it is.
    Repeated rows are vectors of their own, and an empty table gives no rows.  An inertia that no long can hold is null.
    ``log`` gets, for every round, the number of vectors, of those scanned exactly and of those that changed their cluster.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(sound("v") & (F.size("v") == dim))
    id_type = kept.schema["id"].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("v"), dim).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["row", "id", "x"])

    numbered = cut(kept.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "v").mapInArrow(packed, f"row bigint, id {id_type}, x binary"), "cluster-rows")
    n = numbered.count()
    first = numbered.select(start_rank("id", seed).alias("rank"), "x").withColumn("entries", F.hex("x")).orderBy("rank", "entries").limit(k).collect()
    if not first:
        return numbered.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centres = np.stack([np.frombuffer(bytes(r["x"]), dtype="<i4").astype(np.int64) for r in first])
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS)))
    tables = Tables(spark, buckets)
    home = tables.write(numbered, "cluster_vectors", spread=True)
    sums, counts = np.zeros(centres.shape, dtype=object), np.zeros(len(centres), dtype=object)
    state, own, lose = None, [0.0] * len(centres), [0.0] * len(centres)
    for number in range(rounds + 1):
        rows = spark.table(home).select("row", "x")
        if state is None:
            rows = rows.withColumns({"cluster": F.lit(None).cast("int"), "upper": F.lit(None).cast("double"), "lower": F.lit(None).cast("double")})
        else:
            bounds = spark.table(state).filter("row is not null").select("row", "cluster", "upper", "lower")
            rows = rows.join(bounds.hint("shuffle_hash"), "row")
        after = tables.write(one_round(rows, centres, own, lose), "cluster_state")
        if state is not None:
            tables.drop(state)
        state = after
        told = spark.table(state)
        parts = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
        change = told.filter("row is null").groupBy("cluster").agg(*parts, F.sum("moved").alias("moved"), F.sum("scanned").alias("scanned")).collect()
        radius = {r["cluster"]: r["radius"] for r in told.filter("row is not null").groupBy("cluster").agg(F.max("upper").alias("radius")).collect()}
        if log is not None:
            log.append({"vectors": n, "scanned": sum(r["scanned"] for r in change), "changed": told.filter("row is not null and was <> cluster").count()})
        if number == rounds:
            break
        for r in change:
            sums[r["cluster"]] += np.array([int(r[f"s{i}"]) for i in range(dim)], dtype=object)
            counts[r["cluster"]] += r["moved"]
        new = np.array([[int(s) // int(counts[c]) for s in sums[c]] if counts[c] else centres[c].tolist() for c in range(len(centres))], dtype=np.int64)
        own, lose = drifts(centres.astype(np.float64), new.astype(np.float64), radius)
        centres = new

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype="<i4").astype(np.int64).reshape(-1, dim)
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(((x - centres[cluster]) ** 2).sum(1))], names=["id", "cluster", "distance"])

    last = spark.table(state).filter("row is not null").select("row", "cluster")
    out = cut(spark.table(home).join(last.hint("shuffle_hash"), "row").select("id", "x", "cluster").mapInArrow(distances, f"id {id_type}, cluster int, distance bigint"), "cluster-result")
    tables.drop(state)
    tables.drop(home)
    inertia = {r["cluster"]: int(r["inertia"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    long = lambda v: v if v < 2**63 else None
    says = [(c, long(i), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, i in inertia.items()]
    lookup = spark.createDataFrame(says, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # A row for each cluster, so at most k.
    return out.join(F.broadcast(lookup), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
