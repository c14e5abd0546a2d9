"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

The rows that a task reads become a leaf run: one line per text with digest, surviving id and number of rows,
sorted by digest.  Runs sit at numbered positions, and so do slices of the digests' range.  In each binomial
round the ``fan_in`` positions that differ in one digit exchange lines: each takes, from all of them, the lines
whose slice has its own digit there.  What it receives are pieces of sorted runs; they are merged by a streaming
sort aggregate (no hash table) into one longer sorted run, which is written.  After the last digit every position
holds its slice of all digests.  A text with any number of copies is at most one line per run and no
task ever gathers a group.  The winners go back to the leaf runs that hold their text, and from there to the rows.

Equality is verified at every level: lines merge only if SHA-256, length in bytes and an independent
64-bit hash of the normalised text all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_ascii, remove, sized

KEY = ["digest", "octets", "check"]


def normalised(text_col: str):
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


def merged(lines: DataFrame, keep: str) -> DataFrame:
    """Lines of equal position and text as one.  A survivor is a struct, whose minimum Spark takes by sort aggregate:
    pieces of runs arrive in order, so sorting them is merging them, and the result leaves in order."""
    best = F.min if keep == "smallest" else F.max
    return lines.groupBy("at", *KEY).agg(best("best").alias("best"), F.sum("n").alias("n")).sortWithinPartitions("at", *KEY)


def exchanged(level: DataFrame, stride: int, fan_in: int, slices: int) -> DataFrame:
    """``level`` with the digit of ``stride`` in every line's position replaced by that of its digest's slice."""
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint")
    ours, wanted = (F.pmod(F.floor(x / stride), F.lit(fan_in)) for x in (F.col("at"), F.floor(first * slices / 2**32)))
    return level.withColumn("at", (F.col("at") + (wanted - ours) * stride).cast("int")).repartition("at")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = 4096, fan_in: int = 16
) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, ``text_check``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so all null and empty
    texts are one group.  Of a group the row with the smallest (or ``keep="largest"``) id stays; a null
    id stays only in a group without any other.  Rows stay rows: those that repeat both id and text are
    counted one by one and share their verdict.  An empty table gives no rows.  Other columns are
    not read, whatever their names.  ``runs`` is the number of positions: more of them make smaller tasks.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    text = normalised(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("at"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("octets"),
        F.xxhash64(text).alias("check"),
    )
    # Written at once, so rows stay at the position where they were read.
    rows = cut(rows, "dedup-rows")
    lines = rows.select("at", *KEY, F.when(F.col("id").isNotNull(), F.struct("id")).alias("best"), F.lit(1).cast("bigint").alias("n"))
    leaves = level = cut(merged(lines, keep), "dedup-leaves")
    stride = 1
    while stride < runs:
        stride *= fan_in
    while stride > 1:
        stride //= fan_in
        above = cut(merged(exchanged(level, stride, fan_in, runs), keep), "dedup-run")
        if level is not leaves:
            remove(level)
        level = above

    winners = level.filter("n > 1").select(*KEY, F.col("best.id").alias("best_id"), "n")
    found = leaves.select("at", *KEY).join(winners, KEY)
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best_id"))
    return rows.join(found, ["at", *KEY], "left").select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("check").alias("text_check"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that survive :func:`exact_dedup`, one for each text, with their columns."""
    verdict = cut(exact_dedup(docs, id_col, text_col, keep).select(F.col(id_col).alias("_id"), "kept", "group_size", F.col("text_check").alias("_check")), "dedup-verdict")
    here = docs.withColumn("_check", F.xxhash64(normalised(text_col)))
    same = [F.col(id_col).eqNullSafe(F.col("_id")), F.col("_check") == F.col("_gone")]
    gone = cut(verdict.filter("not kept").select("_id", F.col("_check").alias("_gone")), "dedup-gone")
    left = here.join(sized(gone), same, "left_anti")
    # A document whose row occurs more than once keeps one of its equal rows.
    again = cut(left.groupBy(F.col(id_col).alias("_id"), F.col("_check").alias("_gone")).count().filter("count > 1").drop("count"), "dedup-again")
    if again.isEmpty():
        return left.drop("_check")
    hinted = sized(again)
    return left.join(hinted, same, "left_anti").unionByName(left.join(hinted, same, "left_semi").dropDuplicates([id_col, "_check"])).drop("_check")
