"""Best-fit packing by hierarchical residual packing.

Pieces are dealt into groups of bounded size; each group is packed best-fit (largest first).  Nearly
full bins are final.  Underfull bins become items themselves: groups of a tree level meet, ``fan_in`` at
a time, and
their bins are best-fit packed again (as wholes, or as pieces where that needs fewer bins), until one
group is left or a level's groups would exceed the bound.  What moves is a few numbers per piece, never text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import cut

PIECE = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut each document's ids (plus ``end_id``) into pieces of ``capacity``; the first may be shorter.
    Null and empty texts are one piece holding just the end id."""

    def run(batches):
        bpe, end = load(vocabulary), end_id.to_bytes(4, "little")
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = bpe.encode_bytes(text or "") + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for i, (s, e) in enumerate(zip(edges, edges[1:])):
                    at.append(k)
                    piece.append(i)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[4 * s : 4 * e]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = PIECE.format(id=docs.schema[id_col].dataType.simpleString())
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken largest first; each goes to the fullest bin that has room.
    Bins are kept by free space, and a bit set of the free spaces in use finds the tightest one."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, rooms = 0, 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room, used = used, capacity, used + 1
        bins[k], offsets[k] = b, capacity - room
        by_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 20_000, fan_in: int = 16, slack: int = 8) -> DataFrame:
    """Place every piece: adds ``sequence_id`` and ``offset``.

    ``length`` must be between 1 and ``capacity``.  Equal lengths are taken in order of id and piece, so
    the result does not depend on how rows arrive.  Bins with at most ``slack`` free places are final at
    once.  Null ids and repeated rows are pieces like any other.  An empty table gives no rows.
    """
    kind = pieces.schema["doc_id"].dataType.simpleString()
    out = PIECE.format(id=kind) + ", sequence_id bigint, offset bigint, open boolean"

    def packer(level: int):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["sequence_id", "offset", "doc_id", "piece", "ids_crc32"] if level else ["doc_id", "piece", "length", "ids_crc32"], ignore_index=True)
            lengths = group["length"].to_numpy()
            mine, offset = best_fit(lengths, capacity)
            if level:  # underfull bins as items; taken apart only where that saves bins
                item = pd.factorize(group["sequence_id"])[0]
                bins, offsets = best_fit(np.bincount(item, weights=lengths).astype(np.int64), capacity)
                if bins.max() <= mine.max():
                    mine, offset = bins[item], offsets[item] + group["offset"].to_numpy()
            filled = np.bincount(mine, weights=lengths)
            group["offset"] = offset
            group["sequence_id"] = (level << 56) + (int(key[0]) << 24) + mine
            group["open"] = filled[mine] < capacity - slack
            return group[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]]

        return run

    def level_of(rows: DataFrame, level: int, groups: int) -> DataFrame:
        by = ["sequence_id"] if level else ["doc_id", "piece", "ids_crc32"]
        keyed = rows.withColumn("_group", F.pmod(F.xxhash64(F.lit(level), *by), F.lit(groups)))
        return cut(keyed.groupBy("_group").applyInPandas(lambda key, g: packer(level)(key, g.drop(columns="_group")), out), f"pack-level{level}")

    rows, level, done = pieces.count(), 0, []
    groups = max(1, -(-rows // group_rows))
    packed = level_of(pieces, 0, groups)
    while groups > 1:
        done.append(packed.filter("not open"))
        waiting = packed.filter("open")
        fewer = max(-(-groups // fan_in), -(-waiting.count() // (4 * group_rows)))
        if fewer >= groups:
            done.append(waiting)
            packed = None
            break
        groups, level = fewer, level + 1
        packed = level_of(waiting.drop("open"), level, groups)
    if packed is not None:
        done.append(packed)
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.drop("open")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack every document: one row per piece with its sequence and place in it.  Null and empty texts
    are one piece of the end id alone; longer texts than a sequence are cut; rows stay rows; other columns are not read."""
    return pack(cut(token_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col), "pack-pieces"), capacity)
