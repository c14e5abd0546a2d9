"""Exact Jaccard join of word-shingle sets in metric space.

Jaccard distance is a metric, but unrelated documents all lie at distance 1 of each other and of any
document taken as a pivot, so Voronoi regions of a few document pivots would have to be replicated whole.
Pivots are therefore found by cells, and regions join recursively around them, each step exact:

1. *Rings* around the empty set: documents are dealt by set size, and those near a ring's edge are
   replicated to the next ring (for a link, sizes differ by the threshold at most).
2. *Cells*: in a ring whose links have at most d differing shingles, the shingles' hash space is cut into
   more than d slices.  Linked documents agree on a whole slice that is not empty, so equal slices are a cell.
   (Slices empty in both are excused by spare slices; a document with too many empty ones is cut again by
   further, independent slicings until it has few enough, so no pair is lost.)
3. *Regions*: the smallest class in a cell is its pivot, and a document belongs to the regions of the pivots of all its
   cells.  Documents within the threshold of the pivot are linked to it.  By the triangle inequality a document outside
   can only link to those inside whose distance to the pivot is at most the threshold less than its own: this window is
   replicated to the rest, the others are done.  A rest of more than ``block`` documents (or ``BLOCK_SHINGLES``) takes one of
   its own as pivot and is joined so again; smaller ones are joined in one task, by their differences to the
   pivot.  A rest that a round no longer halves, or that is large after
   ``ROUNDS`` rounds, is joined block by block.

Parity sketches, whose distance is a lower bound, drop documents without a possible partner before sets travel.
Documents with equal sets are one class throughout.  Regions return a spanning forest of their links,
never pairs.  Shingles are 64-bit hashes.  Cells travel once, packed by bucket (14 bytes each); their keys are cut
to 47 bits and the bucket, and two that fall together only add a candidate.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, sized
from .components import components

_U = np.uint64
#: Cells that a task holds before it writes them, and about the shingles of a bucket of cells.
FLUSH = 1 << 20
#: Rows of a task that are worked on at a time, shingles of a region that one task joins, rounds of smaller regions.
SLICE, BLOCK_SHINGLES, ROUNDS = 1000, 2_000_000, 6
_BASE = 0x9E3779B97F4A7C15  # odd


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and shift)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_powers = {"n": 0}


def _power_tables(n: int):
    """Powers of the base and of its inverse modulo 2^64, for at least ``n`` positions; kept up to a size."""
    if n <= _powers["n"]:
        return _powers["up"], _powers["down"]
    size, tables = max(1 << 16, 1 << (n - 1).bit_length()), []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, _U)
        steps[0] = 1
        tables.append(np.multiply.accumulate(steps))
    if size <= 1 << 18:
        _powers.update(n=size, up=tables[0], down=tables[1])
    return tables


def sliced(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of ``text`` with A-Z lower-cased, in order."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    if not raw:
        return np.empty(0, _U)
    b = np.frombuffer(raw, np.uint8)
    solid = np.zeros(len(b) + 2, np.int8)
    solid[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    turns = np.diff(solid)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, _U)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles; a shorter text is one shingle, none if empty."""
    h = word_hashes(text or "")
    n = min(words, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, _U)
    for k in range(n):
        out = mix(out * _U(_BASE) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def class_id(shingles: np.ndarray) -> int:
    return int(mix(np.array([shingles.sum(dtype=_U) + _U(len(shingles)) * _U(_BASE)], _U)).view(np.int64)[0])


class Rings:
    """Size rings and the number of slices in each, for ``den * intersection >= num * union``."""

    def __init__(self, num: int, den: int, ratio: float = 1.4):
        if not 0.8 * den <= num <= den:
            raise ValueError("the slices take a similarity of at least 0.8")
        self.num, self.den, self.edges, self.ratio = num, den, [1], ratio

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * self.ratio)))
        return bisect_right(self.edges, n) - 1

    def for_size(self, n: int) -> range:
        """A document's own ring, and those that its larger partners may be in."""
        return range(self.of(n), self.of(n * self.den // self.num) + 1)

    @lru_cache(maxsize=None)  # noqa: B019  one object per task
    def slices(self, ring: int) -> tuple[int, int]:
        """Number of slices, and how many empty ones are excused."""
        while len(self.edges) <= ring + 1:
            self.of(self.edges[-1])
        most, least = self.edges[ring + 1] - 1, max(1, -(-self.edges[ring] * self.num // self.den))
        differ = 2 * most * (self.den - self.num) // (self.den + self.num)
        for spare in range(2 * differ + 1):  # so many that a set of the least size nearly always fills more than ``differ``
            empty = (differ + 1 + spare) * math.exp(-least / (differ + 1 + spare))
            if empty < 0.05 or empty + 2 * math.sqrt(empty) <= spare:
                break
        else:
            spare = 0
        return differ + 1 + spare, spare


def signatures(shingles: np.ndarray, rings: Rings) -> np.ndarray:
    """Keys of the cells of one document: (ring, slicing, slice, hash of the shingles in it)."""
    out = []
    for ring in rings.for_size(len(shingles)) if len(shingles) else ():
        slices, spare = rings.slices(ring)
        edges = np.array([(i << 64) // slices for i in range(slices)], _U) if slices > 1 else np.zeros(1, _U)
        for slicing in range(10_000):
            h = np.sort(mix(shingles + _U(slicing))) if slicing else shingles
            at = np.searchsorted(h, edges)
            full = np.flatnonzero(np.diff(at, append=len(h)))
            sums = np.add.reduceat(h, at[full])
            out.append(mix(mix(sums + full.astype(_U)) + _U(((ring << 16) + slicing) * _BASE % (1 << 64))))
            if slices - len(full) <= spare:
                break
        else:  # documents that no slicing suits meet in a cell of their own
            out.append(mix(np.array([(ring << 32) + 1], _U)))
    return np.concatenate(out) if out else np.empty(0, _U)


def packed_cells(keys: np.ndarray, cls: np.ndarray, buckets: int, task: int) -> pa.RecordBatch:
    """Cells of some documents as a row per bucket: salt 0 has each cell once (6 bytes: 47 bits of the key, and whether several
    classes are in it) with its smallest class; a salt of the task's own has the other classes, so that hot cells spread."""
    order = np.lexsort((cls, keys))
    keys, cls = keys[order], cls[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1]))
    keys, cls = keys[new], cls[new]
    first = np.append(True, keys[1:] != keys[:-1])
    several = np.diff(np.flatnonzero(np.append(first, True))) > 1
    out = []
    for salt, chosen, flag in ((0, first, several.astype(_U)), (task, ~first, _U(0))):
        k, c = keys[chosen], cls[chosen]
        bucket = k % _U(buckets)
        value = ((k // _U(buckets)) << _U(1) & _U((1 << 48) - 1)) | flag
        order = np.argsort(bucket, kind="stable")
        bucket, value, c = bucket[order], value[order], c[order]
        at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
        raw = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(bucket)]):
            out.append((int(bucket[i]), salt, raw[i:j].tobytes(), c[i:j].tobytes()))
    columns = list(zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["bucket", "salt", "cells", "classes"])


def shared_cells(bucket: int, salt: int, cells: bytes, classes: bytes, buckets: int) -> pd.DataFrame:
    """(cell, cls, pivot) of a bucket's cells with several classes; a row with cls = pivot for cells whose other classes
    come under a task's salt, which have no pivot yet."""
    cls = np.frombuffer(classes, np.int64)
    value = np.zeros((len(cls), 8), np.uint8)
    value[:, :6] = np.frombuffer(cells, np.uint8).reshape(-1, 6)
    value = value.view("<u8").ravel()
    cell = (value >> _U(1)) * _U(buckets) + _U(bucket)
    if salt:
        return pd.DataFrame({"cell": cell.view(np.int64), "cls": cls, "pivot": pd.array([None] * len(cls), "Int64")})
    order = np.lexsort((cls, cell))
    cell, cls, several = cell[order], cls[order], (value[order] & _U(1)).astype(bool)
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    counts = np.diff(np.append(start, len(cell)))
    pivot = np.repeat(cls[start], counts)
    head = np.zeros(len(cell), bool)
    head[start] = np.logical_or.reduceat(several, start)
    keep = head | (cls != pivot)
    return pd.DataFrame({"cell": cell[keep].view(np.int64), "cls": cls[keep], "pivot": pd.array(pivot[keep], "Int64")})


def parity_sketch(shingles: np.ndarray) -> bytes:
    """For each of 2^k >= 2n stretches of the hash space, the parity of the number of shingles in it, as bits.  Two sets
    differ in at least as many shingles as their sketches differ in bits."""
    k = max(6, (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> _U(64 - k)).astype(np.int64), minlength=1 << k) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: bytes, length: int) -> np.ndarray:
    """A sketch of ``length`` bytes as words: neighbouring stretches are merged, parities add."""
    bits = np.unpackbits(np.frombuffer(sketch, np.uint8)).reshape(length * 8, -1)
    return np.packbits(np.bitwise_xor.reduce(bits, axis=1)).view(_U)


def may_link(size: np.ndarray, sketches: list[bytes], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Documents that their sketches allow a link to some other one; with ``side``, to one on the other side."""
    length = min(len(x) for x in sketches)
    table, hit = np.stack([folded(x, length) for x in sketches]), np.zeros(len(size), bool)
    for x in range(len(size)):
        if side is not None and side[x]:
            continue
        apart = np.maximum(np.bitwise_count(table ^ table[x]).sum(axis=1, dtype=np.int64), np.abs(size - size[x]))
        union2 = size[x] + size + apart
        near = den * (union2 - 2 * apart) >= num * union2
        if side is not None:
            near &= side == 1
        near[x] = False
        if near.any():
            hit |= near
            hit[x] = True
    return hit


def region_forest(cls: np.ndarray, size: np.ndarray, diffs: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links in a region; with ``side`` (0 or 1), of those between the two sides.

    A document is given by its size and its difference to the pivot; the sizes of two differences
    and of their overlap give the size of the difference of the two documents."""
    g = len(cls)
    d = np.array([len(x) for x in diffs], np.int64)
    tokens, ids = np.unique(np.concatenate(diffs) if g else np.empty(0, np.int64), return_inverse=True)
    owner = np.repeat(np.arange(g), d)
    order = np.argsort(ids, kind="stable")
    posting = owner[order]
    at = np.searchsorted(ids[order], np.arange(len(tokens) + 1))
    begin = np.concatenate([[0], np.cumsum(d)])
    label, edges = np.arange(g), []
    for x in range(g):
        if side is not None and side[x]:
            continue
        own = ids[begin[x] : begin[x + 1]]
        shared = np.bincount(np.concatenate([posting[at[t] : at[t + 1]] for t in own]), minlength=g) if len(own) else np.zeros(g, np.int64)
        apart = d[x] + d - 2 * shared
        union2 = size[x] + size + apart  # twice the union
        linked = (label != label[x]) & (den * (union2 - 2 * apart) >= num * union2)
        if side is not None:
            linked &= side == 1
        else:
            linked[: x + 1] = False
        for y in np.flatnonzero(linked).tolist():
            if label[y] != label[x]:
                edges.append((int(cls[x]), int(cls[y])))
                label[label == label[y]] = label[x]
        if len(edges) == g - 1:
            break
    return edges


def jaccard_components(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 2000
) -> DataFrame:
    """id, ``n_shingles`` and ``component_id`` (smallest id reachable by links, itself included) per row.

    Two documents link when ``den * intersection >= num * union`` of their shingle sets.  A text without
    words (or null) has an empty set and links with nothing; a null id takes part like any other and is
    the component's only if all its ids are null.  Rows that repeat an id or a text give a row each.  An
    empty table gives no rows.  Whole texts count, however long; other columns are not read.
    """
    return _components_of(docs, words, num, den, id_col, text_col, block).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def _components_of(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, block: int) -> DataFrame:
    """(id, check, n_shingles, component, component_id) per row: a hash of the text, and the number of the row's component, null
    for rows alone in theirs."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def describe(batches):
        for b in sliced(batches):
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_id(s) if len(s) else None for s in sets], pa.int64())],
                ["id", "check", "n_shingles", "cls"],
            )

    def cells(batches):
        rings, task, waiting, held = Rings(num, den), TaskContext.get().partitionId() + 1, [], 0
        for b in sliced(batches):
            for t in b.column(0).to_pylist():
                s = shingle_set(t, words)
                if len(s):
                    keys = signatures(s, rings)
                    waiting.append((keys, np.full(len(keys), class_id(s), np.int64)))
                    held += len(keys)
                if held >= FLUSH:
                    yield packed_cells(*(np.concatenate(x) for x in zip(*waiting)), buckets, task)
                    waiting, held = [], 0
        if held:
            yield packed_cells(*(np.concatenate(x) for x in zip(*waiting)), buckets, task)

    def meet(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return shared_cells(int(key[0]), int(key[1]), b"".join(group["cells"]), b"".join(group["classes"]), buckets)

    def of_class(b):
        """(class, set) of the rows whose text has the set of the class that they speak for."""
        return [(c, s) for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if class_id(s := shingle_set(t, words)) == c]

    def sketches_of(batches):
        for b in sliced(batches):
            found = of_class(b)
            columns = [[c for c, _ in found], [len(s) for _, s in found], [parity_sketch(s) for _, s in found]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["cls", "size", "sketch"])

    def sets_of(batches):
        for b in sliced(batches):
            found = of_class(b)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["cls", "shingles"])

    def prune(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        hit = may_link(group["size"].to_numpy(), list(group["sketch"]), num, den)
        return group.loc[hit, ["pivot", "cls"]]

    def large_of(pairs: DataFrame, name: str) -> DataFrame:
        """(pivot, blocks) of the regions that one task can't join, by documents or by shingles: written, few."""
        blocks = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
        return sized(cut(pairs.groupBy("pivot").agg(blocks.alias("blocks")).filter("blocks > 1"), name))

    members = cut(source.withColumn("check", F.xxhash64("text")).mapInArrow(describe, f"id {kind}, check bigint, n_shingles bigint, cls bigint"), "jaccard-members")
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, total // FLUSH)
    classes = cut(members.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("first_id"), F.min(F.struct("id", "check")).alias("speaker"), F.count("*").alias("n")), "jaccard-classes")
    packed = source.select("text").mapInArrow(cells, "bucket bigint, salt int, cells binary, classes binary")
    shared = cut(packed.groupBy("bucket", "salt").applyInPandas(meet, "cell bigint, cls bigint, pivot bigint"), "jaccard-cells")
    heads = shared.filter("cls = pivot").select("cell", "pivot")
    local = shared.filter("pivot is null").select("cell", "cls").join(sized(heads), "cell").select("cls", "pivot")
    regions = cut(local.unionByName(shared.filter("cls <> pivot").select("cls", "pivot")).filter("cls <> pivot").distinct(), "jaccard-regions")
    remove(shared)

    def texts(chosen: DataFrame) -> DataFrame:
        # By id and text: other texts of a repeated or null id are not hashed for a class that is not theirs.
        speakers = cut(classes.join(chosen.distinct(), "cls").select("cls", F.col("speaker.id").alias("_speaker"), F.col("speaker.check").alias("_said")), "jaccard-speakers")
        spoken = source.withColumn("_check", F.xxhash64("text"))
        return spoken.join(sized(speakers), F.col("id").eqNullSafe(F.col("_speaker")) & (F.col("_check") == F.col("_said"))).select("text", "cls")

    # Sketches drop the documents of a region that can't have a link in it, before their sets travel.
    sketches = cut(texts(regions.select("cls").union(regions.select("pivot"))).mapInArrow(sketches_of, "cls bigint, size bigint, sketch binary").dropDuplicates(["cls"]), "jaccard-sketches")
    whole = regions.unionByName(regions.select("pivot").distinct().select(F.col("pivot").alias("cls"), "pivot"))
    described = whole.join(sketches, "cls")
    large = large_of(described, "jaccard-large")
    few = described.join(large, "pivot", "left_anti").groupBy("pivot").applyInPandas(prune, "pivot bigint, cls bigint")
    near = cut(few.unionByName(whole.join(large, "pivot", "left_semi").select("pivot", "cls")).filter("cls <> pivot"), "jaccard-near")
    sets = cut(texts(near.select("cls").union(near.select("pivot"))).mapInArrow(sets_of, "cls bigint, shingles array<bigint>").dropDuplicates(["cls"]), "jaccard-sets")
    of_pivot = sets.select(F.col("cls").alias("pivot"), F.col("shingles").alias("_of_pivot"))

    reach = 1 - num / den
    edges, rest, now, before = [], [], near, None
    for round_number in range(ROUNDS):
        both = F.size(F.array_intersect("shingles", "_of_pivot")).cast("bigint")
        seen = now.join(sets, "cls").join(of_pivot, "pivot").select("pivot", "cls", F.size("shingles").cast("bigint").alias("size"), F.size("_of_pivot").cast("bigint").alias("pivot_size"), both.alias("both"))
        union = F.col("size") + F.col("pivot_size") - F.col("both")
        seen = cut(seen.withColumn("linked", den * F.col("both") >= num * union).withColumn("far", 1 - F.col("both") / union), f"jaccard-round{round_number}")
        edges.append(seen.filter("linked").select(F.col("pivot").alias("a"), F.col("cls").alias("b")))
        outside = cut(seen.filter("not linked").groupBy("pivot").agg(F.min("far").alias("nearest"), F.min("cls").alias("next")), "jaccard-outside")
        window = seen.join(sized(outside), "pivot").filter(~F.col("linked") | (F.col("far") >= F.col("nearest") - reach - 1e-9))
        window = cut(window.select("pivot", "cls", "size", "next"), f"jaccard-window{round_number}")
        large = large_of(window, "jaccard-large")
        rest.append(window.join(large, "pivot", "left_anti").select("pivot", "cls", F.lit(1).alias("blocks")))
        waiting = window.join(large, "pivot").select("pivot", "cls", "blocks")
        left = waiting.count()
        if left and (round_number == ROUNDS - 1 or before is not None and 2 * left > before):
            rest.append(waiting)  # rounds no longer halve it
            left = 0
        if not left:
            break
        before, now = left, window.join(large, "pivot", "left_semi")
        now = now.filter("cls <> next").select(F.col("next").alias("pivot"), "cls").distinct()
    small = rest[0]
    for more in rest[1:]:
        small = small.unionByName(more)
    rows = small.join(sets, "cls").join(of_pivot, "pivot").select(
        "pivot", "blocks", "cls", F.size("shingles").cast("bigint").alias("size"),
        F.concat(F.array_except("shingles", "_of_pivot"), F.array_except("_of_pivot", "shingles")).alias("diff"),
    )
    own = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")

    def join_region(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, i, j = (int(k) for k in key)
        group = group.drop_duplicates("cls").sort_values("cls", ignore_index=True)
        side = None if i == j else (group["own"].to_numpy() == j).astype(int)
        found = region_forest(group["cls"].to_numpy(), group["size"].to_numpy(), [np.asarray(x, np.int64) for x in group["diff"]], num, den, side)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    links = dealt.groupBy("pivot", "i", "j").applyInPandas(join_region, "a bigint, b bigint")
    for more in edges:
        links = links.unionByName(more)
    linked = components(links).withColumnsRenamed({"node": "cls"})
    named = classes.join(linked, "cls", "left").filter("n > 1 or component is not null").withColumn("component", F.coalesce("component", "cls"))
    named = cut(named.select("cls", "component", "first_id"), "jaccard-named")
    first = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = cut(named.join(first, "component").select("cls", "component", "component_id"), "jaccard-found")
    for used in (regions, sketches, near, sets, named):
        remove(used)
    return members.join(sized(found), "cls", "left").select(
        "id", "check", "n_shingles", "component", F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def keep_one_per_component(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay when each component keeps the one with its smallest id; all columns of ``docs``.

    Of several texts with that id the one with the smallest hash stays; a null id stays only where all are null.  Rows that
    repeat the id and text that stay all stay (exact dedup drops such rows).  Documents alone in their component stay.
    """
    found = cut(_components_of(docs, words, num, den, id_col, text_col, 2000).filter("component is not null").select("id", "check", "component"), "jaccard-members")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "check")
    best = found.groupBy("component").agg(F.min(order).alias("best"))
    gone = found.join(best, "component").filter(~(F.col("id").eqNullSafe(F.col("best.id")) & F.col("check").eqNullSafe(F.col("best.check"))))
    gone = cut(gone.select(F.col("id").alias("_gone"), F.col("check").alias("_gone_check")).distinct(), "jaccard-gone")
    here = docs.withColumn("_check", F.xxhash64(F.col(text_col)))
    return here.join(sized(gone), F.col(id_col).eqNullSafe(F.col("_gone")) & (F.col("_check") == F.col("_gone_check")), "left_anti").drop("_check")
