"""Embedding near-dedup by product quantisation, exact.

A bounded sample trains coarse centroids and, for the residuals, one codebook per subspace.  Every vector is put
on the inverted list of its nearest centroid as a residual code.  A list is left out for a vector only where the
triangle inequality or the list's bisector rules out a partner at the threshold, and an entry only where its quantised
cosine (exact query, quantised entry, from lookup tables) is below the threshold by more than its own quantisation error:
by Cauchy-Schwarz q.e <= q.code + |e - code|, so no link is lost.  The rest are compared by exact cosine in double precision.

Lists that are close travel as one bucket and long lists are dealt into blocks, so a vector is sent at most once to each block
and no task holds a list of unbounded length.  Every pair meets in one task only and is counted for both its ends.
On vectors without clusters no list can be left out, and the comparisons are quadratic.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

#: Rows of the training sample, by a hash of their content.
SAMPLE_ROWS = 20_000
SUBSPACES, CODES = 8, 256
#: Numbers (rows times dimensions) of a block of entries and of a part of the vectors that meet it; room for rounding.
BLOCK, PART, ROUNDING = 640_000, 2_560_000, 1e-9


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


class Quantiser:
    def __init__(self, sample: np.ndarray, rows: int):
        dim = sample.shape[1]
        lists = max(1, min(len(sample) // 16, 1024, int(math.sqrt(rows) / 2)))
        self.centres = k_means(sample, lists)
        self.cuts = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
        rest = sample - self.centres[self.lists(sample)]
        self.books = [k_means(np.ascontiguousarray(rest[:, a:b]), min(CODES, len(rest)), 5) for a, b in zip(self.cuts, self.cuts[1:])]

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest list of each row; ties by number."""
        return ((self.centres**2).sum(1) - 2 * x @ self.centres.T).argmin(1)

    def far(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Squared distance of each row to each of the lists' centres."""
        c = self.centres[lists]
        return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)

    def may_link(self, x: np.ndarray, home: np.ndarray, lists: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
        """Whether a list can hold a vector within ``reach`` of each row, given its entries' largest distance from its centre.

        An entry is no nearer to the row's own centre than to its list's, so it is beyond their bisector."""
        far = self.far(x, lists)
        own = ((x - self.centres[home]) ** 2).sum(1)
        apart = np.sqrt(self.far(self.centres, lists))[home]
        return (np.sqrt(far) - radius <= reach + 1e-6) & (far - own[:, None] <= 2 * apart * reach + 1e-6)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centres[lists]
        parts = [(rest[:, a:b] @ book.T - 0.5 * (book**2).sum(1)).argmax(1) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)]
        return np.stack(parts, 1)

    def approximate(self, queries: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Cosine of each query with each entry of a list, from one table per query and subspace."""
        out = np.repeat((queries @ self.centres[centre])[:, None], len(codes), 1)
        for m, ((a, b), book) in enumerate(zip(zip(self.cuts, self.cuts[1:]), self.books)):
            out += np.take(queries[:, a:b] @ book.T, codes[:, m], axis=1)
        return out

    def errors(self, x: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Length of what the code of each row leaves out."""
        rest = x - self.centres[centre]
        return np.sqrt(sum(((rest[:, a:b] - book[codes[:, m]]) ** 2).sum(1) for m, ((a, b), book) in enumerate(zip(zip(self.cuts, self.cuts[1:]), self.books))))


def unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Plan:
    """Where vectors of a table go: lists by their largest radius, buckets of close lists, and blocks of buckets as units."""

    def __init__(self, model: Quantiser, lists: np.ndarray, rows: np.ndarray, radius: np.ndarray, limit: float, block: int):
        self.model, self.reach, self.limit = model, math.sqrt(max(0.0, 2 - 2 * limit)), limit
        self.radius = np.zeros(len(model.centres))
        self.radius[lists] = radius
        count = dict(zip(lists.tolist(), rows.tolist()))
        bucket, filled, self.members = {}, block, []
        for k in self._chain(lists):  # every list goes to the bucket of the one before it while there is room
            if filled + count[k] > block:
                self.members.append([])
                filled = 0
            self.members[-1].append(k)
            bucket[k] = len(self.members) - 1
            filled += count[k]
        self.bucket = np.array([bucket.get(k, -1) for k in range(len(model.centres))])
        self.blocks = np.array([-(-sum(count[k] for k in m) // block) for m in self.members])
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])

    def _chain(self, lists: np.ndarray) -> list[int]:
        left, out = sorted(lists.tolist()), []
        while left:
            c = self.model.centres[left]
            at = int(((c - self.model.centres[out[-1]]) ** 2).sum(1).argmin()) if out else 0
            out.append(left.pop(at))
        return out

    def route(self, x: np.ndarray, home: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each row's unit and the other units that it is sent to: of two units one's rows go to the other."""
        own = self.bucket[home]
        block = cls % self.blocks[own]
        to = [[np.arange(self.first[b] + k + 1, self.first[b + 1])] for b, k in zip(own.tolist(), block.tolist())]
        for b, lists in enumerate(self.members):
            rows = np.nonzero((own != b) & (((own + b) % 2 == 0) == (own < b)))[0]
            if len(rows):
                lists = np.array(lists)
                for r in rows[self.model.may_link(x[rows], home[rows], lists, self.radius[lists], self.reach).any(1)].tolist():
                    to[r].append(np.arange(self.first[b], self.first[b + 1]))
        return self.first[own] + block, [np.concatenate(t).astype(np.int32) for t in to]


def search_block(queries: pd.DataFrame, entries: pd.DataFrame, plan: Plan, among: bool) -> pd.DataFrame:
    """A forest of the links of the queries with the entries (and ``among`` the entries): pairs (a, b) with n = 0.
    Besides, pairs (a, a) with the number n of vectors linked to a, weighed by copies, for both ends of all these links."""
    model, limit = plan.model, plan.limit
    entries = entries.sort_values(["list", "cls"])
    e, e_id, e_weight, e_list = unit(entries["embedding"]), entries["cls"].to_numpy(), entries["copies"].to_numpy(), entries["list"].to_numpy()
    every = pd.concat([entries] * among + [queries])
    if not len(every):
        return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
    q, q_id, q_weight, q_list = unit(every["embedding"]), every["cls"].to_numpy(), every["copies"].to_numpy(), every["list"].to_numpy()
    # An entry meets the entries after it.
    place = np.concatenate([np.arange(len(e))] * among + [np.full(len(queries), -1)])
    lists, starts = np.unique(e_list, return_index=True)
    meets = model.may_link(q, q_list, lists, plan.radius[lists], plan.reach)
    label, out, pairs = np.arange(len(e)), [], max(1, 4_000_000 // e.shape[1])
    q_links, e_links = np.zeros(len(q), np.int64), np.zeros(len(e), np.int64)
    for k, (begin, end) in enumerate(zip(starts, [*starts[1:], len(e)])):
        codes = model.encode(e[begin:end], np.full(end - begin, lists[k]))
        least = limit - ROUNDING - model.errors(e[begin:end], lists[k], codes)
        asked = np.nonzero(meets[:, k] & (place < end))[0]
        for at in range(0, len(asked), 256):
            some = asked[at : at + 256]
            rows, cols = np.nonzero(model.approximate(q[some], lists[k], codes) >= least)
            rows, cols = some[rows], cols + begin
            later = place[rows] < cols
            rows, cols = rows[later], cols[later]
            good = [np.einsum("ij,ij->i", q[rows[i : i + pairs]], e[cols[i : i + pairs]]) >= limit for i in range(0, len(rows), pairs)]
            if not good:
                continue
            good = np.concatenate(good)
            rows, cols = rows[good], cols[good]
            np.add.at(q_links, rows, e_weight[cols])
            np.add.at(e_links, cols, q_weight[rows])
            linked, bounds = np.unique(rows, return_index=True)
            for r, found in zip(linked.tolist(), np.split(cols, bounds[1:])):
                groups, first = np.unique(label[found], return_index=True)
                out += [(int(q_id[r]), int(e_id[found[f]]), 0) for f in first.tolist()]  # one edge to each group of entries not yet known to be linked
                if len(groups) > 1:
                    label[np.isin(label, groups)] = groups[0]
    counts = [pd.DataFrame({"a": i[n > 0], "b": i[n > 0], "n": n[n > 0]}) for i, n in ((q_id, q_links), (e_id, e_links))]
    return pd.concat([pd.DataFrame(out, columns=["a", "b", "n"]), *counts]).astype("int64")


def near_duplicates(vectors: DataFrame, limit: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, ``n_links``, ``component_id``, ``kept`` per row.

    Vectors link when their cosine is at least ``limit``; equal vectors always do.  Null or zero vectors and those with null or
    non-finite components link with nothing, nor do vectors of different lengths.  A null id takes part but is a component's
    id only if it has no other.  Rows that repeat an id are separate vectors.  An empty table gives no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    sound = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).withColumn("cls", F.when(sound, F.xxhash64("x", F.size("x"))))
    members = cut(rows.select("id", "cls"), "vectors-members")
    classes = cut(rows.filter("cls is not null").groupBy("cls").agg(F.first("x").alias("embedding"), F.min("id").alias("first_id"), F.count("*").alias("copies")), "vectors-classes")
    links = None
    sizes = [(r[0], r[1]) for r in classes.groupBy(F.size("embedding")).count().collect()]
    for dim, n in sorted(sizes):
        mine = classes.filter(F.size("embedding") == dim).select("cls", "embedding", "copies")
        sample = mine.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE_ROWS).select("embedding").toPandas()
        found = _links(mine, Quantiser(unit(sample["embedding"]), n), limit, dim, n)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return members.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    links = cut(links, "vectors-links")
    degree = links.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("found"))
    linked = components(links.select("a", "b")).withColumnRenamed("node", "cls")
    each = classes.select("cls", "first_id", "copies").join(degree, "cls", "left").join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    each = cut(each.select("cls", "first_id", "component", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vectors-each")
    first = each.groupBy("component").agg(F.min("first_id").alias("component_id"))
    verdict = cut(each.join(first, "component").select("cls", "n_links", "component_id", F.lit(True).alias("_found")), "vectors-verdict")
    component = F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("id"))
    return members.join(verdict, "cls", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept")
    )


def _links(vectors: DataFrame, model: Quantiser, limit: float, dim: int, n: int) -> DataFrame:
    def place(batches):
        for pdf in batches:
            x = unit(pdf["embedding"])
            home = model.lists(x)
            yield pdf.assign(list=home.astype(np.int32), radius=np.sqrt(((x - model.centres[home]) ** 2).sum(1)))

    placed = cut(vectors.mapInPandas(place, "cls bigint, embedding array<double>, copies bigint, list int, radius double"), "vectors-placed")
    stats = placed.groupBy("list").agg(F.count("*").alias("rows"), F.max("radius").alias("radius")).orderBy("list").toPandas()
    plan = Plan(model, stats["list"].to_numpy(), stats["rows"].to_numpy(), stats["radius"].to_numpy(), limit, max(1, BLOCK // dim))
    parts = -(-n // max(1, PART // dim))

    def route(batches):
        for pdf in batches:
            unit_of, to = plan.route(unit(pdf["embedding"]), pdf["list"].to_numpy(), pdf["cls"].to_numpy())
            yield pdf.drop(columns="radius").assign(unit=unit_of.astype(np.int32), to=to)

    routed = placed.mapInPandas(route, "cls bigint, embedding array<double>, copies bigint, list int, unit int, to array<int>")
    own = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(F.col("unit").alias("unit"), p.alias("part"), F.lit(True).alias("entry")))
    part = F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int")
    sent = F.transform("to", lambda u: F.struct(u.alias("unit"), part.alias("part"), F.lit(False).alias("entry")))
    both = routed.select("cls", "embedding", "copies", "list", F.explode(F.concat(own, sent)).alias("at")).select("cls", "embedding", "copies", "list", "at.*")

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return search_block(group[~group["entry"]].sort_values("cls"), group[group["entry"]], plan, among=int(key[1]) == 0)

    return both.groupBy("unit", "part").applyInPandas(search, "a bigint, b bigint, n bigint")
