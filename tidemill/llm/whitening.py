"""Embedding whitening by spectral divide and conquer.

Spark sums whole numbers exactly: the entries first, then the products of entries less their (whole) mean.  The
covariance that the driver gets has a row and a column for each dimension of a vector, whatever the table's size, and
is exact before it is rounded once.  There the polar factor of the covariance less a shift, found by the
QR-based dynamically weighted Halley iteration, gives the projector onto the eigenvalues above the shift.  The two invariant
subspaces are split in turn until they are single components.  Components and means (at most dimensions squared numbers) are
broadcast, and every vector is projected where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vectors import exact_gram, sound, whole

EPS = float(np.finfo(np.float64).eps)


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix (its sign function), by QDWH iteration."""
    m = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    least = EPS  # of the singular values; too low a guess costs an iteration at most
    for _ in range(30):
        d = np.cbrt(4 * (1 - least**2) / least**4) if least < 1 else 0.0
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - least**2) / (least**2 * np.sqrt(1 + d))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(m)]))
        y = b / c * x + (h - b / c) / np.sqrt(c) * (q[:m] @ q[m:].T)
        y = (y + y.T) / 2
        least = min(1.0, least * (h + b * least**2) / (1 + c * least**2))
        moved, x = np.linalg.norm(y - x), y
        if moved <= EPS ** (1 / 3) and abs(1 - least) < 10 * EPS:
            break
    return x


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, that of the larger eigenvalues first; None if they are all alike."""
    m, scale = len(a), np.linalg.norm(a)
    middle = np.trace(a) / m  # between the least and the largest eigenvalue
    spread = np.linalg.norm(a - middle * np.eye(m))
    if spread <= 4 * EPS * m * scale:
        return None
    best = None
    for nudge in (0.0, 0.11, -0.07, 0.23, -0.19, 0.03):
        u = polar(a - (middle + nudge * spread / np.sqrt(m)) * np.eye(m))
        projector = (u + np.eye(m)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < m:
            continue
        y = rng.normal(size=(m, k))
        for _ in range(2):
            y, _ = np.linalg.qr(projector @ y)
        q, _ = np.linalg.qr(y, mode="complete")
        off = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or off < best[0]:
            best = off, q[:, :k], q[:, k:]
        if off <= 10 * EPS * m * scale:  # else an eigenvalue is too close to the shift: move it
            break
    return best and best[1:]


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns."""
    rng, found = np.random.default_rng(7), []
    todo = [np.eye(len(v))]
    while todo:
        basis = todo.pop()
        block = basis.T @ v @ basis
        block = (block + block.T) / 2
        halves = split(block, rng) if len(block) > 1 else None
        if halves is None:
            found += [(float(block[i, i]), basis[:, i]) for i in range(len(block))]
        else:
            todo += [basis @ half for half in halves]
    found.sort(key=lambda p: -p[0])
    q, r = np.linalg.qr(np.stack([p[1] for p in found], 1))  # the bases are orthonormal but for rounding
    q *= np.where(np.diag(r) < 0, -1.0, 1.0)
    return np.array([float(c @ v @ c) for c in q.T]), q


def summed(rows: DataFrame, names: list[str], what) -> dict:
    """Exact sums over all rows of the whole numbers that ``what`` gives for a matrix of entries: one small set from each task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                now = what(batch)
                total = now if total is None else {k: total[k] + v for k, v in now.items()}
        if total is not None:
            keys = list(total)
            columns = [pa.array([k[i] for k in keys], pa.int32()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([Decimal(int(total[k])) for k in keys], pa.decimal128(38, 0))], names=[*names, "part"])

    parts = rows.mapInArrow(partial, ", ".join(f"{c} int" for c in names) + ", part decimal(38,0)")
    return {tuple(r[:-1]): int(r[-1]) for r in parts.groupBy(*names).agg(F.sum("part")).collect()}


class Fit:
    """Mean and components of all rows of one dimension."""

    def __init__(self, rows: DataFrame, dim: int, most: int, offset: int):
        self.dim, self.offset = dim, offset
        first = summed(rows, ["i"], lambda b: {(-1,): b.num_rows, **{(i,): s for i, s in enumerate((whole(b.column("v"), dim) + offset).sum(0).tolist())}})
        self.n = n = first[(-1,)]
        self.sums = [first[(i,)] for i in range(dim)]
        middle = np.array([s // n for s in self.sums], dtype=np.int64)

        def products(b: pa.RecordBatch) -> dict:
            gram = exact_gram(whole(b.column("v"), dim) + offset - middle)
            return {(i, j): gram[i, j] for i in range(dim) for j in range(i, dim)}

        cross = summed(rows, ["i", "j"], products)
        rest = [s - n * m for s, m in zip(self.sums, middle.tolist())]
        v = np.zeros((dim, dim))
        for (i, j), c in cross.items():
            v[i, j] = v[j, i] = float(Fraction(n * c - rest[i] * rest[j], n * n))
        self.values, vectors = components(v)
        self.vectors = vectors[:, :most]
        self.trace = float(sum(Fraction(n * cross[(i, i)] - rest[i] ** 2, n * n) for i in range(dim)))
        self.real = self.values[:most] > dim * EPS * max(self.trace, 0.0)

    def apply(self, batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
        """``deviation`` and the whitened entries of a batch."""
        x, n = whole(batch.column("v"), self.dim) + self.offset, self.n
        if n * max(1, int(np.abs(x).max(initial=0))) < 2**61:
            d = n * x - np.array(self.sums, dtype=np.int64)
            safe = int(np.abs(d).max(initial=0)) ** 2 * self.dim < 2**62
            deviation = (d**2).sum(1).tolist() if safe else (d.astype(object) ** 2).sum(1).tolist()
            centred = d.astype(np.float64) / n
        else:
            d = x.astype(object) * n - np.array(self.sums, dtype=object)
            deviation, centred = (d**2).sum(1).tolist(), (d / n).astype(np.float64)
        white = (centred @ self.vectors) / np.sqrt(np.where(self.real, self.values[: self.vectors.shape[1]], 1.0))
        white[:, ~self.real] = 0.0
        k = white.shape[1]
        return pa.array([v if v < 2**63 else None for v in deviation], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, k * (len(x) + 1), k), pa.int32()), pa.array(white.ravel()))


def identity_error(white: DataFrame, real: list[int]) -> float:
    """Largest entry of the whitened components' covariance less the identity, over all rows, centred before multiplying."""
    means = white.agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in real]).first()
    pairs = [(i, j) for i in real for j in real if i <= j]
    entry = lambda i: F.get("w", F.lit(i)) - F.lit(means[f"m{i}"])
    cov = white.agg(*[F.avg(entry(i) * entry(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, most: int = 8, offset: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``: a row for each vector and component up to ``most``.

    Entries become floor(1024 * entry) + ``offset``, which cancels out.  Left out are vectors that are null or have no entries, and those with entries that are null, non-finite or of 2**17
    and more (which whole numbers of 64 bits cannot hold squared).  Vectors of each length are fitted and whitened apart.  Repeated rows
    count and come back as often as they occur; null ids are kept.  A component without variance (equal vectors, or fewer
    vectors than dimensions) has ``whitened`` 0 and no part in ``identity_error``, which is 0 where no component has any;
    ``explained`` is 0 where the trace is.  A ``deviation`` beyond a long is null.  An empty table gives no rows.
    """
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(sound("v") & (F.size("v") > 0))
    kind = kept.schema["id"].dataType.simpleString()
    out = None
    for (dim,) in sorted(kept.select(F.size("v")).distinct().collect()):
        rows = kept.filter(F.size("v") == dim)
        fit = Fit(rows.select("v"), dim, most, offset)

        def project(batches: Iterator[pa.RecordBatch], fit: Fit = fit) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("id"), *fit.apply(batch)], names=["id", "deviation", "w"])

        white = cut(rows.mapInArrow(project, f"id {kind}, deviation bigint, w array<double>"), "whitened")
        real = np.nonzero(fit.real)[0].tolist()
        error = identity_error(white, real) if real else 0.0
        share = [float(e / fit.trace) if fit.trace > 0 else 0.0 for e in fit.values[:most]]
        long = white.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
            F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
            F.get(F.array(*[F.lit(s) for s in share]), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
        )
        out = long if out is None else out.unionByName(long)
    if out is None:
        return kept.select(F.col("id").alias(id_col), F.lit(0).alias("component"), *[F.lit(0).cast("bigint").alias(c) for c in ("n", "deviation")], *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    return out
