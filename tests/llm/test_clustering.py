import hashlib

import numpy as np

from tidemill.llm.clustering import cluster_vectors, nearer
from tidemill.llm.queries import op11_centroid_clustering


def brute(rows, k=8, rounds=10, dim=64, seed=3):
    kept = [(i, [int(np.floor(1024 * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    x = np.array([v for _, v in kept], dtype=np.int64)
    order = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"{seed}:{'' if kept[r][0] is None else kept[r][0]}".encode()).hexdigest(), np.array(kept[r][1], "<i4").tobytes().hex()))
    centres = x[order[:k]].copy()
    for turn in range(rounds + 1):
        far = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
        at = far.argmin(1)
        if turn < rounds:
            for c in range(len(centres)):
                if (at == c).any():
                    centres[c] = x[at == c].sum(0) // (at == c).sum()
    d = far[np.arange(len(x)), at]
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    return sorted((str(i), int(a), int(e), int(d[at == a].sum()), int(d.sum()), digest[a]) for (i, _), a, e in zip(kept, at, d))


def run(spark, rows, **more):
    vectors = spark.createDataFrame([(*r, 3, 1) for r in rows], "vec_id long, embedding array<float>, cluster int, row long")
    return sorted((str(r.vec_id), *r[1:]) for r in cluster_vectors(vectors, **more).collect())


def blobs(n, dim, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(6, dim))
    return (c[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * spread).astype(np.float32)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [-inf, 1.0]), (7, [0.0, 0.0]), (8, [-0.3, 0.7]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.25]), (None, [5.0, 5.0]), (12, [100.5, -77.25])]
    for k in (1, 3, 8, 20):
        assert run(spark, rows, dim=2, k=k, rounds=4) == brute(rows, dim=2, k=k, rounds=4)
    assert run(spark, rows[:2]) == [] and run(spark, []) == []
    same = [(k, [1.0, 1.0]) for k in range(12)]  # every distance ties; all but the first centroid lose their vectors
    assert run(spark, same, dim=2, rounds=3) == brute(same, dim=2, rounds=3)
    assert run(spark, [(1, [1.0, 0.0]), (2, [2.0**18, 0.0])], dim=2) == brute([(1, [1.0, 0.0])], dim=2)


def test_bounds_spare_scans_and_change_nothing(spark):
    log = []
    rows = [(k, v.tolist()) for k, v in enumerate(blobs(1500, 64, 5))]
    assert run(spark, rows, log=log) == brute(rows)
    assert len(log) == 11 and log[0]["scanned"] == 1500 and log[-1]["scanned"] < 1500
    large = [(k, (1000 * v).tolist()) for k, v in enumerate(blobs(300, 64, 6))]
    assert run(spark, large, rounds=3) == brute(large, rounds=3)


def test_what_a_sphere_comes_nearer():
    rng = np.random.default_rng(1)
    below = 0
    for _ in range(300):
        dim = int(rng.integers(2, 6))
        old, middle = rng.normal(size=dim) * 4, rng.normal(size=dim) * 4
        new = old + rng.normal(size=dim) * rng.choice([0.01, 0.5, 3])
        radius = float(rng.choice([0.0, 0.3, 2.0]))
        y = rng.normal(size=(400, dim))
        x = middle + radius * y / np.linalg.norm(y, axis=1, keepdims=True) * rng.random((400, 1)) ** 0.1
        seen = (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max()
        bound = nearer(old, new, middle, radius)
        assert seen <= bound + 1e-9 and bound <= np.linalg.norm(new - old)
        below += bound < 0.9 * np.linalg.norm(new - old)
    assert below > 100


def test_op11_on_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert sorted((str(r.vec_id), *r[1:]) for r in op11_centroid_clustering(spark, d).collect()) == brute(rows)
