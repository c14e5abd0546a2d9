import numpy as np

from tidemill.llm.embedding_dedup import near_duplicates


def brute(rows, limit=0.9):
    ok = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    link = {k: set() for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if rows[a][1] == rows[b][1] or x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= limit:
                    link[a].add(b), link[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        out.append((str(i), len(link[k]), str(min(ids) if ids else None)))
    return sorted(out)


def run(spark, rows):
    got = near_duplicates(spark.createDataFrame([(*r, 3, 1) for r in rows], "vec_id long, embedding array<float>, label int, cls int")).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.25])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 32))
    noisy = base[rng.integers(0, 60, 400)] + rng.normal(size=(400, 32)) * 0.15
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(np.concatenate([base, noisy]))]
    got, want = run(spark, rows), brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)


def table_brute(x, limit=0.9):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= limit
    component = np.arange(len(x))
    while (new := np.where(link, component, len(x)).min(1)).tolist() != component.tolist():
        component = new
    return sorted((str(k), int(link[k].sum()) - 1, str(component[k])) for k in range(len(x)))


def planted(n, dim, pairs, seed):
    """Unclustered unit vectors and near copies of some of them, each isolated, at cosines from 0.9 to 0.99."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(pairs, dim))
    y -= (y * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.choice([0.91, 0.95, 0.99], pairs)[:, None]
    return np.concatenate([x, c * x[:pairs] + np.sqrt(1 - c**2) * y]).astype(np.float32)


def test_every_isolated_pair_is_found(spark):
    for n, pairs in ((300, 50), (1500, 200), (4000, 1000)):
        x = planted(n, 64, pairs, n)
        assert run(spark, [(k, v.tolist()) for k, v in enumerate(x)]) == table_brute(x.astype(float))


def test_small_blocks_and_parts_find_the_same(spark, monkeypatch):
    from tidemill.llm import embedding_dedup

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(0, 12, 700)] + rng.normal(size=(700, 16)) * rng.choice([0.1, 0.4], (700, 1))).astype(np.float32)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40 * 16)
    monkeypatch.setattr(embedding_dedup, "PART", 150 * 16)
    assert run(spark, [(k, v.tolist()) for k, v in enumerate(x)]) == table_brute(x.astype(float))


def test_both_ends_of_a_link_count_it(spark):
    x = planted(2000, 64, 500, 2000)
    got = near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    ends = {}
    for r in got:
        ends.setdefault(r.component_id, []).append(r.n_links)
    assert all(n[0] == n[1] for n in ends.values() if len(n) == 2)
