from fractions import Fraction

import numpy as np

from tidemill.llm.queries import op13_whitening
from tidemill.llm.whitening import components, polar, whiten


def brute(rows, most=8):
    """Per row: id, n, exact deviation, whitened entries (up to sign), explained."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n = len(x)
    s = x.sum(0)
    d = n * x - s
    exact = d.T @ d
    v = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in exact])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    white = (d / n).astype(float) @ q / np.sqrt(e)
    return n, [int(t) for t in (d**2).sum(1)], white, e / np.trace(v)


def check(got, rows, most=8, tolerance=1e-6):
    n, deviation, white, explained = brute(rows, most)
    table = {}
    for r in got:
        table.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == len(rows) * min(most, len(rows[0][1]))
    out = np.array([[table[i][c + 1].whitened for c in range(white.shape[1])] for i, _ in rows])
    signs = np.sign((out * white).sum(0))
    assert np.abs(out - white * signs).max() < tolerance
    for (i, _), dev in zip(rows, deviation):
        assert all(r.n == n and r.deviation == (dev if dev < 2**63 else None) and abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-8 for c, r in table[i].items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, n int, component int, w double")


def test_polar_and_components():
    rng = np.random.default_rng(0)
    for m in (1, 2, 5, 64):
        for kind in range(4):
            a = rng.normal(size=(m, m))
            a = [a + a.T, a @ a.T, np.diag(np.repeat([3.0, 1.0], [m // 2, m - m // 2])), a[:, :1] @ a[:, :1].T][kind]
            e, q = components(a)
            scale = max(1e-300, np.linalg.norm(a))
            assert np.abs(q.T @ q - np.eye(m)).max() < 1e-13
            assert np.abs(a @ q - q * e).max() < 2e-13 * scale * m
            assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * scale * m
    u = polar(np.diag([5.0, 1e-9, -2.0]))
    assert np.abs(u - np.diag([1.0, 1.0, -1.0])).max() < 1e-13


def test_against_exact_covariance(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 12)) @ np.diag(np.linspace(0.05, 2, 12)) + rng.normal(size=12) * 3).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    check(whiten(frame(spark, rows)).collect(), rows)
    large = [(k, [float(np.float32(c * 3_000)) for c in v]) for k, v in rows[:60]]
    check(whiten(frame(spark, large), most=3).collect(), large, most=3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (2, [2.0, -1.0]), (3, [0.5, 0.25]), (4, [-3.0, 1.0])]
    bad = [(5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [1.0, -inf]), (10, [2.0**17, 1.0])]
    check(whiten(frame(spark, good + bad)).collect(), good)
    got = whiten(frame(spark, [*good, (None, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(got) == 14 and sum(r.vec_id is None for r in got) == 2 and sum(r.vec_id == 1 for r in got) == 6 and {r.n for r in got} == {7}
    assert whiten(frame(spark, bad)).collect() == [] and whiten(frame(spark, [])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whiten(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    line = whiten(frame(spark, [(k, [float(k), 2.0 * k]) for k in range(5)])).collect()  # one component has no variance
    assert all(r.whitened == 0.0 for r in line if r.component == 2) and all(r.identity_error < 1e-9 for r in line)
    mixed = whiten(frame(spark, [*good, (20, [1.0]), (21, [3.0])])).collect()
    assert {(r.vec_id > 10, r.n) for r in mixed} == {(False, 4), (True, 2)}


def test_op13_on_table(spark):
    d = "/root/testdata/sf0.01"
    check(op13_whitening(spark, d).collect(), [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()])
