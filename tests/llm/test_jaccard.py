import random
import re

import numpy as np
import pytest

from tidemill.llm import jaccard
from tidemill.llm.components import components
from tidemill.llm.queries import op10_jaccard_join


def brute_sets(rows, words):
    out = []
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    return out


def brute(rows, words, num, den):
    sets = brute_sets(rows, words)
    label = list(range(len(sets)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    index = {}
    for k, (_, s) in enumerate(sets):
        for other in {o for x in s for o in index.get(x, ())}:
            both = len(s & sets[other][1])
            if den * both >= num * (len(s) + len(sets[other][1]) - both):
                label[find(k)] = find(other)
        for x in s:
            index.setdefault(x, []).append(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            r = find(k)
            least[r] = min(i, least.get(r, i))
    return sorted((str(i), len(s), str(least.get(find(k)))) for k, (i, s) in enumerate(sets))


def run(spark, rows, words, num, den, **kw):
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, cls int, component_id string")
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(docs, words, num, den, **kw).collect())


def near_copies(seed, n, lengths=(2, 400)):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(*lengths))] for _ in range(max(3, n // 12))]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            at = rng.randrange(len(w))
            op = rng.random()
            if op < 0.5:
                w[at] = f"z{rng.randint(0, 99999)}"
            elif op < 0.8 and len(w) > 1:
                del w[at]
            else:
                w.insert(at, "X")
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 80, 100), (1, 80, 100)])
def test_against_brute_force(spark, words, num, den):
    rows = near_copies(words, 260)
    assert run(spark, rows, words, num, den) == brute(rows, words, num, den)


def test_blocks_of_a_hot_region(spark):
    rows = near_copies(3, 150, (300, 301))
    assert run(spark, rows, 3, 90, 100, block=20) == brute(rows, 3, 90, 100)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b"), (7, "A  B\x0b"), (8, "É b c"), (9, "é b c"), (None, "q r s t"), (None, "q r s t"), (11, "q r s t"), (11, "q r s t"), (12, "x\x1cy z k"), (13, "long " * 30000)]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_close_pair_shares_a_cell():
    rng = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100), (85, 100)):
        rings = jaccard.Rings(num, den)
        for _ in range(400):
            n = int(rng.integers(1, 700))
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, len(x)))
            keep = x[rng.permutation(len(x))[: len(x) - drop // 4]]
            y = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 5)))).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if den * both >= num * (len(x) + len(y) - both):
                assert np.intersect1d(jaccard.signatures(x, rings), jaccard.signatures(y, rings)).size


def test_components(spark):
    chain = [(k + 1, k) for k in range(30)] + [(100, 200), (200, 100), (7, 7), (300, 301), (302, 301)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 200: 100, 300: 300, 301: 300, 302: 300}


def test_keep_one(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 1), (1, "A B c d e f", 1), (3, "other words here now for you", 1), (None, "a b c d e f", 1)], "doc_id long, text string, cls int")
    assert sorted(str(r.doc_id) for r in jaccard.keep_one_per_component(docs).collect()) == ["1", "3"]
    # An id with two texts loses only the near copy; of null ids one stays where there is no other.
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (2, "clean words that nobody else has"), (None, "x y z u v w"), (None, "X y z u v w"), (None, None), (None, "")]
    got = jaccard.keep_one_per_component(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, [got[0].__class__(doc_id=1, text=rows[0][1]), got[0].__class__(doc_id=2, text=rows[2][1]), got[0].__class__(doc_id=None, text=None), got[0].__class__(doc_id=None, text="")] + [r for r in got if r.text and r.text[1:] == " y z u v w"])) and len(got) == 5


def test_large_regions_are_joined_round_by_round(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(200):  # a chain of copies that drift away from the first, so that regions have many outside
        w = list(base)
        for k in rng.sample(range(300), i // 8):
            w[k] = f"z{i}-{k}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "ROUNDS", 3)
    for block in (7, 40):
        assert run(spark, rows, 3, 90, 100, block=block) == brute(rows, 3, 90, 100)


def test_repeated_rows_cost_no_more_than_one(spark):
    docs = spark.range(40_000).selectExpr("id % 2 as doc_id", "if(id % 2 = 0, 'a b c d e f g h i j k l m n o p q r s t', 'a b c d e f g h i j k l m n o p q r s u') as text")
    got = jaccard.jaccard_components(docs, 3, 80, 100)
    assert [tuple(r) for r in got.groupBy("component_id").count().collect()] == [(0, 40_000)]


def test_op10_on_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in op10_jaccard_join(spark, "/root/testdata/sf0.01").collect())
    assert got == brute([(r.doc_id, r.text) for r in table], 3, 90, 100)


def test_near_copies_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]

    def copy(k):
        w = list(base)
        w[rng.randrange(120)] = f"z{k}"
        return " ".join(w)

    rows = [(None, copy(k)) for k in range(150)] + [(7, copy(k)) for k in range(150, 260)] + [(None, "apart " * 3), (7, "else where " * 4), (3, "q r s")]
    assert run(spark, rows, 3, 90, 100) == brute(rows, 3, 90, 100)
