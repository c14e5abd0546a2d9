import random
import zlib

from tidemill.llm import toxicity
from tidemill.llm.queries import op9_toxicity


def test_planted_words():
    rng = random.Random(2)
    plain = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(300)]
    text = lambda bad: " ".join([rng.choice(plain) for _ in range(80)] + [rng.choice(["wretchedness", "vileness"]) for _ in range(bad)])
    model = toxicity.fit([(text(3 * (k % 5 == 0)), int(k % 5 == 0)) for k in range(400)])
    assert all(model.score(text(2)) >= 0.7 for _ in range(20)) and all(model.score(text(0)) < 0.7 for _ in range(20))
    assert 0 <= model.score("") < 0.7


def test_no_toxic_rows_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 3.0), (None, "", 3.0), (2, "word " * 50000, 3.0), (2, "again", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels)
    assert len(toxicity.score_documents(docs, model).collect()) == 4
    assert sorted(map(str, toxicity.keep_clean(docs, model).collect())) == sorted(map(str, docs.collect()))
    assert toxicity.score_documents(docs.limit(0), model).collect() == []


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op9_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    right = sum(p and y for p, y in seen)
    # Labels of this table are noisy: some toxic rows hold no word that others share.
    assert right / sum(p for p, _ in seen) > 0.85 and right / sum(y for _, y in seen) > 0.6


def test_many_toxic_words_and_words_far_in_a_text():
    rng = random.Random(4)
    plain = ["".join(rng.choice("bcdfg") + rng.choice("aeiou") for _ in range(4)) for _ in range(300)]
    toxic = ["".join(rng.choice("hjklmnpqrstvwxz") for _ in range(10)) for _ in range(300)]
    filler = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    rows = [(filler(40), 0) for _ in range(800)] + [(filler(40) + " " + " ".join(rng.sample(toxic, 6)), 1) for _ in range(700)]
    rng.shuffle(rows)
    model = toxicity.fit(rows)
    assert sum(model.score(f"{filler(40)} {a} {b} {c}") >= 0.7 for a, b, c in zip(toxic[::3], toxic[1::3], toxic[2::3])) >= 97
    assert all(model.score(filler(40)) < 0.7 for _ in range(50))
    far = [(filler(2400) + (" wretchedness vileness" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(100)]
    assert toxicity.fit(far).score(filler(2400) + " wretchedness vileness") >= 0.7


def test_null_and_repeated_ids_in_the_query(spark, tmp_path):
    from tidemill.llm.queries import op9_toxicity

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    some = docs.limit(2).collect()
    more = spark.createDataFrame([(None, "words without an id", "en", "web", 19), tuple(some[0]), (some[0].doc_id, None, "en", "web", 0)], docs.schema)
    docs.unionByName(more).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/labels.parquet").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    rows = op9_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == docs.count() + 3 and all(isinstance(r.held_out, bool) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    same = [r.score for r in rows if r.doc_id == some[0].doc_id]
    assert len(same) == 3 and len(set(same)) <= 2


def labelled(d):
    import pyarrow.parquet as pq

    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{d}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    return texts, [(texts[r["doc_id"]], r["toxic"]) for r in pq.read_table(f"{d}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]


def test_scores_against_a_plain_version():
    """Every word of a text compressed anew with both dictionaries, nothing remembered."""
    import math

    texts, rows = labelled("/root/testdata/sf0.001")
    model = toxicity.fit(rows)
    ordinary, toxic = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    for text in texts.values():
        seen, hits = set(), set()
        for token in text.lower().split():
            word = "".join(c for c in token if c.isalpha())
            seen |= {f" {word} "} if word else set()
            seen |= {f" {word[:k]}" for k in (4, 5) if len(word) > k}
        for w in seen:
            a, b = (len(c.compress(w.encode("utf-32-le"))) for c in (toxic, ordinary))
            if a <= 17 and b - a >= 2:
                hits.add(w)
        x = math.log(7 / 3) + len(hits) - model.allowance * len(seen) - model.threshold
        assert abs(model.score(text) - 1 / (1 + math.exp(-x))) < 1e-6


def test_every_window_of_a_dictionary_is_found():
    from collections import Counter

    rng = random.Random(5)
    words = Counter({f" {''.join(rng.choice('abcdeé') for _ in range(rng.randint(3, 9)))} ": rng.randint(1, 3) for _ in range(20_000)})
    full = toxicity.compressor(toxicity.train(words, 10**7))
    assert max(len(full.compress(toxicity.encoded(w))) for w in words) <= toxicity.WHOLE
    assert toxicity.train(words, 400) == toxicity.train(Counter(dict(reversed(words.items()))), 400)  # ties do not depend on the order met


def test_ties_long_texts_and_one_label_only():
    model = toxicity.Model(b"", toxicity.encoded(" vile "), threshold=1, allowance=0.01)
    assert model.score("Vile") == model.score("vile, VILE!") and model.score("vile") < 0.7 <= toxicity.Model(b"", model.toxic).score("vile")
    assert 0 <= model.score(" ".join(f"w{'x' * (k % 97)}{'y' * (k % 89)}" for k in range(200_000))) < 0.7
    assert toxicity.fit([("only vile words here", 1)] * 20).score("") < 0.7 and toxicity.fit([("plain", 0)] * 20).score("plain") < 0.7
