import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bpe
from tidemill.llm.packing import best_fit, pack, pack_documents
from tidemill.llm.queries import op1_best_fit_packing, op8_bpe
from tidemill.llm.tokenize import decode_documents, encode_documents, round_trip

VOCABULARY = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(VOCABULARY)
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b \n c", "\n\n b", "it's 'quoted' ?'s", "x\x1cy \x1f z", "é  è　ü 漢字 かな", "a\n \nb", "<|endoftext|>", " <|endoftext|> x<|endoftext|>", "👍🏽 ok\r\n\t\ttab", "  nb  sp", "don't we'll I'M"]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_encode_odd(text):
    b = bpe.load(VOCABULARY)
    assert b.encode(text).tolist() == library_ids(text)
    assert b.decode_bytes(b.encode(text)).decode("utf-8", "replace") == LIBRARY.decode(library_ids(text), skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=" \n\tab'sS.1é漢 \x85\x1c", max_size=40)))
def test_encode_any(text):
    b = bpe.load(VOCABULARY)
    ids = b.encode(text)
    assert ids.tolist() == library_ids(text)
    assert b.decode_bytes(ids).decode() == text


def test_every_cut_pair_is_in_no_token():
    b = bpe.load(VOCABULARY)
    assert b.inside[ord("t"), ord("h")] and not b.cut[ord("t"), ord("h")]
    pairs = [(x, y) for x in range(256) for y in range(256) if b.cut[x, y]]
    assert len(pairs) > 10_000 and not any(b.inside[x, y] for x, y in pairs if y != 32)
    assert b.cut[ord("t"), 32] and not b.cut[32, ord("t")] and not any(b.cut[x, ord("'")] for x in range(256))


def test_texts_are_cut_inside_words():
    b = bpe.load(VOCABULARY)
    text = "".join(chr(x) + chr(y) + " " for x in range(33, 127) for y in range(33, 127))
    inside = [k for k in b.cuts(text.encode(), text) if text[k] != " "]
    assert len(inside) > 1000 and b.encode(text).tolist() == library_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["qz", "zx", "~", "'s", "'", "'ll", "é", "漢", " ", "  ", "\n", "\xa0", "\u3000", "Q7", "7q", "!", "#", "’", "👍", "re", "ß"]), max_size=30).map("".join))
def test_encode_fragments(text):
    assert bpe.load(VOCABULARY).encode(text).tolist() == library_ids(text)


def test_documents(spark):
    rows = [(1, "a b"), (2, None), (None, "x  y"), (1, "a b"), (4, "word " * 5000)]
    docs = spark.createDataFrame([(*r, "z", [1]) for r in rows], "doc_id long, text string, n_tokens string, ids array<int>")
    encoded = encode_documents(docs, VOCABULARY)
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == sorted((str(i), library_ids(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.text) for r in decode_documents(encoded, VOCABULARY).collect()) == sorted((str(i), t or "") for i, t in rows)
    assert round_trip(docs.limit(0), VOCABULARY).collect() == []


def test_op8_on_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op8_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(table)
    for r in table:
        ids, text = library_ids(r.text or ""), r.text or ""
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def check_packing(rows, texts, capacity):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids = np.array([*library_ids(text or ""), 0], "<u4")
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in own[1:]) and len(own) == -(-len(ids) // capacity)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins)


def test_op1_on_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = op1_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    used = check_packing(rows, {r.doc_id: r.text for r in table}, 2048)
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def test_pack_small(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a b c " * 30, 5), (4, "x " * 100, 5), (5, "y", 5)], "doc_id long, text string, length int")
    rows = pack_documents(docs, VOCABULARY, capacity=16).collect()
    check_packing(rows, {1: None, 2: "", 3: "a b c " * 30, 4: "x " * 100, 5: "y"}, 16)
    assert pack_documents(docs.limit(0), VOCABULARY).collect() == []


def test_tree_merge_keeps_all(spark):
    import random

    rng = random.Random(5)
    rows = [(k % 900, k, 0, rng.randint(1, 100), 7) for k in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(pieces, capacity=100, group_rows=100, fan_in=4, slack=0).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in out) == sorted((r[0], r[1], r[3]) for r in rows)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 100
    assert len(bins) <= 1.03 * sum(r[3] for r in rows) / 100


def test_large_items_only(spark):
    pieces = spark.createDataFrame([(k, 0, 0, 60, 1) for k in range(500)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = pack(pieces, capacity=100, group_rows=10, fan_in=4).collect()
    assert len({r.sequence_id for r in out}) == 500


def test_best_fit_is_tightest():
    bins, offsets = best_fit(np.array([5, 6, 4, 5]), 10)
    assert bins.tolist() == [1, 0, 0, 1] and offsets.tolist() == [0, 0, 6, 5]
