"""BPE encoding and decoding of whole documents (see ``bpe`` for the method)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids array<int>``: the ids of each whole text; null and empty texts have no ids.
    Rows stay rows: repeated ones give repeated results, other columns are not read."""

    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            ids = [bpe.encode(t or "").astype("i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text``: special tokens are written out; bytes that are no UTF-8 become U+FFFD; null ids are empty."""

    def run(batches):
        bpe = load(vocabulary)
        for b in batches:
            texts = [bpe.decode_bytes(i or []).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each whole text in one pass: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.
    Null and empty texts have no tokens; repeated rows give a row each, an empty table none; ids of any kind, nulls too, are
    handed through; other columns are not read."""

    def run(batches):
        bpe = load(vocabulary)
        decimal = [str(i) for i in range(len(bpe.token_len))].__getitem__
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(decimal, ids.tolist())).encode()).hexdigest())
                decoded = bpe.decode_bytes(ids).decode("utf-8", "replace")
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
