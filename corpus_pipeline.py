"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, secret scan, best-fit packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.bpe import default_vocabulary
from tidemill.llm.common import cut, documents
from tidemill.llm.exact_dedup import drop_duplicates
from tidemill.llm.jaccard import keep_one_per_component
from tidemill.llm.packing import pack_documents
from tidemill.llm.secrets import mask_secrets
from tidemill.llm.toxicity import keep_clean, train_on


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; labels of rows held out from training are never read for it."""
    return keep_clean(docs, train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the smallest id stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more the smallest id stays."""
    return keep_one_per_component(docs, words=5, num=80, den=100)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their training sequence and place in it."""
    return pack_documents(docs, default_vocabulary(), capacity=2048)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("jaccard_join", near_dedup), ("secret_scan", secret_scan), ("best_fit_packing", packing)]

#: Toxicity and tokenisation are not expressible in SQL; tests/llm/test_pipeline.py checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
