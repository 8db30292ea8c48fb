"""A training corpus from raw documents: language, near copies, test items, secrets, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.  All but the last return the
columns of the table `documents`; the last returns the pieces of the packed sequences.

* language: documents without a letter, or unlike every language learned, go.
* near_copies: of documents linked by a similarity of 0.8 in shingles of five words,
  the one with the smallest id stays, once; rows without id are linked, go and stay like
  others, after those with an id.
* test_items: documents that hold a benchmark item within the edit budget go.
* secrets: found spans are replaced by a mark, and n_chars follows; documents stay.
* packing: what is left is encoded and packed; one row per piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fallow.llm import decontaminate, language_id, minmax_dedup, packing, secret_scan
from fallow.session import app_dir, settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.recognised(docs, language_id.learn(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax_dedup.without_copies(docs, width=5, percent=80)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = f"{app_dir(spark)}/ledger-{uuid.uuid4().hex}"
    return secret_scan.without_secrets(docs, ledger)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("test_items", test_items), ("secrets", secrets), ("packing", pack)]
#: Language models and encoding have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
