"""A training-data pipeline over the documents table: five stages, each written as Parquet and read again by the next.

    language ID          documents whose language can't be told are dropped; a missing lang is filled in
    near duplicates      one document of each group of linked documents stays
    decontamination      documents that hold a benchmark item are dropped
    PII                  personal data are replaced by format-preserving pseudonyms
    byte-level BPE       the last stage: token counts and digests of ids and decoded bytes

Each stage works on all rows of its input and passes the columns of documents on (the last returns its own).  Null and empty texts have no letter,
so the first stage drops them; empty tables give empty results; extra columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import bpe, decontaminate, jaccard, language_id, pii
from rillwork.llm.common import stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs, language_id.fit(docs.where(~language_id.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.transform(docs, pii.session_key(spark), counts=False)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", pseudonymise),
    ("byte-level BPE", tokenize),
]

#: SQL can't express the learned and hashed stages; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
