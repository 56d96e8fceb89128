"""Training-data pipeline over ``documents``: each stage is written as Parquet
and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from touchline.llm.common import read_table
from touchline.session import scratch_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language.  Rejected are ``und`` (null, or no
    letter) and texts that a uniform choice of trigrams explains better than
    any mixture of the learned languages."""
    from touchline.llm.common import fresh_name
    from touchline.llm.language_id import UNKNOWN, identifier, learn
    found = fresh_name(docs, "_language")
    named = docs.withColumn(found, identifier(docs, learn(docs))(docs["text"]))
    return named.filter((named[found]["lang"] != UNKNOWN) & (named[found]["fit"] > 0)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    from touchline.llm.near_dup import keep_one
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed 5, 2, 1 (repeating) to their targets; rows repeated as often as taken."""
    from touchline.llm.mixing import mix_documents
    return mix_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix encoded and decoded."""
    import public_tokenizers
    from touchline.llm.byte_bpe import digests, round_trip
    return digests(round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: Language likelihoods, signatures and merges are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch_dir(spark, f"pipeline/{uuid.uuid4().hex}")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}_{name}")
        docs = spark.read.parquet(f"{folder}/{n}_{name}")
    return docs
