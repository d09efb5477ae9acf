"""Queries of the training-data operators and their SQL. Each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, forest, html, license, mixing, sharding, tokens, toxicity, vptree, warc
from .common import load


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"), 8)


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(load(spark, sf_dir, "documents"))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(load(spark, sf_dir, "documents"), k=3, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(load(spark, sf_dir, "pages"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.tokenize_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(load(spark, sf_dir, "documents"), weights=(5, 2, 1), max_epochs=3.0)


_ALL = (op1_decontamination, op2_sharding, op3_licences, op4_nearest, op5_extraction, op6_near_duplicates, op7_toxicity, op8_warc, op9_tokens, op10_mixing)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

#: What DuckDB can express: nearest neighbours only where the search is exact, which its relaxed bound is not.
ORACLES: dict[str, str] = {"op8_warc": warc.SQL, "op10_mixing": mixing.SQL}
