"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe_tree, huffman, langid, linedup, merkle, mixing, quality, secret_scan, simhash_vp, toxicity
from tidelog.llm.shared import documents


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(documents(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), finish=bpe_tree.DIGESTS)


def op8_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.summary(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.grouped_documents(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(*quality.VERDICT)


QUERIES = {f.__name__: f for f in (op1_langid, op2_mixing, op3_huffman, op4_merkle, op5_toxicity, op6_secrets, op7_bpe, op8_linedup, op9_simhash, op10_quality)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES = {"op2_mixing": mixing.oracle(), "op8_linedup": linedup.oracle(), "op10_quality": quality.oracle()}
