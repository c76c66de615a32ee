"""A corpus pipeline of five stages over `documents`.

Each stage takes what its predecessor kept, written as Parquet and read again. All stages but
the last return the columns of `documents`:

1. quality: the base rules and cross-document line frequency; rejected documents go, and
   frequent lines leave the others;
2. line_dedup: runs of lines of 50 words or more that an earlier place holds are deleted,
   documents of which nothing is left go;
3. near_dedup: SimHash over five-word shingles; one document of each group stays;
4. mixing: documents replicated so that a source weighs as the square root of its size;
5. bpe: token ids of every text, with digests of the ids and of the decoded text.

The stages' own defined cases hold. After `mixing` an id may stand in several rows, which
have equal texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe_tree, linedup, mixing, simhash_vp
from tidelog.llm import quality as rules
from tidelog.llm.shared import documents, written

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_vp.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_tree.encode(docs, public_tokenizers.path(TOKENIZER), finish=bpe_tree.DIGESTS)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("bpe", bpe)]

#: SimHash, language models of merges and SHA-256 of packed ids are beyond SQL: the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
