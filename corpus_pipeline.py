"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes what its predecessor wrote. The filters keep all columns of
``documents``; the last stage returns the pieces of packed sequences.

Defined cases are those of the operators: null and empty texts are scored like any
other and share a fingerprint, so at most one of them stays; of a repeated row one
stays; without labels toxicity rejects everything, as every score is 0.5; empty
tables give no pieces; texts are read whole, however long; other columns are
carried along and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runsieve.llm import packing, quality, simhash, toxicity
from runsieve.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: Trained models and tokens are beyond SQL; tests compare with plain decisions on
#: planted documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
