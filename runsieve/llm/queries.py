"""Registered queries of the operators and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.llm import dualtree, hmm, merging, merkle, packing, perspectives, quality, signatures, simhash, topk, toxicity, unigram, winnow
from runsieve.llm.common import table


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return merkle.report(pages, merkle.damaged_replica(pages))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


def op7_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signatures.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.count_tokens(table(spark, sf_dir, "documents"))


def op13_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.compress(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_merkle_audit": op1_merkle_audit,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_unigram": op4_unigram,
    "op5_quality": op5_quality,
    "op6_perspective_rotation": op6_perspective_rotation,
    "op7_threshold_topk": op7_threshold_topk,
    "op8_hidden_markov": op8_hidden_markov,
    "op9_winnowing": op9_winnowing,
    "op10_toxicity": op10_toxicity,
    "op11_bloom_search": op11_bloom_search,
    "op12_token_counts": op12_token_counts,
    "op13_dual_tree_lloyd": op13_dual_tree_lloyd,
}

ORACLES: dict[str, str] = {
    "op1_merkle_audit": merkle.ORACLE_SQL,
    "op6_perspective_rotation": perspectives.ORACLE_SQL,
    "op7_threshold_topk": topk.ORACLE_SQL,
    "op11_bloom_search": signatures.ORACLE_SQL,
    "op13_dual_tree_lloyd": dualtree.ORACLE_SQL,
}
