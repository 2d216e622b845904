"""The queries of the numbered operators, each over its whole table, and SQL where it can say the same."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from bookdq.llm import balltree, bpe, curves, divergence, factorization, mixing, neardup, prefixtrie, quality, secrets, sharding, tokenfiles, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TEXT_BPE = ("byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)
FILE_BPE, END_ID = "byte_bpe_50k.json", 2


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents")).drop("failed")


ORACLES["op1_quality_rules"] = quality.ORACLE


@query
def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages")).drop("url", "payload")


ORACLES["op2_warc_dictionary"] = warc.ORACLE


@query
def op3_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents")).drop("grp")


@query
def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row", "copies")


ORACLES["op4_fair_mix"] = mixing.ORACLE


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = factorization.score(docs, factorization.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(factorization.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= factorization.TOXIC).cast("int").alias("predicted"))


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenfiles.write_and_read(docs, public_tokenizers.path(FILE_BPE), END_ID, with_ids=False)


@query
def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.search(table(spark, sf_dir, "embeddings"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, pattern = TEXT_BPE
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(name), pattern)


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = divergence.ORACLE


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


ORACLES["op12_prefix_trie"] = prefixtrie.ORACLE


@query
def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.search(table(spark, sf_dir, "embeddings"))


ORACLES["op13_exact_top_k"] = balltree.ORACLE
