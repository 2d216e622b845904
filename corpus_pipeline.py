"""The corpus pipeline: documents pass five stages, each written and read again before the next.

toxicity drops documents that the classifier rejects; near_duplicates keeps one document of each linked group; secrets
redacts spans, keeping every document; mix takes each document as often as the mix does (rows repeat; a document the mix
leaves out goes); encode gives the digests of what is left. All but the last return the columns of documents.

ORACLE_SQL is None: the stages learn a classifier and run a tokenizer, which SQL cannot express.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookdq.llm import bpe, factorization, mixing, neardup, secrets
from bookdq.llm.common import Shelf, drop_unread, noted
from bookdq.llm.queries import TEXT_BPE, table


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def tidied(stage: Stage) -> Stage:
    """A stage starts when the output of the one before is stored, so what that one left in the shared folder goes first, but for
    tables that docs still reads (a caller may pass a frame that is not stored)."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_unread(spark, _left, docs)
        with noted(_left):
            return stage(spark, docs, sf_dir)

    return run


@tidied
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity below 0.7; the model is learned from the labels of `sf_dir` and their documents in docs."""
    model = factorization.learn(docs, table(spark, sf_dir, "labels"))
    return factorization.kept(docs, model)


@tidied
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, a Jaccard of 0.8), the one with the least id."""
    return neardup.kept(docs, width=5, percent=80)


@tidied
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets replaced by their kind; n_chars is that of the new text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@tidied
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed(docs)


@tidied
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of docs: its length in tokens, and digests of its ids and of the decoded bytes."""
    name, pattern = TEXT_BPE
    return bpe.digests(docs, public_tokenizers.path(name), pattern)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", redact), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shelf = Shelf(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = shelf.save(stage(spark, docs, sf_dir), f"{number}-{name}")
    return docs
