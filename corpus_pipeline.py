"""A training-corpus pipeline of four stages: quality classifier, language ID, near-dedup (SimHash and exact five-word similarity), best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hypotree.llm import langid, nearcopies, packing, quality
from hypotree.llm.common import new_path, table

#: Rows below these are rejected: the quality score, and the share of a text's n-grams that its language has (clean texts: above 0.5, however many languages are learned).
LEAST_QUALITY = 0.5
LEAST_LANGUAGE = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs whose text scores at least LEAST_QUALITY, by a model of the labelled rows among them.

    Null and empty texts are scored as texts without words. Repeated rows score alike and stay or go together; without labels on both sides
    every row scores the same. An empty table gives an empty one; further columns are kept.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, least=LEAST_QUALITY)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of docs in one of the languages learned from docs itself, with a hit rate of at least LEAST_LANGUAGE.

    Texts that are null or have no letter go; of languages that fit equally the first by name counts. Repeated rows stay or go together; an
    empty table, or one without languages, gives an empty one; further columns are kept.
    """
    return langid.keep_known(docs, langid.fit(docs), least=LEAST_LANGUAGE)


def first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the smallest doc_id: five-word similarity of 0.8 or more, or fingerprints within two bits.

    Null and empty texts are copies of one another; rows with a null doc_id stay; rows that repeat an id stay or go together. An empty table
    gives an empty one; further columns are kept.
    """
    return nearcopies.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place there: at most 1024 tokens a sequence, the end token included.

    Null and empty texts are the end token alone; repeated rows are packed each; an empty table gives an empty one.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("simhash_near_dedup", first_of_near_duplicates),
    ("best_fit_packing", packed),
]

#: Hashing of shingles, trained models and tokenization can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = new_path(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
