"""The corpus pipeline: language, quality, near duplicates, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import decontaminate, langid, packing, quality, simhash
from corpuscle.llm.common import keep, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not among ``ids``; null ids stay. Keys are single documents: nothing to skew."""
    return docs.join(ids.distinct(), "doc_id", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages that ``lang`` names: their n-grams are mostly unknown to all filters.

    Null texts and texts without letters go too. Without a single labelled row, every text with a letter stays.
    """
    return langid.recognised(docs, langid.fit(docs.where("text is not null and lang is not null")), least=0.4)


def clean_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose posterior quality is low or whose posterior toxicity is high."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return _without(docs, keep(scored.where("not keep").select("doc_id"), "rejected"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near duplicates: five-word shingles, similarity 0.8."""
    classes = simhash.similar_documents(docs, least=0.8, words=5)
    return _without(docs, keep(classes.where(F.col("doc_id") != F.col("component_id")).select("doc_id"), "copies"))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Filters in place."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents left, in sequences of at most 2048."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("quality", clean_enough),
    ("near_duplicates", one_of_each),
    ("decontamination", unleaked),
    ("packing", packed),
]

#: The stages' models and searches are not SQL; a brute-force version in the tests stands against the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order, each to the stored result of the one before.

    Rows that repeat a doc_id are one document and stay or go together; rows with a null doc_id stay. Columns
    beyond those of ``documents`` pass through to the last stage. An empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, name)
    return docs
