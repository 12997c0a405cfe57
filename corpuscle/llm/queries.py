"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import ann, decontaminate, html, langid, licenses, negatives, packing, pii, quality, simhash, sql, tokenfile, trie, warc
from corpuscle.llm.common import crc32_mod, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048, end_id=0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(table(spark, sf_dir, "pages"), least_revisit=0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20, factor=1.0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(table(spark, sf_dir, "documents"), end_id=1)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=5, least=0.8)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), crc32_mod("doc_id", 3) == 1)


def op10_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_warc, op3_quality, op4_nearest_neighbours, op5_license_scan, op6_token_files, op7_decontamination, op8_html_extraction, op9_language_id, op10_simhash_neardup, op11_conversation_trie, op12_pii, op13_hard_negatives)}
#: The others are held against brute-force versions and round trips in the tests.
SQL: dict[str, str] = {"op2_warc": sql.OP2, "op4_nearest_neighbours": sql.OP4, "op5_license_scan": sql.OP5, "op7_decontamination": sql.OP7, "op11_conversation_trie": sql.OP11, "op13_hard_negatives": sql.OP13}
