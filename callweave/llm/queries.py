"""Registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import chat_format, exact_dedup, html_extract, licenses, mixing, packing, quality_rules, secret_scan, simhash, suffix_dedup
from callweave.llm._frames import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path: source/lang stands for the directory, the id for the file."""
    docs = table(spark, sf_dir, "documents")
    return licenses.license_scan(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, sf_dir, "documents"), mixing.WEIGHTS)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secret_scan(docs, secret_scan.text_digests(docs))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_format(table(spark, sf_dir, "conversations"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_license_scan,
        op3_best_fit_packing,
        op4_mixing,
        op5_secret_scan,
        op6_suffix_dedup,
        op7_chat_format,
        op8_html_extract,
        op9_simhash_near_dedup,
        op10_quality_rules,
    )
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op4_mixing": mixing.ORACLE,
    "op7_chat_format": chat_format.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
