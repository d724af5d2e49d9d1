"""From raw documents to packed training sequences: each stage calls one operator, works on all its predecessor kept, and is written.

Every stage takes null texts, ids and sources, empty and very long texts, ties, repeated rows, empty tables and further columns of any name, as its operator's docstring
states; an empty table passes through all of them as an empty table. Ids must be whole numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from callweave.llm._frames import shared_checkpoint_dir, table
from callweave.llm.exact_dedup import exact_dedup
from callweave.llm.mixing import WEIGHTS, mix_sources
from callweave.llm.packing import pack
from callweave.llm.quality_rules import quality_rules
from callweave.llm.simhash import drop_near_duplicates


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like the trusted ones of ``labels``; the others go, and so do null and blank texts. Without labels every document with a word stays."""
    return quality_rules(docs, table(spark, sf_dir, "labels"), score=False)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: the smallest id, rows without an id last. Null texts are copies of one another."""
    return exact_dedup(docs, copies=False)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, with all its rows. Rows without an id or a word stay."""
    return drop_near_duplicates(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many documents as the target weights of sources allow; a null source is the source ''."""
    return mix_sources(docs, WEIGHTS)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, doc_id, piece, n_tokens, start, certified) of every document with a token."""
    return pack(docs)


STAGES = [
    ("quality_rules", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("simhash_near_dedup", stage_near_dedup),
    ("mixing", stage_mixing),
    ("best_fit_packing", stage_packing),
]

#: Near-duplicate groups, and packing by best fit, are loops that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. Each result is written as Parquet in the shared folder and read again by the next stage.

    The last result is read from the folder lazily, so it stays there; those of earlier stages are deleted.
    """
    folder = f"{shared_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, _ in STAGES[:-1]:
        files.delete(fs_path(f"{folder}/{name}"), True)
    return docs
