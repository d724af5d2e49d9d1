"""Exact dedup: skew-safe combining of equal texts, with full content compared at every stage.

1. Locally: rows of one input partition carry the same salt, so the partial aggregation before the first exchange already merges equal
   texts within the partition (map-side combine).
2. Salted: groups of (digest, salt, text) are merged across partitions. A text of a million copies is spread over ``salts`` reducers.
3. Globally: the winners of the salts, at most ``salts`` rows per text, are combined by (digest, text).

The digest only spreads rows; texts themselves are grouping keys, so two texts are merged only when they are equal.
The text crosses the network twice, in the worst case; a copy that loses locally never does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm._frames import ROW, packed, quoted, tie_break, unpacked

SALTS = 16


def exact_dedup(docs: DataFrame, salts: int = SALTS, text_col: str = "text", id_col: str = "doc_id", copies: bool = True) -> DataFrame:
    """One row per distinct text: the one with the smallest id, with every input column and ``n_copies``, the rows that had the text.

    Texts are equal when all characters are; case and blanks count. Null texts count as equal to each other and not to the empty text.
    Rows with an id come before rows without; remaining ties fall to the smaller JSON of the other columns, so repeated rows leave one.
    If the input has a column n_copies, the added one gets an underscore appended. An empty table gives an empty table.
    """
    others = [docs[quoted(c)].alias(c) for c in docs.columns if c != text_col]
    work = docs.select(
        F.xxhash64(docs[quoted(text_col)]).alias("_digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"),
        docs[quoted(text_col)].alias("_text"),
        F.struct(*others).alias(ROW),
        tie_break(docs, id_col, skip=(text_col,)).alias("_rank"),
    )
    first = F.min_by(ROW, "_rank").alias(ROW)
    salted = work.groupBy("_digest", "_salt", "_text").agg(first, F.min("_rank").alias("_rank"), F.count("*").alias("_n"))
    final = salted.groupBy("_digest", "_text").agg(first, F.sum("_n").alias("_n"))
    whole = final.select(
        F.struct(*[(F.col("_text") if c == text_col else F.col(f"{ROW}.{quoted(c)}")).alias(c) for c in docs.columns]).alias(ROW), "_n"
    )
    return unpacked(whole, {"n_copies": "_n"} if copies else None)


ORACLE = """
SELECT doc_id, text, lang, source, n_chars, n_copies FROM (
  SELECT *, count(*) OVER (PARTITION BY text) AS n_copies, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS place FROM documents
) WHERE place = 1
"""
