"""Python source texts made from the part table, to run the parser over a whole table with a result that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def part_sources(part: DataFrame) -> DataFrame:
    """(file, text): for each brand a module with one three-line function per part, in order of the key, that calls the next part's function."""
    k, nxt = F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")
    body = F.concat(F.lit("def part_"), k, F.lit("():\n    value = part_"), nxt, F.lit("()\n    return value"))
    rows = part.groupBy(F.col("p_brand").alias("file")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", body.alias("body")))).alias("parts"))
    return rows.select("file", F.array_join(F.transform("parts", lambda p: p["body"]), "\n").alias("text"))


#: The same modules' functions, in DuckDB: the i-th part of a brand, from 0, is at line 3i + 1.
SQL = """
placed AS (SELECT p_partkey, p_brand, 3 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) + 1 AS line FROM part)
"""


