"""Chat formatting, relationally: turns are collected as structs and sorted, adjacent turns of one role are merged, and messages are concatenated.

Everything is a Spark expression over one aggregation by conversation. Where a message starts is found by comparing a turn's role with the
one before; each message is a slice of the turns, so that the work grows in proportion to a conversation's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm._frames import quoted

JOINT = "\n\n"


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_messages, text), one row per conversation.

    A message reads ``<|role|>\\ntext<|end|>\\n``. Roles are trimmed and in lower case, null or blank ones are "unknown". Null texts count
    as empty. "<|" inside texts and roles is written "< |", so that no text can forge a marker. Turns are ordered by number, those without a number last; ties
    by role, then text. Repeated rows count once. Rows without a conversation id belong to none and are left out. Extra columns are not
    read. An empty table gives an empty table.
    """
    role = F.lower(F.trim(turns[quoted(role_col)]))
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    turn = F.struct(
        turns[quoted(turn_col)].isNull().alias("late"),
        turns[quoted(turn_col)].alias("turn"),
        safe(F.when(F.coalesce(role, F.lit("")) == "", F.lit("unknown")).otherwise(role)).alias("role"),
        safe(F.coalesce(turns[quoted(text_col)], F.lit(""))).alias("text"),
    )
    per = turns.where(turns[quoted(conv_col)].isNotNull()).select(turns[quoted(conv_col)].alias("conv_id"), turn.alias("t"))
    per = per.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    n = F.size("turns")

    def starts_message(i: Column) -> Column:
        return (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])

    per = per.withColumn("starts", F.filter(F.sequence(F.lit(1), n), starts_message))

    def message(first: Column, i: Column) -> Column:
        end = F.when(i + 1 < F.size("starts"), F.element_at("starts", F.least(i + 2, F.size("starts")))).otherwise(n + 1)
        body = F.array_join(F.transform(F.slice("turns", first, end - first), lambda t: t["text"]), JOINT)
        return F.concat(F.lit("<|"), F.element_at("turns", first)["role"], F.lit("|>\n"), body, F.lit("<|end|>\n"))

    text = F.array_join(F.transform("starts", message), "")
    return per.select("conv_id", n.cast("long").alias("n_turns"), F.size("starts").cast("long").alias("n_messages"), text.alias("text"))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, replace(CASE WHEN coalesce(lower(trim(role)), '') = '' THEN 'unknown' ELSE lower(trim(role)) END, '<|', '< |') AS role,
    replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS i FROM t
), m AS (
  SELECT *, CASE WHEN i > 1 AND role = lag(role) OVER (PARTITION BY conv_id ORDER BY i) THEN 0 ELSE 1 END AS starts FROM o
), g AS (
  SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY i) AS message FROM m
), p AS (
  SELECT conv_id, message, count(*) AS n, '<|' || min(role) || '|>' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY i) || '<|end|>' || chr(10) AS body
  FROM g GROUP BY conv_id, message
)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, count(*) AS n_messages, string_agg(body, '' ORDER BY message) AS text FROM p GROUP BY conv_id
"""
