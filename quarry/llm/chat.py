"""Chat formatting: turns of a conversation as one marked-up text, with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_chats(turns: DataFrame, unknown_role: str = "unknown") -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_messages, chat.

    A conversation's turns are collected as structs and sorted by (turn, role,
    text); adjacent turns of one role become one message, their texts joined by
    line ends; messages are concatenated as ``<|role|>\\ntext<|end|>\\n``.  The
    work per conversation is linear in its turns: the starts of the runs are
    found first, then every run is cut out once.

    Defined cases: a null turn sorts before all others; a null role counts as
    `unknown_role`; a null text is empty, and an empty text still makes a
    message; ``<|`` inside a text becomes ``< |``, and in a role ``|>`` becomes
    ``| >`` too, so that neither can forge a marker; a text of any length is whole; equal turns keep the order of role and text, and repeated rows are
    repeated in the message; rows with a null conv_id form one conversation; an
    empty table gives an empty result; other columns are not looked at.
    """
    t = turns.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.replace(F.replace(F.coalesce(F.col("role"), F.lit(unknown_role)), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")).alias("role"),
            F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = sorted_turns.select("conv_id", F.size("ts").alias("n"), F.col("ts.role").alias("roles"), F.col("ts.text").alias("texts"))
    starts = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == 1) | (F.get(F.col("roles"), i - 1) != F.get(F.col("roles"), i - 2)))
    runs = parts.withColumn("starts", starts)

    def message(s, k):
        end = F.coalesce(F.get(F.col("starts"), k + 1), F.col("n") + 1)
        body = F.array_join(F.slice(F.col("texts"), s, end - s), "\n")
        return F.concat(F.lit("<|"), F.get(F.col("roles"), s - 1), F.lit("|>\n"), body, F.lit("<|end|>\n"))

    return runs.select(
        "conv_id",
        F.col("n").cast("bigint").alias("n_turns"),
        F.size("starts").cast("bigint").alias("n_messages"),
        F.array_join(F.transform("starts", message), "").alias("chat"),
    )


SQL = """
WITH t AS (
  SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations
), o AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), r AS (
  SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM role THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY rn) AS run
  FROM o
), m AS (
  SELECT conv_id, run, role, count(*) AS n, string_agg(text, chr(10) ORDER BY rn) AS body
  FROM r GROUP BY conv_id, run, role
)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_turns, CAST(count(*) AS BIGINT) AS n_messages,
       string_agg('<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10), '' ORDER BY run) AS chat
FROM m GROUP BY conv_id
"""
