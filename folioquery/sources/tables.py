"""The provided tables, and inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_markdown(conversations: DataFrame) -> DataFrame:
    """(doc_id, text): each conversation as Markdown, its turns in order.

    A turn is a heading of its role and its text; a system turn repeats the text
    in a fence; every third turn adds a pipe table, every fifth a list. Some conversations end with a
    newline, some with a fence that is never closed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    fence = F.when(F.col("role") == "system", F.concat(F.lit("\n\n```\n"), text, F.lit("\n```"))).otherwise("")
    size = F.length(text).cast("string")
    grid = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("\n\n| length |\n| --- |\n| "), size, F.lit(" |"))).otherwise("")
    items = F.when(F.col("turn") % 5 == 2, F.concat(F.lit("\n\n- first\n- second\n  goes on\n1. "), size)).otherwise("")
    turn = F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit("\n\n"), text, fence, grid, items)
    grouped = conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("md")))).alias("turns"))
    tail = F.when(F.col("doc_id") % 7 == 0, F.lit("\n~~~\n# open")).when(F.col("doc_id") % 5 == 0, F.lit("\n")).otherwise("")
    return grouped.select("doc_id", F.concat(F.array_join(F.transform("turns", lambda t: t["md"]), "\n\n"), tail).alias("text"))


CONVERSATION_MARKDOWN_SQL = """
md_turns AS (
  SELECT conv_id, turn, '## ' || coalesce(role, '') || chr(10) || chr(10) || coalesce(text, '')
    || CASE WHEN role = 'system' THEN chr(10) || chr(10) || '```' || chr(10) || coalesce(text, '') || chr(10) || '```' ELSE '' END
    || CASE WHEN turn % 3 = 1 THEN chr(10) || chr(10) || '| length |' || chr(10) || '| --- |' || chr(10) || '| ' || length(coalesce(text, '')) || ' |' ELSE '' END
    || CASE WHEN turn % 5 = 2 THEN chr(10) || chr(10) || '- first' || chr(10) || '- second' || chr(10) || '  goes on' || chr(10) || '1. ' || length(coalesce(text, '')) ELSE '' END AS md
  FROM conversations
),
md_docs AS (
  SELECT conv_id AS doc_id, string_agg(md, chr(10) || chr(10) ORDER BY turn, md)
    || CASE WHEN conv_id % 7 = 0 THEN chr(10) || '~~~' || chr(10) || '# open' WHEN conv_id % 5 = 0 THEN chr(10) ELSE '' END AS text
  FROM md_turns GROUP BY conv_id
)
"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_markdown(read(spark, sf_dir, "conversations"))
