"""Queries over nested blocks: parts as a tree, events as inline segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import tree as T
from folioquery.sources.tables import read

KINDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4"]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in trees of about forty: each below a third of its number within its document."""
    local = F.col("p_partkey") % 40
    return read(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 40).alias("doc_id"), local.alias("id"), F.when(local >= 3, F.floor(local / 3)).alias("parent"), F.col("p_size").alias("ordinal"),
        F.substring("p_brand", 1, 7).alias("kind"), F.when(F.col("p_size") % 7 == 0, F.lit(" ")).otherwise(F.col("p_partkey").cast("string")).alias("text"),
    )


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.with_paths(_nodes(spark, sf_dir)).select("doc_id", "id", "path", "depth")


def tree_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = T.flattened(T.with_paths(_nodes(spark, sf_dir)))
    return flat.select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


def tree_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.guard(_nodes(spark, sf_dir), KINDS, 3)


def inline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "image").otherwise("text")
    segments = events.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ordinal"), kind.alias("kind"), F.col("event_type").alias("text"))
    return T.inline_runs(segments)


QUERIES = {f.__name__: f for f in (tree_paths, tree_texts, tree_guard, inline_runs)}

_NODES = """WITH RECURSIVE n AS (SELECT p_partkey // 40 AS doc_id, p_partkey % 40 AS id, CASE WHEN p_partkey % 40 >= 3 THEN (p_partkey % 40) // 3 END AS parent, p_size AS ordinal,
    substr(p_brand, 1, 7) AS kind, CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_partkey::VARCHAR END AS text FROM part),
  w AS (SELECT *, lpad(ordinal::VARCHAR, 19, '0') AS path, 1 AS depth FROM n WHERE parent IS NULL
    UNION ALL SELECT n.*, w.path || '/' || lpad(n.ordinal::VARCHAR, 19, '0'), w.depth + 1 FROM w JOIN n ON n.doc_id = w.doc_id AND n.parent = w.id)
"""
_KINDS = ", ".join(f"'{k}'" for k in KINDS)

ORACLE_SQL = {
    "tree_paths": _NODES + "SELECT doc_id, id, path, depth FROM w",
    "tree_texts": _NODES + "SELECT doc_id, sum(length(text)) + count(*) - 1 AS chars, sha256(string_agg(text, chr(10) ORDER BY path, text)) AS sha256 FROM w WHERE trim(text) <> '' GROUP BY doc_id",
    "tree_guard": _NODES
    + f"""SELECT doc_id, problem, count(*) AS rows FROM (SELECT doc_id, 'kind' AS problem FROM n WHERE kind NOT IN ({_KINDS})
        UNION ALL SELECT doc_id, 'unreached' FROM n WHERE (doc_id, id) NOT IN (SELECT (doc_id, id) FROM w WHERE depth <= 3)) GROUP BY 1, 2""",
    "inline_runs": """WITH s AS (SELECT user_id AS doc_id, event_id AS ordinal, CASE WHEN event_id % 4 = 0 THEN 'image' ELSE 'text' END AS kind, event_type AS text FROM events),
      f AS (SELECT *, (kind = 'image' OR coalesce(lag(kind) OVER w, 'image') = 'image')::INT AS fresh FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
      r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ordinal) AS run FROM f)
      SELECT doc_id, run, min(kind) AS kind, string_agg(text, '' ORDER BY ordinal) AS text FROM r GROUP BY 1, 2""",
}
