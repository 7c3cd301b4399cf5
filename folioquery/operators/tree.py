"""Nested blocks as (doc_id, id, parent, ordinal, kind, text) rows: flattening, depth and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DEPTH = 64


def with_paths(nodes: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Adds ``path`` (ordinals from the root, as sort keys) and ``depth``; rows that no root reaches are left out.

    A recursive query walks one level at a time, each a join on (doc_id, parent),
    down to ``most_depth`` levels.
    """
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the default stops at a million rows
    return spark.sql(
        f"""
        WITH RECURSIVE walk(doc_id, id, parent, ordinal, kind, text, path, depth) AS (
          SELECT doc_id, id, parent, ordinal, kind, text, lpad(cast(ordinal AS string), 19, '0'), 1 FROM {{nodes}} WHERE parent IS NULL
          UNION ALL
          SELECT n.doc_id, n.id, n.parent, n.ordinal, n.kind, n.text, concat(w.path, '/', lpad(cast(n.ordinal AS string), 19, '0')), w.depth + 1
          FROM walk w JOIN {{nodes}} n ON n.doc_id = w.doc_id AND n.parent = w.id WHERE w.depth < {most_depth}
        )
        SELECT * FROM walk
        """,
        nodes=nodes,
    )


def flattened(paths: DataFrame) -> DataFrame:
    """Visible text of each document depth first: the texts of its rows in the order of their paths, empty ones left out."""
    shown = paths.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    grouped = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", "text"))).alias("t"))
    return grouped.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def guard(nodes: DataFrame, kinds: list[str], most_depth: int = MOST_DEPTH) -> DataFrame:
    """(doc_id, problem, rows): unknown kinds, repeated ids, rows that no root reaches (cycles, dangling parents or too deep)."""
    unknown = nodes.where(~F.coalesce(F.col("kind").isin(kinds), F.lit(False))).select("doc_id", F.lit("kind").alias("problem"))
    repeated = nodes.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit("repeated_id").alias("problem"))
    unreached = nodes.select("doc_id", "id").distinct().join(with_paths(nodes, most_depth).select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    every = unknown.unionByName(repeated).unionByName(unreached.select("doc_id", F.lit("unreached").alias("problem")))
    return every.groupBy("doc_id", "problem").agg(F.count(F.lit(1)).alias("rows"))


def contains_kind(paths: DataFrame, kind: str) -> DataFrame:
    """Whether each document has a row of a kind anywhere."""
    return paths.groupBy("doc_id").agg(F.bool_or(F.col("kind") == kind).alias("contains"))


def list_label(start: Column, place: Column, ordered: Column) -> Column:
    """Label of a list item: a number from the list's start (at least 1), or a dash."""
    return F.when(ordered, F.concat((F.greatest(start, F.lit(1)) + place).cast("string"), F.lit("."))).otherwise("-")


def inline_runs(segments: DataFrame) -> DataFrame:
    """(doc_id, run, kind, text) of ordered segments (doc_id, ordinal, kind, text): texts next to each other are joined, images stay alone."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("ordinal")
    fresh = (F.col("kind") == "image") | F.lag("kind").over(order).isNull() | (F.lag("kind").over(order) == "image")
    numbered = segments.withColumn("_new", fresh.cast("int")).withColumn("run", F.sum("_new").over(order))
    grouped = numbered.groupBy("doc_id", "run").agg(F.min_by("kind", "ordinal").alias("kind"), F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("t"))
    return grouped.select("doc_id", "run", "kind", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))
