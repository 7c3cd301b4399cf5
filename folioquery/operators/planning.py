"""Plans of review runs: cells of chunks and dimensions, claim cells, manifests and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.validation import FOCUS_CHECKS, dimensions


def local_cells(chunk_table: DataFrame, focus: str = "all", id_col: str = "doc_id") -> DataFrame:
    """One pending cell for each chunk (id, chunk, start, end, sha256) and dimension of the focus."""
    names = dimensions(F.array(*[F.lit(c) for c in FOCUS_CHECKS[focus]]))
    each = chunk_table.withColumn("dimension", F.explode(names))
    return each.select(
        id_col,
        F.format_string("local-%d-%04d-%s", F.col(id_col), F.col("chunk"), F.col("dimension")).alias("cell_id"),
        F.lit("local").alias("stage"),
        "dimension",
        F.col("start").alias("first"),
        F.col("end").alias("last"),
        F.sha2(F.concat_ws("|", "sha256", "dimension"), 256).alias("input_hash"),
        F.lit("pending").alias("status"),
    )


def claim_cells(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One pending cell for each part (id, part, first, last) of a document that claims are taken from."""
    return parts.select(
        id_col,
        F.format_string("claims-%d-%04d", F.col(id_col), F.col("part")).alias("cell_id"),
        F.lit("claims").alias("stage"),
        F.lit(None).cast("string").alias("dimension"),
        "first",
        "last",
        F.sha2(F.concat_ws("|", F.col(id_col), "part", "first", "last"), 256).alias("input_hash"),
        F.lit("pending").alias("status"),
    )


def manifest(fields: dict[str, Column]) -> Column:
    """JSON of the fields in order of their names, nulls kept, and its digest."""
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return F.struct(body.alias("body"), F.sha2(body, 256).alias("digest"))


def verified(body: Column, digest: Column) -> Column:
    return F.sha2(body, 256) == digest


def line_slices(passage_table: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Passages (id, passage, start, end, sha256) with their text cut anew from the documents, and whether the hash agrees."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    cut = F.array_join(F.slice(lines, F.col("start"), F.col("end") - F.col("start") + 1), "\n")
    joined = passage_table.join(docs.select(id_col, "text"), id_col)
    return joined.select(id_col, "passage", F.length(cut).alias("chars"), (F.sha2(cut, 256) == F.col("sha256")).alias("intact"))
