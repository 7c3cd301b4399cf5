"""Queries over lines, blocks, chunks and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import blocks as B
from folioquery.sources.tables import CONVERSATION_MARKDOWN_SQL, markdown, read

CHUNK_LINES = 8
PASSAGE_CHARS = 2000


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.chunks(markdown(spark, sf_dir), CHUNK_LINES).drop("text")


def chunk_plan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.review_chunks(markdown(spark, sf_dir), CHUNK_LINES).drop("text")


def block_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = B.let(B.lines_of(F.col("text")), B.blocks_of)
    return markdown(spark, sf_dir).select("doc_id", F.posexplode(blocks).alias("at", "b")).select(
        "doc_id", (F.col("at") + 1).alias("block_no"), "b.kind", (F.col("b.first") + 1).alias("first"), (F.col("b.last") + 1).alias("last")
    )


def passages_by_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.passages(read(spark, sf_dir, "documents"), PASSAGE_CHARS).select("doc_id", "passage", "start", "end", "over_capacity", F.sha2("text", 256).alias("sha256"))


def gapless_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir)
    return B.coverage(B.chunks(docs, CHUNK_LINES), docs)


QUERIES = {
    "chunk_plan": chunk_plan,
    "chunk_plan_review": chunk_plan_review,
    "block_inventory": block_inventory,
    "passages_by_chars": passages_by_chars,
    "gapless_coverage": gapless_coverage,
}

_MD = "WITH RECURSIVE " + CONVERSATION_MARKDOWN_SQL
_CHUNKS = _MD + "," + B.chunks_sql(CHUNK_LINES)
_TRIMMED = _MD.replace("md_docs AS (", "md_whole AS (") + ", md_docs AS (SELECT doc_id, regexp_replace(text, '\\n\\z', '') AS text FROM md_whole)," + B.chunks_sql(CHUNK_LINES)

ORACLE_SQL = {
    "chunk_plan": _CHUNKS + 'SELECT doc_id, chunk, "start", "end", lines, oversized, sha256(text) AS sha256 FROM chunk_texts',
    "chunk_plan_review": _TRIMMED
    + """SELECT doc_id, chunk, "start", "end", lines, oversized, sha256(text) AS sha256,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(```|~~~)'))) AS fence_lines FROM chunk_texts""",
    "block_inventory": _MD + "," + B.BLOCKS_SQL + "SELECT doc_id, block_no, kind, first, last FROM block_rows",
    "passages_by_chars": "WITH RECURSIVE "
    + B.passages_sql(PASSAGE_CHARS)
    + f'SELECT doc_id, passage, "start", "end", length(text) + 1 > {PASSAGE_CHARS} AS over_capacity, sha256(text) AS sha256 FROM passage_texts',
    "gapless_coverage": _CHUNKS
    + """, proofs AS (
      SELECT doc_id, "start", coalesce("start" = lag("end") OVER (PARTITION BY doc_id ORDER BY chunk) + 1, true) AS ok, "end", chunk, text FROM chunk_texts)
    SELECT doc_id, count(*) AS chunks, sum("end" - "start" + 1)::BIGINT AS covered, bool_and(ok) AS gapless,
           string_agg(p.text, chr(10) ORDER BY chunk) = any_value(d.text) AS equal
    FROM proofs p JOIN md_docs d USING (doc_id) GROUP BY doc_id""",
}
