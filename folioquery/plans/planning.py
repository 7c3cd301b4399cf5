"""Queries over plans of review runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import assembly as A
from folioquery.operators import blocks as B
from folioquery.operators import planning as P
from folioquery.plans.assembly import CLAIM_CHARS
from folioquery.plans.assembly import ORACLE_SQL as ASSEMBLY_SQL
from folioquery.plans.documents import CHUNK_LINES, PASSAGE_CHARS
from folioquery.plans.documents import ORACLE_SQL as DOCUMENT_SQL
from folioquery.sources.tables import markdown, read


def run_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of a new run over the derived Markdown."""
    docs = markdown(spark, sf_dir)
    local = P.local_cells(B.chunks(docs, CHUNK_LINES))
    return local.unionByName(P.claim_cells(A.claim_blocks(docs, CLAIM_CHARS)))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each document, and whether it verifies after every tenth one is changed."""
    docs = read(spark, sf_dir, "documents")
    made = docs.select("doc_id", P.manifest({"source": F.col("source"), "lang": F.col("lang"), "sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}).alias("m"))
    body = F.when(F.col("doc_id") % 10 == 0, F.concat("m.body", F.lit(" "))).otherwise(F.col("m.body"))
    return made.select("doc_id", "m.digest", P.verified(body, F.col("m.digest")).alias("verified"))


def passage_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages cut anew from documents of which some have changed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = B.passages(docs, PASSAGE_CHARS).select("doc_id", "passage", "start", "end", F.sha2("text", 256).alias("sha256"))
    changed = docs.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text")).alias("text"))
    return P.line_slices(cut, changed)


QUERIES = {f.__name__: f for f in (run_plan, manifests, passage_slices)}

_CHUNKS = DOCUMENT_SQL["chunk_plan"]
_CLAIMS = ASSEMBLY_SQL["claim_blocks"]

ORACLE_SQL = {
    "run_plan": f"""SELECT doc_id, printf('local-%d-%04d-%s', doc_id, chunk, dimension) AS cell_id, 'local' AS stage, dimension, "start" AS first, "end" AS last, sha256(sha256 || '|' || dimension) AS input_hash, 'pending' AS status
      FROM ({_CHUNKS}) CROSS JOIN (VALUES ('grammar-style'), ('logic-consistency')) t(dimension)
      UNION ALL SELECT doc_id, printf('claims-%d-%04d', doc_id, part), 'claims', NULL, first, last, sha256(concat_ws('|', doc_id, part, first, last)), 'pending' FROM ({_CLAIMS})""",
    "manifests": """SELECT doc_id, sha256('{"lang":"' || lang || '","sha256":"' || sha256(coalesce(text, '')) || '","source":"' || source || '"}') AS digest, doc_id % 10 <> 0 AS verified FROM documents""",
    "passage_slices": "WITH RECURSIVE "
    + B.passages_sql(PASSAGE_CHARS)
    + """SELECT doc_id, passage, length(text) + (doc_id % 9 = 0 AND passage = 1)::INT AS chars, NOT (doc_id % 9 = 0 AND passage = 1) AS intact FROM passage_texts""",
}
