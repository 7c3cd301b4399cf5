"""Queries over edits, reports, segments and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import assembly as A
from folioquery.operators import blocks as B
from folioquery.operators import review as R
from folioquery.plans.review import FINDINGS_SQL, findings
from folioquery.sources.tables import CONVERSATION_MARKDOWN_SQL, markdown, read

CLAIM_CHARS = 1500


def input_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission and stems of all page URLs, and of some as local names."""
    name = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?://", "in/")).otherwise(F.col("url"))
    value = F.when(F.col("page_id") % 7 == 1, F.regexp_replace("url", "://[^/]*", "://10.0.0.1")).otherwise(name)
    return read(spark, sf_dir, "pages").select("page_id", A.classify_input(value).alias("kind"), A.url_admissible(value).alias("admissible"), A.source_stem(value).alias("stem"))


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with edits of their second and third lines, which overlap in some."""
    docs = read(spark, sf_dir, "documents")
    one = docs.select("doc_id", F.lit(2).alias("first"), (2 + F.col("doc_id") % 2).cast("int").alias("last"), F.lit("EDIT").alias("text"))
    two = docs.select("doc_id", F.lit(3).alias("first"), F.lit(3).alias("last"), F.lit("LATE").alias("text"))
    return A.apply_edits(docs.select("doc_id", "text"), one.unionByName(two)).select("doc_id", F.sha2("text", 256).alias("sha256"))


def finding_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = R.report_order(R.dedupe_findings(findings(spark, sf_dir)))
    return A.report_cards(ordered).select("doc_id", F.length("report").alias("chars"), F.sha2("report", 256).alias("sha256"))


def bilingual_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turns that follow them."""
    turns = read(spark, sf_dir, "conversations")
    source = turns.where("role = 'user'").select("conv_id", "turn", "text")
    target = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return A.bilingual_segments(source, target, ["conv_id", "turn"]).select("conv_id", "turn", "state", F.length("source").alias("source_chars"), F.length("target").alias("target_chars"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("url").contains("spam"), "skipped").when(F.col("html").contains("<title>"), "converted").otherwise("failed")
    return A.batch_summary(read(spark, sf_dir, "pages").select(state.alias("state")))


def claim_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.claim_blocks(markdown(spark, sf_dir), CLAIM_CHARS)


def inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir).select("doc_id", F.concat(F.lit("![one]("), "doc_id", F.lit(".png) and ![two](b.jpg 'x')\n"), "text").alias("text"))
    shown = docs.select("doc_id", B.let(A.inline_images(F.col("text")), lambda x: x).alias("i"), A.fence_balance(F.col("text")).alias("balanced"))
    return shown.select("doc_id", "balanced", F.posexplode("i").alias("place", "x")).select("doc_id", "balanced", "place", "x.alt", "x.target")


QUERIES = {f.__name__: f for f in (input_kinds, edited_documents, finding_reports, bilingual_segments, batch_summary, claim_blocks, inline_images)}

_VALUE = """v AS (SELECT page_id, CASE WHEN page_id % 7 = 1 THEN regexp_replace(url, '://[^/]*', '://10.0.0.1') WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://', 'in/') ELSE url END AS value FROM pages)"""
_SUFFIXES = ", ".join(f"'{s}'" for s in A.SUFFIXES)

ORACLE_SQL = {
    "input_kinds": f"""WITH {_VALUE}, b AS (SELECT *, regexp_replace(regexp_replace(value, '[?#].*$', ''), '/+$', '') AS bare FROM v)
      SELECT page_id, CASE WHEN regexp_matches(value, '(?i)^https?://') THEN 'url' WHEN lower(regexp_extract(value, '\\.([^./?#]+)$', 1)) IN ({_SUFFIXES}) THEN 'file' ELSE 'unsupported' END AS kind,
        regexp_matches(value, '^https?://') AND NOT starts_with(regexp_extract(value, '://([^/?#]*)', 1), '10.') AS admissible,
        CASE WHEN strpos(regexp_extract(bare, '([^/]*)$', 1), '.') > 1 THEN regexp_replace(regexp_extract(bare, '([^/]*)$', 1), '\\.[^.]*$', '') ELSE regexp_extract(bare, '([^/]*)$', 1) END AS stem FROM b""",
    "edited_documents": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
      SELECT doc_id, sha256(array_to_string(CASE WHEN len(l) < 2 THEN l WHEN len(l) = 2 THEN CASE WHEN doc_id % 2 = 0 THEN [l[1], 'EDIT'] ELSE l END
        WHEN doc_id % 2 = 1 THEN [l[1], 'EDIT'] || l[4:] ELSE [l[1], 'EDIT', 'LATE'] || l[4:] END, chr(10))) AS sha256 FROM d""",
    "finding_reports": f"""WITH {FINDINGS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_line NULLS LAST, rank, ordinal) AS place FROM merged),
      r AS (SELECT doc_id, string_agg('### ' || place || '. ' || CASE WHEN first_line IS NULL THEN 'whole text' ELSE 'line ' || first_line END || ' (' || severity || ')' || chr(10) || original || chr(10) || '> ' || reason, chr(10) || chr(10) ORDER BY place) AS report FROM o GROUP BY doc_id)
      SELECT doc_id, length(report) AS chars, sha256(report) AS sha256 FROM r""",
    "bilingual_segments": """WITH s AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), t AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant')
      SELECT conv_id, turn, CASE WHEN t.text IS NULL THEN 'untranslated' WHEN s.text IS NULL THEN 'unknown' ELSE 'ok' END AS state, length(s.text) AS source_chars, length(t.text) AS target_chars FROM s FULL JOIN t USING (conv_id, turn)""",
    "batch_summary": """WITH r AS (SELECT CASE WHEN contains(url, 'spam') THEN 'skipped' WHEN contains(html, '<title>') THEN 'converted' ELSE 'failed' END AS state FROM pages)
      SELECT count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'skipped') AS skipped, count(*) FILTER (WHERE state = 'converted') AS converted,
        CASE WHEN count(*) FILTER (WHERE state = 'failed') > 0 THEN 1 WHEN count(*) FILTER (WHERE state = 'skipped') > 0 THEN 2 ELSE 0 END AS exit_code FROM r""",
    "claim_blocks": "WITH RECURSIVE " + CONVERSATION_MARKDOWN_SQL + "," + B.BLOCKS_SQL
    + f""", sized AS (SELECT b.doc_id, b.block_no, b.first, b.last, list_sum(list_transform(l.lines[b.first:b.last], lambda x: length(x) + 1))::BIGINT AS n FROM block_rows b JOIN line_list l USING (doc_id)),
      w AS (SELECT doc_id, block_no, n AS total, 1 AS part FROM sized WHERE block_no = 1
        UNION ALL SELECT s.doc_id, s.block_no, CASE WHEN w.total + s.n > {CLAIM_CHARS + 1} THEN s.n ELSE w.total + s.n END, CASE WHEN w.total + s.n > {CLAIM_CHARS + 1} THEN w.part + 1 ELSE w.part END FROM w JOIN sized s ON s.doc_id = w.doc_id AND s.block_no = w.block_no + 1)
      SELECT doc_id, part, min(first) AS first, max(last) AS last, sum(n)::BIGINT - 1 AS chars FROM w JOIN sized USING (doc_id, block_no) GROUP BY 1, 2""",
    "inline_images": "WITH " + CONVERSATION_MARKDOWN_SQL
    + """, f AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(```|~~~)'))) % 2 = 0 AS balanced FROM md_docs)
      SELECT doc_id, balanced, 0 AS place, 'one' AS alt, doc_id || '.png' AS target FROM f UNION ALL SELECT doc_id, balanced, 1, 'two', 'b.jpg' FROM f""",
}
