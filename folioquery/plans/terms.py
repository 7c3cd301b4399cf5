"""Queries over terms, passages and their coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import blocks as B
from folioquery.operators import terms as T
from folioquery.plans.documents import PASSAGE_CHARS
from folioquery.sources.tables import read

#: A small glossary: (term_id, source, target, confidence).
TERMS = [
    ("t1", "the", "le", "high", "common"), ("t2", "Licensed under", "sous licence", "medium", "jargon"), ("t3", "été", "summer", None, "common"),
    ("t4", "de la", "of the", "low", None), ("t5", "version", "version", "high", "acronym"), ("t6", "…,", "...", "low", None),
]
TOP_K, CAP, BATCH, GROUP = 5, 3, 4, 30


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "term_id string, source string, target string, confidence string, kind string")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.occurrence_ledger(read(spark, sf_dir, "documents"), glossary(spark))


def occurrence_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger under its published names."""
    names = {"offset": "source_offset", "length": "source_length", "line": "source_line", "term_id": "entry", "term_key": "term_id"}
    return _ledger(spark, sf_dir).withColumnsRenamed(names)


def occurrence_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences by the passage that holds them."""
    spans = B.passages(read(spark, sf_dir, "documents"), PASSAGE_CHARS).select("doc_id", F.col("passage").alias("chunk"), "start", "end")
    held = T.with_chunk(_ledger(spark, sf_dir), spans)
    return held.groupBy("term_id", F.col("chunk").alias("passage")).agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("doc_id").alias("documents"))


def ledger_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger against a reviewed copy that lacks some rows, repeats others and has some of its own."""
    ledger = _ledger(spark, sf_dir).select("doc_id", "occurrence_id", "term_id", "offset")
    kept = ledger.where("offset % 7 <> 0").unionByName(ledger.where("offset % 11 = 1"))
    reviewed = kept.unionByName(ledger.where("offset % 13 = 0").withColumn("occurrence_id", F.concat(F.lit("x"), "occurrence_id")))
    return T.set_difference(ledger, reviewed, ["doc_id", "term_id", "occurrence_id"]).groupBy("term_id", "state").agg(F.count(F.lit(1)).alias("occurrences"))


def passage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    cut = B.passages(docs, PASSAGE_CHARS).join(docs.select("doc_id", "source", "lang"), "doc_id")
    passages = cut.select(F.col("source").alias("ref"), F.format_string("%s-%08d-%05d", "source", "doc_id", "passage").alias("passage_id"), F.concat_ws(" ", "source", "lang").alias("title"), "text")
    return T.passage_top_k(glossary(spark), passages, TOP_K)


def glossary_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that go with each source's documents, by priority."""
    sources = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("origin"))
    counted = _ledger(spark, sf_dir).join(sources, "doc_id").groupBy("origin", "term_id").agg(F.count(F.lit(1)).alias("occurrences"))
    candidates = counted.join(F.broadcast(glossary(spark)), "term_id").withColumn("protected", (F.col("term_id") == "t5").cast("int"))
    return T.glossary_slice(candidates, CAP, "origin").select("origin", "place", "term_id", "occurrences")


def relevance_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir).select("doc_id", "term_id", "offset", "occurrence_id")
    dealt = T.batches(ledger, BATCH, [F.col("term_id"), F.col("offset"), F.col("occurrence_id")], "doc_id")
    return dealt.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("occurrences"), F.min("occurrence_id").alias("first_id"))


def scheduling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each source in groups of at most thirty, in order."""
    docs = read(spark, sf_dir, "documents")
    cut = B.passages(docs, PASSAGE_CHARS).select("doc_id", "passage").join(docs.select("doc_id", "source"), "doc_id")
    dealt = T.batches(cut, GROUP, [F.col("doc_id"), F.col("passage")], "source")
    return dealt.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("passages"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def seam_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of adjacent passages of a document."""
    cut = B.passages(read(spark, sf_dir, "documents"), PASSAGE_CHARS).select("doc_id", "passage", "start", "end")
    pairs = T.adjacent(cut, ["doc_id"], ["passage"], ["passage", "start"])
    return pairs.select("doc_id", F.concat(F.lit("seam-"), "passage", F.lit("-"), "next_passage").alias("task"), F.col("end").alias("left_line"), F.col("next_start").alias("right_line"))


def term_chain_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of adjacent occurrences of a term in a document."""
    pairs = T.adjacent(_ledger(spark, sf_dir), ["doc_id", "term_id"], ["offset", "occurrence_id"], ["offset", "occurrence_id"])
    return pairs.groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("tasks"), F.max(F.col("next_offset") - F.col("offset")).alias("widest"))


QUERIES = {
    f.__name__: f
    for f in (
        occurrence_ledger, occurrence_passages, ledger_dispositions, passage_topk, glossary_slice, relevance_batches, scheduling_groups, seam_tasks, term_chain_tasks,
    )
}

_TERMS_SQL = "terms(term_id, source, target, confidence, kind) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in t) + ")" for t in TERMS) + ")"
#: Positions by walking the text from hit to hit with a recursive query; then the neighbours of each are tested.
_LEDGER_SQL = f"""{_TERMS_SQL},
pairs AS (SELECT d.doc_id, g.term_id, g.source, coalesce(d.text, '') AS text FROM documents d CROSS JOIN terms g WHERE contains(lower(coalesce(d.text, '')), lower(g.source))),
hits AS (
  SELECT doc_id, term_id, source, strpos(lower(text), lower(source)) AS pos, text FROM pairs
  UNION ALL
  SELECT doc_id, term_id, source, pos + strpos(substr(lower(text), pos + 1), lower(source)), text FROM hits WHERE strpos(substr(lower(text), pos + 1), lower(source)) > 0
),
placed AS (
  SELECT doc_id, term_id, source, pos - 1 AS "offset", length(source) AS length,
         1 + length(substr(text, 1, pos - 1)) - length(replace(substr(text, 1, pos - 1), chr(10), '')) AS line
  FROM hits WHERE NOT regexp_matches(source, '[A-Za-z0-9]') OR NOT regexp_matches(coalesce(nullif(substr(text, pos - 1, CASE WHEN pos > 1 THEN 1 ELSE 0 END), ''), ' '), '[\\p{{L}}\\p{{N}}\\p{{M}}_]')
    AND NOT regexp_matches(coalesce(nullif(substr(text, pos + length(source), 1), ''), ' '), '[\\p{{L}}\\p{{N}}\\p{{M}}_]')
),
hashes AS (SELECT doc_id, sha256(coalesce(text, '')) AS source_hash FROM documents),
keys AS (
  SELECT doc_id, term_id, any_value(source_hash) AS source_hash, coalesce(any_value(kind) IN ('proper-noun', 'jargon', 'acronym'), false) OR (contains(any_value(source), ' ') AND count(*) >= 2) AS key_item,
         substr(sha256('{{"first_offset":' || min("offset") || ',"kind":"term","source":"' || lower(any_value(source)) || '","source_hash":"' || any_value(source_hash) || '"}}'), 1, 24) AS term_key
  FROM placed JOIN hashes USING (doc_id) JOIN (SELECT term_id, kind FROM terms) USING (term_id) GROUP BY doc_id, term_id
),
ledger AS (
  SELECT *, substr(sha256('{{"kind":"occurrence","length":' || length || ',"offset":' || "offset" || ',"source_hash":"' || source_hash || '","term_id":"' || term_key || '"}}'), 1, 24) AS occurrence_id
  FROM placed JOIN keys USING (doc_id, term_id)
)
"""
_W = "WITH RECURSIVE "
_PASSAGES = B.passages_sql(PASSAGE_CHARS)
_NEEDLE = "lower(strip_accents(g.source))"
_COUNT = f"((length({{t}}) - length(replace({{t}}, {_NEEDLE}, ''))) // length({_NEEDLE}))"

ORACLE_SQL = {
    "occurrence_ledger": _W + _LEDGER_SQL + 'SELECT doc_id, term_id AS entry, source, "offset" AS source_offset, length AS source_length, line AS source_line, term_key AS term_id, occurrence_id, source_hash, key_item FROM ledger',
    "occurrence_passages": _W + _LEDGER_SQL + "," + _PASSAGES
    + """SELECT term_id, passage, count(*) AS occurrences, count(DISTINCT l.doc_id) AS documents FROM ledger l LEFT JOIN passage_rows p ON p.doc_id = l.doc_id AND l.line BETWEEN p."start" AND p."end" GROUP BY 1, 2""",
    "ledger_dispositions": _W + _LEDGER_SQL
    + """, reviewed AS (SELECT doc_id, term_id, occurrence_id FROM ledger WHERE "offset" % 7 <> 0 UNION ALL SELECT doc_id, term_id, occurrence_id FROM ledger WHERE "offset" % 11 = 1
         UNION ALL SELECT doc_id, term_id, 'x' || occurrence_id FROM ledger WHERE "offset" % 13 = 0),
      n AS (SELECT doc_id, term_id, occurrence_id, count(*) AS found FROM reviewed GROUP BY ALL)
      SELECT coalesce(l.term_id, n.term_id) AS term_id, CASE WHEN found IS NULL THEN 'missing' WHEN l.term_id IS NULL THEN 'unknown' WHEN found > 1 THEN 'duplicate' ELSE 'ok' END AS state, count(*) AS occurrences
      FROM ledger l FULL JOIN n ON l.doc_id = n.doc_id AND l.occurrence_id = n.occurrence_id GROUP BY 1, 2""",
    "passage_topk": _W + _TERMS_SQL + "," + _PASSAGES
    + f""", cut AS (SELECT d.source AS ref, printf('%s-%08d-%05d', d.source, p.doc_id, p.passage) AS passage_id, concat_ws(' ', d.source, d.lang) AS title, p.text FROM passage_texts p JOIN documents d USING (doc_id)),
      scored AS (SELECT g.term_id, c.ref, c.passage_id, {_COUNT.format(t='lower(strip_accents(c.text))')} + contains(lower(strip_accents(c.title)), {_NEEDLE})::INT AS score FROM cut c CROSS JOIN terms g),
      first AS (SELECT *, row_number() OVER (PARTITION BY term_id, ref ORDER BY score DESC, passage_id) AS k FROM scored WHERE score > 0),
      placed AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY (k > 1), score DESC, passage_id) AS place FROM first)
      SELECT term_id, place, passage_id, ref, score FROM placed WHERE place <= {TOP_K}""",
    "glossary_slice": _W + _LEDGER_SQL
    + f""", counted AS (SELECT d.source AS origin, l.term_id, count(*) AS occurrences FROM ledger l JOIN documents d USING (doc_id) GROUP BY 1, 2),
      ranked AS (SELECT origin, term_id, occurrences, row_number() OVER (PARTITION BY origin ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 3 END, occurrences DESC, (term_id = 't5') DESC, source) AS place FROM counted JOIN terms USING (term_id))
      SELECT origin, place, term_id, occurrences FROM ranked WHERE place <= {CAP}""",
    "relevance_batches": _W + _LEDGER_SQL
    + f""", dealt AS (SELECT doc_id, occurrence_id, (row_number() OVER (PARTITION BY doc_id ORDER BY term_id, "offset", occurrence_id) - 1) // {BATCH} + 1 AS batch FROM ledger)
      SELECT doc_id, batch, count(*) AS occurrences, min(occurrence_id) AS first_id FROM dealt GROUP BY 1, 2""",
    "scheduling_groups": _W + _PASSAGES
    + f""", dealt AS (SELECT d.source, p.doc_id, (row_number() OVER (PARTITION BY d.source ORDER BY p.doc_id, passage) - 1) // {GROUP} + 1 AS batch FROM passage_rows p JOIN documents d USING (doc_id))
      SELECT source, batch, count(*) AS passages, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM dealt GROUP BY 1, 2""",
    "seam_tasks": _W + _PASSAGES
    + """SELECT a.doc_id, 'seam-' || a.passage || '-' || b.passage AS task, a."end" AS left_line, b."start" AS right_line FROM passage_rows a JOIN passage_rows b ON a.doc_id = b.doc_id AND b.passage = a.passage + 1""",
    "term_chain_tasks": _W + _LEDGER_SQL
    + """, n AS (SELECT doc_id, term_id, "offset", lead("offset") OVER (PARTITION BY doc_id, term_id ORDER BY "offset") AS next FROM ledger)
      SELECT doc_id, term_id, count(*) AS tasks, max(next - "offset") AS widest FROM n WHERE next IS NOT NULL GROUP BY 1, 2""",
}
