"""Queries over review runs derived from the event, label and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import review as R
from folioquery.operators import terms as T
from folioquery.sources.tables import read

BATCH_CHARS = 400


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.element_at(F.array(*[F.lit(s) for s in ("high", "medium", "low", None, "high")]), (F.col("event_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("doc_id"),
        F.col("event_id").alias("ordinal"),
        F.when(F.col("event_id") % 9 > 0, F.col("event_id") % 7 + 1).alias("first_line"),
        F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("original"),
        (F.floor("value") % 3).cast("string").alias("category"),
        severity.alias("severity"),
        F.substring("props", F.lit(1), (F.col("event_id") % 9 + 1).cast("int")).alias("revised"),
        F.concat(F.lit("because "), (F.col("event_id") % 100).cast("string")).alias("reason"),
        F.substring(F.sha2("props", 256), 1, 6).alias("evidence"),
    )


def findings_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe_findings(findings(spark, sf_dir)).withColumn("evidence", F.array_join("evidence", ","))


def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.report_order(R.dedupe_findings(findings(spark, sf_dir))).select("doc_id", "place", "first_line", "original", "category", "severity", "ordinal")


def grounding_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as claims against the nations as passages."""
    claims = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("claim_id")).distinct()
    passages = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("passage_id"))
    mixed = F.col("claim_id") * 31 + F.col("passage_id") * 7
    status = F.when(F.col("claim_id") % 3 == 0, "no-basis").when(mixed % 97 == 0, "contradicted").when(mixed % 2 == 0, "no-basis").otherwise("supported")
    assessments = claims.crossJoin(F.broadcast(passages)).where(mixed % 101 != 0).select("claim_id", "passage_id", status.alias("status"))
    return R.grounding(claims, passages, assessments)


def claim_passage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of claim batches against the sources: every batch meets every source."""
    claims = T.batches(read(spark, sf_dir, "benchmark").select("item_id", F.lit(1).alias("g")), 7, [F.col("item_id")], "g")
    groups = claims.groupBy(F.col("batch").alias("claim_batch")).agg(F.count(F.lit(1)).alias("claims"))
    sources = read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("passages"))
    return groups.crossJoin(sources).select("claim_batch", "source", "claims", "passages", (F.col("claims") * F.col("passages")).alias("pairs"))


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = read(spark, sf_dir, "part")
    status = F.when(F.col("p_size") > 15, "accepted").when(F.col("p_size") % 5 == 0, "failed").otherwise("pending")
    cells = part.select(F.col("p_partkey").alias("cell_id"), status.alias("status"), F.col("p_brand").alias("stage"), (F.col("p_size") % 4).alias("attempts"))
    needs = F.explode(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3)))
    edges = part.select(F.col("p_partkey").alias("cell_id"), needs.alias("needs")).where("needs > 0").distinct()
    return cells, edges


def ready_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ready_cells(*_cells(spark, sf_dir)).select("cell_id", "stage")


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = _cells(spark, sf_dir)
    counted = cells.groupBy("stage").agg(
        F.count(F.lit(1)).alias("cells"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "failed", "pending")],
        F.count_if((F.col("status") == "pending") & (F.col("attempts") > 0)).alias("retryable"),
    )
    return counted.withColumn("complete", (F.col("cells") > 0) & (F.col("accepted") == F.col("cells")))


def result_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("cell_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"),
        (F.col("event_id") % 3 != 0).alias("valid"), (F.col("event_id") % 11 == 0).alias("stale"),
    )


def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ingest(result_events(read(spark, sf_dir, "events")))


def reducer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reducers over the turns of each conversation."""
    return R.reducer_tree(read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("leaves")))


def observation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation as JSON, packed to batches."""
    turn = F.concat(F.lit('{"role":"'), "role", F.lit('","chars":'), F.length("text"), F.lit(',"text":"'), F.sha2("text", 256), F.lit('"}'))
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("json")))).alias("t"))
    return R.json_batches(turns.select("doc_id", F.transform("t", lambda x: x["json"]).alias("items")), "items", BATCH_CHARS, "doc_id")


def distinct_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct turns by the hash of their role and text, with the first conversation that has each, in order of the hash."""
    hashed = read(spark, sf_dir, "conversations").select("conv_id", F.sha2(F.concat_ws("|", "role", "text"), 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("conv_id").alias("first_conv"), F.count(F.lit(1)).alias("turns"))


def routing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as test cases by source: share that passes, all-or-nothing for critical sources."""
    graded = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    summed = graded.groupBy("source").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("quality") == 1).alias("passed"))
    critical = F.col("source").endswith("0")
    return summed.select("source", "cases", "passed", F.when(critical, F.col("passed") == F.col("cases")).otherwise(F.col("passed") * 2 >= F.col("cases")).alias("ok"))


QUERIES = {
    f.__name__: f
    for f in (
        findings_dedupe, findings_order, grounding_status, claim_passage_matrix, ready_cells, run_status, ingest_outcomes, reducer_tree, observation_batches,
        distinct_observations, routing_summary,
    )
}

FINDINGS_SQL = """findings AS (
  SELECT user_id % 40 AS doc_id, event_id AS ordinal, CASE WHEN event_id % 9 > 0 THEN event_id % 7 + 1 END AS first_line, trim(event_type) AS original,
         (floor(value)::BIGINT % 3)::VARCHAR AS category, [0, 1, 2, 1, 0][event_id % 5 + 1] AS rank, substr(props, 1, event_id % 9 + 1) AS revised,
         'because ' || (event_id % 100) AS reason, substr(sha256(props), 1, 6) AS evidence FROM events
),
merged AS (
  SELECT doc_id, first_line, original, category, ['high', 'medium', 'low'][min(rank) + 1] AS severity, min(rank) AS rank,
         first(revised ORDER BY length(coalesce(revised, '')) DESC, ordinal) AS revised, first(reason ORDER BY length(coalesce(reason, '')) DESC, ordinal) AS reason,
         array_to_string(list_sort(list_distinct(list(evidence))), ',') AS evidence, min(ordinal) AS ordinal, count(*) AS merged
  FROM findings GROUP BY doc_id, first_line, original, category
)"""
_CELLS = """cells AS (SELECT p_partkey AS cell_id, CASE WHEN p_size > 15 THEN 'accepted' WHEN p_size % 5 = 0 THEN 'failed' ELSE 'pending' END AS status, p_brand AS stage, p_size % 4 AS attempts FROM part)"""

ORACLE_SQL = {
    "findings_dedupe": f"WITH {FINDINGS_SQL} SELECT doc_id, first_line, original, category, severity, revised, reason, evidence, ordinal, merged FROM merged",
    "findings_order": f"WITH {FINDINGS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line NULLS LAST, rank, ordinal) AS place, first_line, original, category, severity, ordinal FROM merged",
    "grounding_status": """WITH claims AS (SELECT DISTINCT conv_id AS claim_id FROM conversations),
      pairs AS (SELECT claim_id, n_nationkey AS p, claim_id * 31 + n_nationkey * 7 AS mixed FROM claims CROSS JOIN nation),
      judged AS (SELECT claim_id, CASE WHEN mixed % 101 = 0 THEN NULL WHEN claim_id % 3 = 0 THEN 'no-basis' WHEN mixed % 97 = 0 THEN 'contradicted' WHEN mixed % 2 = 0 THEN 'no-basis' ELSE 'supported' END AS status FROM pairs)
      SELECT claim_id, count(status) AS assessed, CASE WHEN count(status) < count(*) THEN 'unverified' WHEN bool_or(status = 'contradicted') THEN 'contradicted' WHEN bool_and(status = 'no-basis') THEN 'no-basis' ELSE 'supported' END AS verdict
      FROM judged GROUP BY claim_id""",
    "claim_passage_matrix": """WITH b AS (SELECT (row_number() OVER (ORDER BY item_id) - 1) // 7 + 1 AS claim_batch FROM benchmark),
      g AS (SELECT claim_batch, count(*) AS claims FROM b GROUP BY 1), s AS (SELECT source, count(*) AS passages FROM documents GROUP BY 1)
      SELECT claim_batch, source, claims, passages, claims * passages AS pairs FROM g CROSS JOIN s""",
    "ready_cells": f"WITH {_CELLS} SELECT cell_id, stage FROM cells c WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM (SELECT c.cell_id // 2 AS d UNION SELECT c.cell_id // 3) WHERE d > 0 AND d NOT IN (SELECT cell_id FROM cells WHERE status = 'accepted'))",
    "run_status": f"""WITH {_CELLS} SELECT stage, count(*) AS cells, count(*) FILTER (WHERE status = 'accepted') AS accepted, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending,
      count(*) FILTER (WHERE status = 'pending' AND attempts > 0) AS retryable, bool_and(status = 'accepted') AS complete FROM cells GROUP BY stage""",
    "ingest_outcomes": """WITH RECURSIVE e AS (SELECT user_id AS cell_id, event_id AS seq, event_type AS payload, event_id % 3 <> 0 AS valid, event_id % 11 = 0 AS stale, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      walk AS (
        SELECT cell_id, 0::BIGINT AS k, 0 AS bad, NULL::VARCHAR AS taken, NULL::BIGINT AS seq, NULL::VARCHAR AS outcome FROM (SELECT DISTINCT cell_id FROM e)
        UNION ALL
        SELECT w.cell_id, e.k, w.bad + (w.taken IS NULL AND NOT e.stale AND NOT e.valid)::INT,
          CASE WHEN w.taken IS NULL AND NOT e.stale AND e.valid AND w.bad < 3 THEN e.payload ELSE w.taken END, e.seq,
          CASE WHEN e.stale THEN 'stale' WHEN w.taken IS NOT NULL THEN CASE WHEN e.payload = w.taken THEN 'repeat' ELSE 'conflict' END
               WHEN w.bad >= 3 THEN 'closed' WHEN e.valid THEN 'accepted' WHEN w.bad = 2 THEN 'failed' ELSE 'invalid' END
        FROM walk w JOIN e ON e.cell_id = w.cell_id AND e.k = w.k + 1)
      SELECT cell_id, seq, outcome FROM walk WHERE k > 0""",
    "reducer_tree": """WITH RECURSIVE n AS (SELECT conv_id AS doc_id, count(*) AS leaves FROM conversations GROUP BY 1),
      t AS (SELECT doc_id, 0 AS layer, leaves AS cells FROM n UNION ALL SELECT doc_id, layer + 1, (cells + 3) // 4 FROM t WHERE cells > 1 AND layer < 3)
      SELECT doc_id, layer, cells FROM t WHERE layer > 0""",
    "observation_batches": f"""WITH RECURSIVE t AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length('{{"role":"' || role || '","chars":' || length(text) || ',"text":"' || sha256(text) || '"}}') + 1 AS n FROM conversations),
      w AS (SELECT doc_id, k, n AS total, 1 AS batch, n FROM t WHERE k = 1
        UNION ALL SELECT t.doc_id, t.k, CASE WHEN w.total + t.n > {BATCH_CHARS - 1} THEN t.n ELSE w.total + t.n END, CASE WHEN w.total + t.n > {BATCH_CHARS - 1} THEN w.batch + 1 ELSE w.batch END, t.n FROM w JOIN t ON t.doc_id = w.doc_id AND t.k = w.k + 1)
      SELECT doc_id, batch, count(*) AS items, sum(n)::BIGINT + 1 AS chars FROM w GROUP BY 1, 2""",
    "distinct_observations": "SELECT sha256(concat_ws('|', role, text)) AS hash, min(conv_id) AS first_conv, count(*) AS turns FROM conversations GROUP BY 1",
    "routing_summary": "SELECT source, count(*) AS cases, count(*) FILTER (WHERE quality = 1) AS passed, CASE WHEN ends_with(source, '0') THEN bool_and(quality = 1) ELSE count(*) FILTER (WHERE quality = 1) * 2 >= count(*) END AS ok FROM labels JOIN documents USING (doc_id) GROUP BY source",
}
