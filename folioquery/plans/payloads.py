"""Queries over payloads of stages and canonical documents; plans and results are derived from events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import payloads as P
from folioquery.plans.lifecycle import _pick
from folioquery.sources.tables import read

ENDS = ("applied", "preserved", "not_applicable", "conflict", "unresolved", "lost")
PLACEMENTS = ("resolved", "unresolved", "resolved", "lost")
#: Characters of a job in the query.
JOB = 100_000
OUTPUTS = (
    '{"abi": "anti-entropy-core.runner/v1", "status": "ok", "exit_code": 0, "command": "scan", "data": {"version": "2"}, "issues": []}',
    '{"abi": "other", "status": "ok", "exit_code": 0, "command": "scan", "data": {}, "issues": []}',
    '{"abi": "anti-entropy-core.runner/v1", "status": 1, "exit_code": 0, "command": "scan", "data": {}, "issues": []}',
    '{"abi": "anti-entropy-core.runner/v1", "status": "ok", "exit_code": true, "command": "scan", "data": {}, "issues": []}',
    '{"abi": "anti-entropy-core.runner/v1", "status": "ok", "exit_code": 0, "command": "scan", "data": [], "issues": []}',
    '{"abi": "anti-entropy-core.runner/v1", "status": "ok", "exit_code": 0, "command": "scan", "data": {}, "issues": {}}',
    '{"abi": "anti-entropy-core.runner/v1", "status": "ok", "command": "scan", "data": {}}',
    '{"abi": "anti-entropy-core.runner/v1", "status": "ok", "exit_code": 0, "command": "other", "data": {}, "issues": []}',
    "[1]", "{no", "{}\n{}", "",
)


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as occurrences of runs."""
    return read(spark, sf_dir, "events").select(F.concat(F.lit("r"), "user_id").alias("run_id"), F.col("event_id").alias("e"), F.concat(F.lit("occ-"), F.col("event_id").cast("string")).alias("occurrence_id"), "event_type", "props")


def ledger_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    ledger = _ids(spark, sf_dir).select(
        "run_id", F.when(e % 17 > 0, F.concat(F.lit("occ-"), (e % 500).cast("string"))).alias("occurrence_id"), F.when(e % 7 > 0, _pick(ENDS, e)).alias("disposition"),
        F.when(e % 5 == 0, "").when(e % 5 > 1, "seen").alias("reason"), F.when(e % 3 > 0, e % 3 == 1).alias("key_item"),
    )
    return P.ledger_problems(ledger)


def occurrence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _ids(spark, sf_dir)
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("e") % 5 == 0, 2).otherwise(1)))
    claimed = ids.where("e % 4 > 0").select("run_id", F.when(F.col("e") % 7 == 0, F.concat(F.lit("made-"), F.col("e").cast("string"))).otherwise(F.col("occurrence_id")).alias("occurrence_id"), copies.alias("_c"))
    return P.occurrence_gaps(ids, claimed.drop("_c"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as translated chunks of runs by the hundred: some left out, some empty, some twice."""
    d = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").where("doc_id % 13 > 0")
    copies = F.explode(F.array_repeat(F.lit(1), F.when(d % 11 == 0, 2).otherwise(1)))
    return docs.select(
        F.floor(d / 100).alias("run_id"), F.when(d % 17 > 0, F.when(d % 19 == 0, d % 100 + 200).otherwise(d % 100)).alias("chunk"), F.when(d % 7 == 0, " \n").otherwise(F.col("text")).alias("text"),
        F.when(d % 5 == 0, F.array(F.lit("o"), F.lit(None).cast("string"))).when(d % 5 > 1, F.array(F.lit("o"))).alias("occurrence_ids"), copies.alias("_c"),
    ).drop("_c")


def translation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("run_id"), (F.col("doc_id") % 100).alias("chunk"))
    return P.translation_problems(planned, _chunks(spark, sf_dir))


def assembled_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the ten as the chunks of a translation."""
    d = F.col("doc_id")
    return P.assembly_digests(read(spark, sf_dir, "documents").select(F.floor(d / 10).alias("run_id"), F.when(d % 77 > 0, d % 10).alias("chunk"), "text"))


def memory_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    ids = _ids(spark, sf_dir)
    planned = ids.select("run_id", F.concat(F.lit("p"), (e % 300).cast("string")).alias("passage_id"))
    given = ids.where("e % 9 > 0").select("run_id", F.when(e % 31 > 0, F.concat(F.lit("p"), (e % 300 + F.when(e % 23 == 0, 300).otherwise(0)).cast("string"))).alias("passage_id"), F.when(e % 4 > 0, "completed").alias("status"))
    return P.memory_problems(planned, given)


def retrieval_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    faults = P.retrieval_problems(e % 3, _pick(("completed", "not_applicable"), F.floor(e / 3)), F.when(e % 5 > 0, F.col("props")), e % 7 > 0, F.when(e % 4 > 0, "no references"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(faults, ",").alias("problems"))


def matching_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    ids = _ids(spark, sf_dir).withColumns({"term": F.col("event_type"), "line": F.when(e % 6 > 0, e % 90)})
    given = ids.where("e % 19 > 0").select(
        "run_id", F.when(e % 23 == 0, F.concat("occurrence_id", F.lit("x"))).otherwise(F.col("occurrence_id")).alias("occurrence_id"), F.when(e % 10 == 0, "other").otherwise(F.col("term")).alias("term"),
        F.when(e % 14 == 0, None).otherwise(F.col("line")).alias("line"), _pick(("reference", "user_seed"), e).alias("origin"), _pick(ENDS, F.floor(e / 2)).alias("disposition"), (e % 4).alias("evidence"), F.when(e % 3 > 0, e % 3 == 1).alias("mismatch"),
    )
    return P.matching_problems(ids, given, ["term", "line"])


def review_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding on the first lines of each document: category, texts and two places."""
    d = F.col("doc_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def place(start, end):
        return F.struct(start.cast("int").alias("start_line"), end.cast("int").alias("end_line"))

    finding = {
        "category": _pick(("style", "logic"), d), "original": F.when(d % 5 == 0, P.MISSING_ORIGINALS[0]).when(d % 5 == 1, "").otherwise(F.get(lines, F.lit(0))), "revised": F.when(d % 7 > 0, "x"), "change": F.lit("y"), "reason": F.lit("z"),
        "locations": F.when(d % 11 > 0, F.array(place(F.lit(1), d % 3), place(d % 4, d % 4 + 1))),
    }
    faults = P.review_finding_problems(finding, lines, F.when(d % 2 == 0, 1), F.lit(2), F.array(F.lit("style")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(faults, ",").alias("problems"))


def semantic_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of each user's errors and signups against all their events as passages of like size."""
    e = F.col("e")
    ids = _ids(spark, sf_dir)
    claims = ids.where("event_type IN ('error', 'signup')").select("run_id", F.col("event_type").alias("origin"), F.lit(3).alias("chars"))
    passages = ids.select("run_id", F.lpad(e.cast("string"), 12, "0").alias("passage_id"), F.lit(20).alias("chars"))
    return P.semantic_jobs(claims, passages, JOB)


def reducer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reducer_cells(read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("leaves")))


def final_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return P.final_cells(read(spark, sf_dir, "events").select(e.cast("string").alias("run_id"), (e % 7).alias("claims"), (e % 5).alias("facts"), (e % 3).alias("candidates")))


def _placed(spark: SparkSession, sf_dir: str):
    """Documents by the ten: nodes, tables, assets, units and occurrences of images."""
    d = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select((d - d % 10).alias("doc_id"), (d % 10).alias("k"))
    k, n = F.col("k"), F.col("doc_id") + F.col("k")
    text = k.cast("string")
    nodes = docs.select("doc_id", F.concat(F.lit("n"), text).alias("node_id"), _pick(("table", "image", "heading", "page_label"), n).alias("type"), F.when(n % 7 > 0, F.concat(F.lit("u"), text)).alias("unit_id"), F.concat(F.lit("t"), text).alias("table_id"), F.concat(F.lit("a"), text).alias("asset_id"))
    placed = docs.select(
        "doc_id", F.concat(F.lit("u"), (k % 5).cast("string")).alias("unit_id"), (n % 4).alias("occurrence"), F.concat(F.lit("a"), text).alias("asset_id"), _pick(PLACEMENTS, n).alias("placement"),
        F.when(n % 5 > 1, F.concat(F.lit("n"), (k + F.when(n % 9 == 0, 20).otherwise(0)).cast("string"))).alias("node_id"),
    )
    units = docs.where("k < 9").select("doc_id", F.concat(F.lit("u"), text).alias("unit_id"))
    tables = docs.where("k % 3 > 0").select("doc_id", F.concat(F.lit("t"), text).alias("table_id"))
    assets = docs.where("k % 4 > 0").select("doc_id", F.concat(F.lit("a"), text).alias("asset_id"))
    return nodes, tables, assets, units, placed


def node_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, tables, assets, units, _ = _placed(spark, sf_dir)
    return P.node_problems(nodes, tables, assets, units)


def placement_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _, assets, units, placed = _placed(spark, sf_dir)
    return P.placement_problems(placed, nodes, assets, units)


def document_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    hashed = F.sha2(F.coalesce("text", F.lit("")), 256)
    all_docs = read(spark, sf_dir, "documents")
    docs = all_docs.select("doc_id", hashed.alias("source_sha256"), F.when(d % 5 > 0, F.concat(F.lit("sha256:"), hashed)).otherwise(hashed).alias("document_id"), _pick((*P.QUALITIES, "good"), d).alias("status"))
    nodes = all_docs.where("doc_id % 7 > 0").select("doc_id", _pick(("paragraph", "page_label", "table"), d).alias("type"))
    warned = all_docs.where("doc_id % 3 > 0").select("doc_id", (d % 3 == 1).alias("content_loss"))
    return P.document_problems(docs, nodes, warned)


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", P.math_text(F.when(e % 3 > 0, F.col("props")).when(e % 2 == 0, "  "), e % 4 == 0).alias("text"))


def runner_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", P.runner_problem(F.lit("scan"), F.concat(_pick(OUTPUTS, e), F.lit("\r\n \n"))).alias("problem"))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_faults, occurrence_gaps, translation_faults, assembled_hashes, memory_faults, retrieval_faults, matching_faults, review_faults, semantic_jobs, reducer_cells, final_cells, node_faults,
        placement_faults, document_faults, formulas, runner_outputs,
    )
}


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_PLACED = f"""d AS (SELECT doc_id - doc_id % 10 AS doc_id, doc_id % 10 AS k, doc_id AS n FROM documents),
  nodes AS (SELECT doc_id, k, n, ['table', 'image', 'heading', 'page_label'][n % 4 + 1] AS type FROM d),
  placed AS (SELECT doc_id, k, n, 'u' || k % 5 AS unit_id, n % 4 AS occurrence, {_list(PLACEMENTS)}[n % 4 + 1] AS placement, CASE WHEN n % 5 > 1 THEN k + CASE WHEN n % 9 = 0 THEN 20 ELSE 0 END END AS node FROM d)"""

ORACLE_SQL = {
    "ledger_faults": f"""WITH l AS (SELECT 'r' || user_id AS run_id, CASE WHEN event_id % 17 > 0 THEN 'occ-' || event_id % 500 END AS occurrence_id, CASE WHEN event_id % 7 > 0 THEN {_list(ENDS)}[event_id % 6 + 1] END AS s,
        event_id % 5 > 1 AS reasoned, event_id % 3 = 1 AS key_item FROM events)
      SELECT run_id, occurrence_id, 'missing_id' AS problem FROM l WHERE occurrence_id IS NULL
      UNION ALL SELECT run_id, occurrence_id, 'no_disposition' FROM l WHERE s IS NULL OR s = 'lost'
      UNION ALL SELECT run_id, occurrence_id, 'no_reason' FROM l WHERE s IN ('preserved', 'not_applicable', 'conflict') AND NOT reasoned
      UNION ALL SELECT run_id, occurrence_id, 'unresolved' FROM l WHERE s IN ('conflict', 'unresolved')
      UNION ALL SELECT run_id, occurrence_id, 'key_unresolved' FROM l WHERE key_item AND s IS NULL
      UNION ALL SELECT run_id, occurrence_id, 'duplicate_id' FROM l WHERE occurrence_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""",
    "occurrence_gaps": """WITH i AS (SELECT 'r' || user_id AS run_id, event_id AS e, 'occ-' || event_id AS id FROM events),
      s AS (SELECT run_id, id, 'missing' AS state, 0 AS twice FROM i WHERE e % 4 = 0 OR e % 7 = 0
        UNION ALL SELECT run_id, 'made-' || e, 'unknown', (e % 5 = 0)::INT FROM i WHERE e % 4 > 0 AND e % 7 = 0
        UNION ALL SELECT run_id, id, NULL, 1 FROM i WHERE e % 4 > 0 AND e % 7 > 0 AND e % 5 = 0),
      k AS (SELECT *, row_number() OVER (PARTITION BY run_id, state ORDER BY id) AS k FROM s)
      SELECT run_id, count(*) FILTER (WHERE state = 'missing') AS missing, count(*) FILTER (WHERE state = 'unknown') AS unknown, sum(twice)::BIGINT AS repeated,
        coalesce(string_agg(id, ', ' ORDER BY id) FILTER (WHERE state = 'missing' AND k <= 5), '') AS missing_ids, coalesce(string_agg(id, ', ' ORDER BY id) FILTER (WHERE state = 'unknown' AND k <= 5), '') AS unknown_ids FROM k GROUP BY run_id""",
    "translation_faults": r"""WITH g AS (SELECT doc_id AS d, doc_id // 100 AS run_id, CASE WHEN doc_id % 17 > 0 THEN CASE WHEN doc_id % 19 = 0 THEN doc_id % 100 + 200 ELSE doc_id % 100 END END AS chunk, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS text,
        unnest(range(CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END)) AS copy FROM documents WHERE doc_id % 13 > 0),
      p AS (SELECT DISTINCT doc_id // 100 AS run_id, doc_id % 100 AS chunk FROM documents), c AS (SELECT DISTINCT run_id, chunk FROM g WHERE chunk IS NOT NULL)
      SELECT run_id, chunk, 'missing_id' AS problem FROM g WHERE chunk IS NULL
      UNION ALL SELECT run_id, chunk, 'empty' FROM g WHERE text IS NULL OR NOT regexp_matches(text, '[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')
      UNION ALL SELECT run_id, chunk, 'no_occurrence_ids' FROM g WHERE d % 5 < 2
      UNION ALL SELECT run_id, chunk, 'duplicate_id' FROM g WHERE chunk IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
      UNION ALL SELECT run_id, chunk, 'missing' FROM p ANTI JOIN c USING (run_id, chunk) UNION ALL SELECT run_id, chunk, 'unknown' FROM c ANTI JOIN p USING (run_id, chunk)""",
    "assembled_hashes": """SELECT doc_id // 10 AS run_id, CASE WHEN bool_and(doc_id % 77 > 0 AND text IS NOT NULL) THEN sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) END AS sha256 FROM documents GROUP BY 1""",
    "memory_faults": """WITH i AS (SELECT 'r' || user_id AS run_id, event_id AS e FROM events), p AS (SELECT DISTINCT run_id, 'p' || e % 300 AS passage_id FROM i),
      g AS (SELECT run_id, CASE WHEN e % 31 > 0 THEN 'p' || (e % 300 + CASE WHEN e % 23 = 0 THEN 300 ELSE 0 END) END AS passage_id, e % 4 > 0 AS done FROM i WHERE e % 9 > 0), c AS (SELECT DISTINCT run_id, passage_id FROM g WHERE passage_id IS NOT NULL)
      SELECT run_id, passage_id, 'missing_id' AS problem FROM g WHERE passage_id IS NULL UNION ALL SELECT run_id, passage_id, 'not_completed' FROM g WHERE NOT done
      UNION ALL SELECT run_id, passage_id, 'duplicate_id' FROM g WHERE passage_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1
      UNION ALL SELECT run_id, passage_id, 'missing' FROM p ANTI JOIN c USING (run_id, passage_id) UNION ALL SELECT run_id, passage_id, 'unknown' FROM c ANTI JOIN p USING (run_id, passage_id)""",
    "retrieval_faults": """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN concat_ws(',', CASE WHEN (event_id // 3) % 2 = 1 OR event_id % 5 = 0 THEN 'provenance' END, CASE WHEN event_id % 7 = 0 THEN 'results' END)
      WHEN (event_id // 3) % 2 = 0 OR event_id % 4 = 0 THEN 'not_applicable' ELSE '' END AS problems FROM events""",
    "matching_faults": f"""WITH i AS (SELECT 'r' || user_id AS run_id, event_id AS e, 'occ-' || event_id AS id, {_list(ENDS)}[(event_id // 2) % 6 + 1] AS s FROM events),
      g AS (SELECT *, id || CASE WHEN e % 23 = 0 THEN 'x' ELSE '' END AS occurrence_id FROM i WHERE e % 19 > 0)
      SELECT run_id, occurrence_id, 'no_evidence' AS problem FROM g WHERE e % 2 = 0 AND s = 'applied' AND e % 4 = 0
      UNION ALL SELECT run_id, occurrence_id, 'no_mismatch' FROM g WHERE s = 'not_applicable' AND e % 3 <> 1
      UNION ALL SELECT run_id, id, 'missing' FROM i WHERE e % 19 = 0 OR e % 23 = 0 UNION ALL SELECT run_id, occurrence_id, 'unknown' FROM g WHERE e % 23 = 0
      UNION ALL SELECT run_id, id, 'stale_term' FROM g WHERE e % 23 > 0 AND e % 10 = 0 UNION ALL SELECT run_id, id, 'stale_line' FROM g WHERE e % 23 > 0 AND e % 14 = 0 AND e % 6 > 0""",
    "review_faults": f"""WITH f AS (SELECT doc_id AS d, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
      w AS (SELECT *, CASE WHEN d % 5 = 0 THEN '{P.MISSING_ORIGINALS[0]}' WHEN d % 5 = 1 THEN '' ELSE lines[1] END AS o, d % 3 >= 1 AND d % 3 <= len(lines) AS in0, d % 4 >= 1 AND d % 4 + 1 <= len(lines) AS in1 FROM f),
      v AS (SELECT *, d % 5 = 0 OR contains(array_to_string(lines[1:d % 3], chr(10)), o) AS v0, d % 5 = 0 OR contains(array_to_string(lines[d % 4:d % 4 + 1], chr(10)), o) AS v1 FROM w)
      SELECT d AS doc_id, concat_ws(',', CASE WHEN d % 2 = 1 THEN 'category' END, CASE WHEN trim(o) = '' OR d % 7 = 0 THEN 'fields' END, CASE WHEN d % 11 = 0 THEN 'locations' END,
        CASE WHEN d % 11 > 0 AND NOT in0 THEN 'locations[0]:outside_source' WHEN d % 11 > 0 AND NOT v0 THEN 'locations[0]:not_verbatim' END,
        CASE WHEN d % 11 > 0 AND NOT in1 THEN 'locations[1]:outside_source' WHEN d % 11 > 0 THEN nullif(concat_ws(',', CASE WHEN d % 2 = 0 AND d % 4 + 1 > 2 THEN 'locations[1]:outside_core' END, CASE WHEN NOT v1 THEN 'locations[1]:not_verbatim' END), '') END) AS problems
      FROM v""",
    # every passage takes 21 characters, every claim 4 but the last
    "semantic_jobs": """WITH p AS (SELECT 'r' || user_id AS run_id, lpad(event_id::VARCHAR, 12, '0') AS passage_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events),
      c AS (SELECT 'r' || user_id AS run_id, event_type AS origin, count(*) AS claims FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2),
      j AS (SELECT r.run_id, origin, coalesce(claims, 0) AS claims, (100000 - 26 - greatest(4 * coalesce(claims, 0) - 1, 0) + 1) // 21 AS size FROM (SELECT DISTINCT run_id FROM p) r LEFT JOIN c USING (run_id)),
      b AS (SELECT run_id, origin, claims, place // size AS batch, count(*) AS passages, min(passage_id) AS "first" FROM j JOIN p USING (run_id) GROUP BY ALL)
      SELECT run_id, 'reference:semantic:' || lpad(k::VARCHAR, greatest(3, length(k::VARCHAR))::INT, '0') AS cell_id, CASE WHEN claims > 0 THEN 'semantic-routing' ELSE 'facts-only' END AS dimension, origin, claims, passages, "first", g = 1 AS collects_facts, true AS fits
      FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY origin, batch) AS k, dense_rank() OVER (PARTITION BY run_id ORDER BY origin) AS g FROM b)""",
    "reducer_cells": f"""WITH s0 AS (SELECT user_id AS doc_id, count(*) AS n0 FROM events GROUP BY 1), s AS (SELECT doc_id, n0, (n0 + 3) // 4 AS n1, (n0 + 15) // 16 AS n2, (n0 + 63) // 64 AS n3 FROM s0),
      l AS (SELECT doc_id, 1 AS depth, n0 AS below, n1 AS cells, n3 FROM s UNION ALL SELECT doc_id, 2, n1, n2, n3 FROM s WHERE n1 > 1 UNION ALL SELECT doc_id, 3, n2, n3, n3 FROM s WHERE n2 > 1),
      b AS (SELECT *, unnest(range(1, cells + 1)) AS batch FROM l)
      SELECT doc_id, depth, batch, 'global:reduce:d' || depth || ':b' || lpad(batch::VARCHAR, greatest(3, length(batch::VARCHAR))::INT, '0') AS output_id, batch * 4 - 3 AS "first", least(batch * 4, below) AS "last",
        (least(batch * 4, below) - batch * 4 + 4) * {P.PAYLOAD_CHARS} AS budget, CASE WHEN depth = 3 AND n3 > 1 THEN 'not_converged' END AS problem FROM b""",
    "final_cells": """SELECT event_id::VARCHAR AS run_id, 'reference:coverage' AS cell_id, 'reference-coverage' AS dimension, event_id % 7 AS claims, event_id % 5 AS facts, event_id % 3 AS candidates FROM events
      UNION ALL SELECT event_id::VARCHAR, 'reference:adjudication', 'reference-adjudication', event_id % 7, event_id % 5, event_id % 3 FROM events WHERE event_id % 3 > 0""",
    "node_faults": f"""WITH {_PLACED} SELECT doc_id, 'n' || k AS node_id, 'unit' AS problem FROM nodes WHERE n % 7 > 0 AND k = 9 UNION ALL SELECT doc_id, 'n' || k, 'table' FROM nodes WHERE type = 'table' AND k % 3 = 0
      UNION ALL SELECT doc_id, 'n' || k, 'asset' FROM nodes WHERE type = 'image' AND k % 4 = 0""",
    "placement_faults": f"""WITH {_PLACED} SELECT p.doc_id, unit_id, occurrence, 'unit' AS problem FROM placed p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = p.doc_id AND d.k = p.k % 5)
      UNION ALL SELECT doc_id, unit_id, occurrence, 'asset' FROM placed WHERE k % 4 = 0 UNION ALL SELECT doc_id, unit_id, occurrence, 'occurrence' FROM placed WHERE occurrence < 1
      UNION ALL SELECT doc_id, unit_id, occurrence, 'placement' FROM placed WHERE placement = 'lost'
      UNION ALL SELECT doc_id, unit_id, occurrence, 'node' FROM placed WHERE placement = 'resolved' AND (node IS NULL OR node >= 20) OR placement = 'unresolved' AND node IS NOT NULL
      UNION ALL SELECT doc_id, unit_id, occurrence, 'repeated' FROM placed GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "document_faults": f"""WITH s AS (SELECT doc_id AS d, {_list((*P.QUALITIES, "good"))}[doc_id % 4 + 1] AS status, ['complete', 'partial', 'complete_with_warnings'][doc_id % 3 + 1] AS state FROM documents)
      SELECT d AS doc_id, 'status' AS problem FROM s WHERE status = 'good' UNION ALL SELECT d, 'no_content' FROM s WHERE d % 7 = 0 OR d % 3 = 1 UNION ALL SELECT d, 'document_id' FROM s WHERE d % 5 = 0
      UNION ALL SELECT d, 'warnings' FROM s WHERE status <> state""",
    "formulas": r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 4 = 0 THEN '$$' || chr(10) || props || chr(10) || '$$' ELSE '$' || props || '$' END AS text FROM events""",
    "runner_outputs": """SELECT event_id, [NULL, 'abi', 'status', 'exit_code', 'data', 'issues', 'missing:exit_code,issues', 'command', 'not_an_object', 'not_json', 'not_one_line', 'not_one_line'][event_id % 12 + 1] AS problem FROM events""",
}
