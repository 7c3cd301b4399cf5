"""Queries over the life of review cells, over names of parts and formats, and over bodies of documents; runs are derived from the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.markup import convert_script, html_markdown, plain_key
from folioquery.operators import lifecycle as L
from folioquery.operators import projection as P
from folioquery.plans.canonical import _NODES, _nodes
from folioquery.sources.tables import read

STAGES = ("claim", "semantic", "local", "global")
STATUSES = ("accepted", "split", "dispatched", "failed", "accepted")
PROMPTS = [("claim", "Find claims."), ("semantic", "Compare."), ("local", "Review.")]
#: Words that a test conversion changes.
SCRIPT = {"the": "之", "there": "彼", "version": "版"}


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells of runs; every user is a run."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), "user_id").alias("run_id"), "event_id", F.concat(F.lit("c-"), (e % 997).cast("string")).alias("cell_id"), _pick(STAGES, e).alias("stage"),
        _pick(STATUSES, F.col("user_id") * 7 + F.when(F.col("user_id") % 3 == 0, 0).otherwise(e)).alias("status"), (e % 6 > 0).alias("required"), F.col("props").alias("input"),
        F.array(F.col("event_type"), F.lit('a"b')).alias("checks"),
    )


def created_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = L.create_cells(_run(spark, sf_dir).select("run_id", "cell_id", "checks", "input"))
    return made.select("run_id", "cell_id", "input_hash", "status", "duplicate")


def ready_task_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _run(spark, sf_dir).withColumn("cell_id", F.concat("cell_id", F.lit("-"), "event_id"))
    tasks = L.ready_tasks(cells, cells.where("event_id % 11 > 0"), spark.createDataFrame(PROMPTS, "stage string, prompt string"))
    return tasks.groupBy("stage").agg(F.count(F.lit(1)).alias("tasks"), F.count("prompt").alias("prompts"), F.min("prompt").alias("first"), F.max("prompt").alias("last"))


def passage_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = _run(spark, sf_dir).select("run_id", F.concat(F.lit("ref-"), (F.col("event_id") % 5).cast("string")).alias("reference"), F.col("event_id").alias("ordinal"), F.concat(F.lit("p"), (F.col("event_id") % 13).cast("string")).alias("passage_id"))
    return L.passage_map(passages)


def attempt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = _run(spark, sf_dir).select("run_id", F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("cell_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 4 == 0).alias("valid"))
    return L.attempt_status(attempts)


def reference_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _run(spark, sf_dir).where("user_id % 4 < 3 OR stage <> 'semantic'")
    runs = read(spark, sf_dir, "events").select("user_id").distinct()
    runs = runs.select(F.concat(F.lit("r"), "user_id").alias("run_id"), (F.col("user_id") % 9).alias("references"), (F.col("user_id") % 2 == 0).alias("semantic_scheduled"), (F.col("user_id") % 10 == 4).alias("final_scheduled"))
    return L.reference_step(cells, runs)


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved states, and what loading them says after every fifth run has a cell changed and every seventh is gone."""
    cells = _run(spark, sf_dir)
    saved = L.saved_states(cells)
    number = F.substring("run_id", 2, 20).cast("long")
    status = F.when((number % 5 == 0) & (F.col("status") == "accepted"), "pending").otherwise(F.col("status"))
    loaded = L.loaded_states(cells.where(number % 7 > 0).withColumn("status", status), saved)
    return saved.join(loaded, "run_id")


def manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    entries = docs.select(F.col("source").alias("run_id"), F.when(F.col("doc_id") % 3 == 0, "reference").otherwise("chunk").alias("kind"), F.col("doc_id").cast("string").alias("name"), F.sha2("text", 256).alias("sha256"))
    texts = docs.where("doc_id % 13 > 0").select(F.col("source").alias("run_id"), F.col("doc_id").cast("string").alias("name"), F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return L.manifest_errors(entries, texts)


def strict_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    runs = read(spark, sf_dir, "documents").select(
        d.cast("string").alias("run_id"), F.col("source").alias("source_sha256"), F.col("n_chars").alias("occurrences"), F.when(d % 5 > 0, "pass").alias("status"),
        F.when(d % 7 == 0, "x").otherwise(d.cast("string")).alias("report_run_id"), F.col("source").alias("report_source_sha256"), (F.col("n_chars") + (d % 11 == 0).cast("int")).alias("report_occurrences"),
        text.alias("translation_sha256"), F.when(d % 13 == 0, "x").otherwise(text).alias("report_translation_sha256"), F.when(d % 17 == 0, None).otherwise(text).alias("assembled_sha256"),
    )
    return L.strict_problems(runs).select("run_id", F.array_join("problems", ",").alias("problems"))


def older_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.when(e % 3 > 0, e % 50).alias("line"), F.when(e % 4 == 0, "").when(e % 4 < 3, F.col("event_type")).alias("quote"), F.when(e % 5 > 1, F.col("props")).alias("suggestion"),
        F.when(e % 6 == 0, F.lit("change")).alias("change"), F.lit("").alias("reason"), F.when(e % 7 > 0, F.lit("issue")).alias("issue"),
    )
    out = L.normalised_findings(rows, "en")
    return out.select("event_id", F.size("locations").alias("locations"), F.get("locations", F.lit(0))["end_line"].alias("end_line"), "original_text", "revised_text", "change", "reason")


def part_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of packages in the order in which their images count."""
    from pyspark.sql import Window

    folder = F.element_at(F.array(*map(F.lit, ("ppt/slides/slide", "word/header", "docProps/thumb", "xl/drawings/drawing", "word/endnotes"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat(folder, (F.col("p_partkey") % 120).cast("string"), F.lit(".xml")).alias("part"))
    return part.select("p_partkey", "part", F.row_number().over(Window.partitionBy("p_brand").orderBy(P.part_order(F.col("part")), "p_partkey")).alias("place"))


def locator_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    locator = F.map_from_arrays(F.array(*map(F.lit, ("page", "ocr_version", "bbox", "extraction_method"))), F.array((F.col("event_id") % 9).cast("string"), F.col("event_type"), F.col("props"), F.lit("ocr")))
    kept = read(spark, sf_dir, "events").select("event_id", P.locator_identity(locator).alias("l"))
    return kept.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries("l"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("identity"))


def pdf_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pdf_argument(P.pdf_properties(spark))


def format_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = _pick(("md, PDF", "markdown,pdf,md", "", "pdf", "docx,md,pdf", " , "), F.col("doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id", value.alias("formats")).select("doc_id", "formats", P.formats_problem(F.col("formats")).alias("problem"))


def usable_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents some of whose lines are blanked, as nodes, with cells for every fourth."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(" ")).otherwise(F.col("text")).alias("text"))
    nodes = docs.select("doc_id", F.lit("n").alias("node_id"), _pick(("paragraph", "image", "table", "code"), F.floor(F.col("doc_id") / 2)).alias("type"), "text", _pick(("inspector", "ocr"), F.floor(F.col("doc_id") / 8)).alias("method"))
    cells = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("n").alias("node_id"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("x").alias("value"))
    both = P.usable_bodies(nodes, cells).withColumnRenamed("usable", "any_method")
    return both.join(P.usable_bodies(nodes, cells, ("inspector",)).withColumnRenamed("usable", "inspected"), "doc_id")


def body_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.body_digests(_nodes(spark, sf_dir).withColumn("type", F.when(F.col("ordinal") % 6 == 0, "image").otherwise(F.col("type"))))


def runtime_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_type", "props").distinct().select("event_type", "props", P.runtime_fingerprint({"runtime_mode": F.col("event_type"), "agent": F.col("props"), "validator": F.lit("v4")}).alias("fingerprint"))


def bundle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"), "page_id")
    expected = pages.select("path", (F.octet_length("content") + (F.col("page_id") % 7 == 0).cast("int")).alias("bytes"), F.when(F.col("page_id") % 5 == 0, "x").otherwise(F.upper(F.sha2("content", 256))).alias("sha256"))
    return P.verified_files(expected, pages.where("page_id % 11 > 0").select("path", "content"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as Markdown."""
    return read(spark, sf_dir, "pages").select("page_id", html_markdown("html").alias("text"))


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", plain_key("text").alias("key"))


def converted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", convert_script(SCRIPT)(F.col("text")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        created_cells, ready_task_prompts, passage_owners, attempt_status, reference_steps, run_states, manifest_faults, strict_problems, older_findings, part_order,
        locator_identities, pdf_arguments, format_problems, usable_bodies, body_digests, runtime_fingerprints, bundle_files, page_markdown, page_keys, converted_texts,
    )
}

_STAGES = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_STATUSES = "[" + ", ".join(f"'{s}'" for s in STATUSES) + "]"
_RUN = f"""run AS (
  SELECT 'r' || user_id AS run_id, user_id, event_id, 'c-' || event_id % 997 AS cell_id, {_STAGES}[event_id % 4 + 1] AS stage,
         {_STATUSES}[(user_id * 7 + CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id END) % 5 + 1] AS status, event_id % 6 > 0 AS required, props AS input, event_type FROM events
)"""
_PROMPTS = ", ".join(f"('{a}', '{b}')" for a, b in PROMPTS)
_PROPERTIES = ", ".join(f"('{f}', '{n}', '{v}')" for f, own in P.FAMILY_PROPERTIES.items() for n, v in {**P.PDF_PROPERTIES, **own}.items())

ORACLE_SQL = {
    "created_cells": f"""WITH {_RUN} SELECT run_id, cell_id, sha256('{{"checks":["' || event_type || '","a\\"b"],"id":"' || cell_id || '","input":' || input || '}}') AS input_hash, 'pending' AS status,
      count(*) OVER (PARTITION BY run_id, cell_id) > 1 AS duplicate FROM run""",
    "ready_task_prompts": f"""WITH {_RUN}, heads(stage, prompt) AS (VALUES {_PROMPTS}),
      tasks AS (SELECT r.stage, CASE WHEN event_id % 11 > 0 THEN h.prompt || chr(10) || chr(10) || 'INPUT (untrusted document data):' || chr(10) || input END AS prompt FROM run r LEFT JOIN heads h USING (stage) WHERE status = 'dispatched')
      SELECT stage, count(*) AS tasks, count(prompt) AS prompts, min(prompt) AS "first", max(prompt) AS "last" FROM tasks GROUP BY stage""",
    "passage_owners": """WITH p AS (SELECT 'r' || user_id AS run_id, 'ref-' || event_id % 5 AS reference, event_id AS ordinal, 'p' || event_id % 13 AS passage_id FROM events)
      SELECT run_id, passage_id, reference, ordinal FROM p QUALIFY row_number() OVER (PARTITION BY run_id, passage_id ORDER BY reference DESC, ordinal DESC) = 1""",
    "attempt_status": """WITH a AS (SELECT 'r' || user_id AS run_id, 'c' || event_id % 7 AS cell_id, event_id % 4 = 0 AS valid, row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS k FROM events),
      s AS (SELECT run_id, cell_id, min(k) FILTER (WHERE valid AND k <= 3) AS hit, count(*) AS n FROM a GROUP BY 1, 2)
      SELECT run_id, cell_id, coalesce(hit, least(n, 3))::INT AS attempts, CASE WHEN hit IS NOT NULL THEN 'accepted' WHEN n >= 3 THEN 'failed' ELSE 'pending' END AS status FROM s""",
    "reference_steps": f"""WITH {_RUN}, c AS (SELECT user_id, count(*) FILTER (WHERE stage = 'claim' AND status NOT IN ('accepted', 'split')) AS a, count(*) FILTER (WHERE stage = 'claim' AND required AND status <> 'accepted') AS b,
        count(*) FILTER (WHERE stage = 'semantic') AS s, count(*) FILTER (WHERE stage = 'semantic' AND status <> 'accepted') AS o, count(*) FILTER (WHERE stage = 'semantic' AND status = 'failed') AS f
        FROM run WHERE user_id % 4 < 3 OR stage <> 'semantic' GROUP BY user_id),
      r AS (SELECT DISTINCT user_id FROM events)
      SELECT 'r' || user_id AS run_id, CASE WHEN user_id % 9 = 0 THEN NULL WHEN user_id % 2 = 1 THEN CASE WHEN coalesce(a, 0) = 0 AND coalesce(b, 0) = 0 THEN 'schedule_semantic' END
        WHEN user_id % 10 = 4 OR coalesce(s, 0) = 0 THEN NULL WHEN o = 0 THEN 'schedule_final' WHEN f > 0 THEN 'mark_incomplete' END AS step FROM r LEFT JOIN c USING (user_id)""",
    "run_states": f"""WITH {_RUN}, s AS (SELECT run_id, any_value(user_id) AS u, count(*)::INT AS cells, sha256(array_to_string(list_sort(list(cell_id || chr(9) || stage || chr(9) || status)), chr(10))) AS state_hash, bool_or(status = 'accepted') AS has_accepted FROM run GROUP BY run_id)
      SELECT run_id, cells, state_hash, CASE WHEN u % 7 = 0 THEN 'missing' WHEN u % 5 = 0 AND has_accepted THEN 'changed' END AS problem FROM s""",
    "manifest_faults": """SELECT source AS run_id, CASE WHEN doc_id % 3 = 0 THEN 'reference' ELSE 'chunk' END AS kind, doc_id::VARCHAR AS name, CASE WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'hash_changed' END AS error
      FROM documents WHERE doc_id % 13 = 0 OR doc_id % 11 = 0""",
    "strict_problems": """SELECT doc_id::VARCHAR AS run_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'coverage_failed' END, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR source IS NULL OR n_chars IS NULL THEN 'report_unbound' END,
      CASE WHEN doc_id % 13 = 0 THEN 'translation_unbound' END, CASE WHEN doc_id % 17 = 0 THEN 'assembly_differs' END) AS problems FROM documents""",
    "older_findings": f"""WITH f AS (SELECT event_id, CASE WHEN event_id % 5 > 1 THEN props ELSE '{L.MISSING_SUGGESTION["en"]}' END AS s, event_type FROM events)
      SELECT event_id, (event_id % 3 > 0)::INT AS locations, CASE WHEN event_id % 3 > 0 THEN event_id % 50 END AS end_line, CASE WHEN event_id % 4 IN (1, 2) THEN event_type ELSE '{L.MISSING_QUOTE["en"]}' END AS original_text,
        s AS revised_text, CASE WHEN event_id % 6 = 0 THEN 'change' ELSE s END AS change, CASE WHEN event_id % 7 > 0 THEN 'issue' ELSE 'Review finding' END AS reason FROM f""",
    "part_order": """WITH p AS (SELECT p_partkey, p_brand, p_partkey % 5 AS k, p_partkey % 120 AS n, ['ppt/slides/slide', 'word/header', 'docProps/thumb', 'xl/drawings/drawing', 'word/endnotes'][p_partkey % 5 + 1] AS folder FROM part)
      SELECT p_partkey, folder || n || '.xml' AS part, row_number() OVER (PARTITION BY p_brand ORDER BY CASE k WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 2 THEN 2 ELSE 1 END, lower(folder), n, p_partkey) AS place FROM p""",
    "locator_identities": "SELECT event_id, 'bbox=' || props || ';page=' || event_id % 9 AS identity FROM events",
    "pdf_arguments": f"""WITH s(family, name, value) AS (VALUES {_PROPERTIES})
      SELECT family, 'pdf:' || family || '_pdf_Export:{{' || string_agg('"' || name || '":{{"type":"' || CASE WHEN value IN ('true', 'false') THEN 'boolean' ELSE 'long' END || '","value":"' || value || '"}}', ',' ORDER BY name) || '}}' AS argument FROM s GROUP BY family""",
    "format_problems": """SELECT doc_id, ['md, PDF', 'markdown,pdf,md', '', 'pdf', 'docx,md,pdf', ' , '][doc_id % 6 + 1] AS formats, CASE WHEN doc_id % 6 IN (3, 4) THEN 'formats' END AS problem FROM documents""",
    "usable_bodies": """WITH d AS (SELECT doc_id, (doc_id // 2) % 4 AS k, (doc_id // 8) % 2 = 0 AS inspector, doc_id % 2 = 1 AND trim(coalesce(text, '')) <> '' AS filled FROM documents),
      u AS (SELECT *, k IN (0, 3) AND filled OR k = 2 AND doc_id % 4 = 0 AND doc_id % 3 <> 0 AS usable FROM d)
      SELECT doc_id, usable AS any_method, usable AND inspector AS inspected FROM u""",
    "body_digests": _NODES + "SELECT doc_id, sha256(string_agg(type || chr(9) || coalesce(text, ''), chr(10) ORDER BY ordinal)) AS digest FROM nodes WHERE ordinal % 6 <> 0 AND type <> 'image' GROUP BY doc_id",
    "runtime_fingerprints": """SELECT DISTINCT event_type, props, sha256('{"agent":"' || replace(props, '"', '\\"') || '","runtime_mode":"' || event_type || '","validator":"v4"}') AS fingerprint FROM events""",
    "bundle_files": """SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'size' WHEN page_id % 5 = 0 THEN 'hash' END AS problem FROM pages""",
    # the texts have no addresses, code or placeholders
    "converted_texts": "SELECT doc_id, replace(replace(replace(text, 'version', '版'), 'there', '彼'), 'the', '之') AS text FROM documents",
    "page_keys": r"SELECT doc_id, replace(lower(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss') AS key FROM documents",
}
