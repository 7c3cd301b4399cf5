"""Queries over stage state, artifacts, pages and reviewed evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.functions.text import PIECE, bare_signature, every_piece, page_pieces, page_span, target_present, unified_diff
from folioquery.operators import runs as R
from folioquery.operators import terms as T
from folioquery.sources.tables import read

STAGES = ("AIR", "FOB", "MAIL")


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs, their line items as stages."""
    items = read(spark, sf_dir, "lineitem")
    state = F.when(F.col("l_returnflag") == "R", "pending").when(F.col("l_quantity") > 48, "failed").otherwise("completed")
    return items.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("stage-"), "l_linenumber").alias("stage"), state.alias("state"))


def invalidated_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = _stages(spark, sf_dir)
    changed = stages.where("state = 'failed'").select("run_id", "ord")
    return R.invalidate_downstream(stages, changed).groupBy("ord", "state").agg(F.count(F.lit(1)).alias("stages"))


def resume_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.resume_points(_stages(spark, sf_dir))


def strict_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    flag = F.when(F.col("l_partkey") % 50 == 0, F.lit(None)).otherwise(F.col("l_linestatus"))
    artifacts = items.select(F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("expected"), flag.alias("actual"))
    return R.strictly_ready(_stages(spark, sf_dir), ["stage-1", "stage-2"], artifacts)


def stage_input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    artifacts = items.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("p"), "l_partkey").alias("name"), F.sha2(F.col("l_suppkey").cast("string"), 256).alias("sha256"))
    return R.input_hashes(artifacts.distinct())


def cache_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents published by the hash of their text into a cache that holds some of them."""
    docs = read(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.col("doc_id").alias("seq"), F.col("source").alias("value"))
    return R.publish(docs.where("seq % 5 = 0"), docs)


def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("stem"), "p_size")
    taken = part.select(F.when(F.col("p_size") == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.col("p_size") - 1)).alias("name")).distinct()
    return R.free_name(part.select("stem"), taken)


def target_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents of each language the targets of a glossary occur as words."""
    rows = [("t1", "l'été"), ("t2", "Être"), ("t3", "THE"), ("t4", "apache license"), ("t5", "中文")]
    terms = F.broadcast(spark.createDataFrame(rows, "term_id string, target string"))
    hits = read(spark, sf_dir, "documents").crossJoin(terms).where(target_present(F.col("target"), F.col("text")))
    return hits.groupBy("term_id", "lang").agg(F.count(F.lit(1)).alias("documents"))


def page_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the benchmark texts lie in the documents that share a piece of their visible signatures.

    A span needs the whole signature or windows of it that agree, and both hold a
    piece; the span of a pair that shares a piece without such proof is null.
    """
    quotes = read(spark, sf_dir, "benchmark").select("item_id", bare_signature("text").alias("page"))
    quotes = quotes.withColumn("pieces", page_pieces("page")).agg(
        F.collect_list(F.struct("item_id", "page", "pieces")).alias("quotes"), F.array_distinct(F.flatten(F.collect_list("pieces"))).alias("known")
    )
    docs = read(spark, sf_dir, "documents").select("doc_id", bare_signature("text").alias("whole"))
    met = docs.withColumn("pieces", every_piece("whole")).crossJoin(F.broadcast(quotes)).withColumn("shared", F.array_intersect("known", "pieces"))

    def near(quote: Column) -> Column:
        short = (quote["page"] != "") & F.col("whole").contains(quote["page"])
        return F.when(F.length(quote["page"]) < PIECE, short).otherwise(F.arrays_overlap(quote["pieces"], F.col("shared")))

    pairs = met.select("doc_id", "whole", F.explode(F.filter("quotes", near)).alias("quote"))
    spans = pairs.select("doc_id", "quote.item_id", page_span(F.col("whole"), F.col("quote.page")).alias("span"))
    return spans.select("doc_id", "item_id", "span.start", "span.end")


def unified_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of every document against itself with one word replaced everywhere."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", r"\b(the|de)\b", "XX").alias("other"))
    return docs.select("doc_id", F.sha2(unified_diff("text", "other"), 256).alias("sha256"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the pages, and the length of their text without tags."""
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.length(F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))).alias("chars"))


def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as quotes: how many documents of each source hold them word for word."""
    quotes = F.broadcast(read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")))
    held = read(spark, sf_dir, "documents").join(quotes, F.col("text").contains(F.col("quote")))
    return held.groupBy("item_id", "source").agg(F.count(F.lit(1)).alias("documents"))


def chunk_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items expected and delivered by order and line, by what is wrong with them."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    actual = items.where("l_quantity > 3").unionByName(items.where("l_quantity = 50"))
    return T.set_difference(items, actual, ["l_orderkey", "l_linenumber"]).groupBy("state").agg(F.count(F.lit(1)).alias("items"))


QUERIES = {
    f.__name__: f
    for f in (
        invalidated_stages, resume_points, strict_ready, stage_input_hashes, cache_publish, free_names, target_presence, page_alignment, unified_diffs,
        page_titles, evidence_quotes, chunk_set_equality,
    )
}

_STAGES = """WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS ord, 'stage-' || l_linenumber AS stage,
  CASE WHEN l_returnflag = 'R' THEN 'pending' WHEN l_quantity > 48 THEN 'failed' ELSE 'completed' END AS state FROM lineitem)"""

ORACLE_SQL = {
    "invalidated_stages": _STAGES
    + ", f AS (SELECT run_id, min(ord) AS cut FROM s WHERE state = 'failed' GROUP BY 1) SELECT ord, CASE WHEN ord >= cut THEN 'pending' ELSE state END AS state, count(*) AS stages FROM s LEFT JOIN f USING (run_id) GROUP BY 1, 2",
    "resume_points": _STAGES + " SELECT run_id, 'stage-' || min(ord) AS stage, min(ord) AS ord FROM s WHERE state <> 'completed' GROUP BY run_id",
    "strict_ready": _STAGES
    + """ SELECT run_id FROM s WHERE stage IN ('stage-1', 'stage-2') AND state = 'completed' AND run_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey % 50 = 0) GROUP BY run_id HAVING count(DISTINCT stage) = 2""",
    "stage_input_hashes": """WITH a AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS ord, 'p' || l_partkey || '=' || sha256(l_suppkey::VARCHAR) AS x FROM lineitem),
      g AS (SELECT run_id, ord, string_agg(x, ';' ORDER BY x) AS own FROM a GROUP BY 1, 2)
      SELECT run_id, ord, sha256(coalesce((SELECT string_agg(h.own, ';' ORDER BY h.ord) FROM g h WHERE h.run_id = g.run_id AND h.ord < g.ord), '')) AS input_hash FROM g""",
    "cache_publish": """WITH d AS (SELECT sha256(coalesce(text, '')) AS key, doc_id AS seq, source AS value FROM documents)
      SELECT key, min(seq) AS seq, arg_min(value, seq) AS value FROM d WHERE key NOT IN (SELECT key FROM d WHERE seq % 5 = 0) GROUP BY key""",
    "free_names": """WITH p AS (SELECT split_part(p_name, ' ', 1) AS stem, p_size - 1 AS n FROM part), t AS (SELECT DISTINCT stem, n FROM p),
      c AS (SELECT stem, unnest(range(0, max(n) + 2)) AS n FROM t GROUP BY stem), f AS (SELECT stem, min(n) AS n FROM c WHERE (stem, n) NOT IN (SELECT (stem, n) FROM t) GROUP BY stem)
      SELECT stem, CASE WHEN n = 0 THEN stem ELSE stem || '_' || n END AS name FROM f""",
    "target_presence": r"""WITH t(term_id, target) AS (VALUES ('t1', 'l''ete'), ('t2', 'etre'), ('t3', 'the'), ('t4', 'apache license'))
      SELECT term_id, lang, count(*) AS documents FROM documents CROSS JOIN t WHERE regexp_matches(strip_accents(lower(text)), '(^|[^\p{L}\p{N}_])' || target || '($|[^\p{L}\p{N}_])') GROUP BY 1, 2""",
    "page_titles": r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
      length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS chars FROM pages""",
    "evidence_quotes": "SELECT item_id, source, count(*) AS documents FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1, 2",
    "chunk_set_equality": """WITH w AS (SELECT l_orderkey, l_linenumber, count(*) AS wanted FROM lineitem GROUP BY 1, 2),
      a AS (SELECT l_orderkey, l_linenumber, sum(1 + (l_quantity = 50)::INT) AS found FROM lineitem WHERE l_quantity > 3 GROUP BY 1, 2)
      SELECT CASE WHEN found IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unknown' WHEN found > 1 THEN 'duplicate' ELSE 'ok' END AS state, count(*) AS items FROM w FULL JOIN a USING (l_orderkey, l_linenumber) GROUP BY 1""",
}
