"""Queries over canonical nodes, tables, references and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import align as A
from folioquery.operators import canonical as C
from folioquery.operators.blocks import BLOCKS_SQL
from folioquery.sources.tables import CONVERSATION_MARKDOWN_SQL, markdown, read

CELL, MARGIN = 0.5, 0.01


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nodes(markdown(spark, sf_dir))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).withColumn("text", F.sha2("text", 256))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cells(_nodes(spark, sf_dir)).groupBy("doc_id", "row", "col").agg(F.count(F.lit(1)).alias("cells"), F.min("value").alias("least"), F.max("value").alias("most"))


def render_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region as a pipe table; every other region has headers for its first row, the others too few."""
    nations = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = F.transform("n", lambda x: F.array(x["n_nationkey"].cast("string"), F.concat(x["n_name"], F.lit("|x"))))
    headers = F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("key"), F.lit("name"))).otherwise(F.array(F.lit("key")))
    return nations.select("n_regionkey", C.render_table(headers, rows).alias("table"))


def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = C.render(_nodes(spark, sf_dir))
    head = C.frontmatter(F.concat(F.lit('Talk "'), "doc_id", F.lit('"')), F.lit("2024-05-01T00:00:00Z"))
    return rendered.select("doc_id", F.length("text").alias("chars"), F.sha2(F.concat(head, "text"), 256).alias("sha256"))


def warning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.warnings(_nodes(spark, sf_dir))
    return found.groupBy("code", "content_loss").agg(F.count(F.lit(1)).alias("warnings"), F.countDistinct("doc_id").alias("documents"))


def quality_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown(spark, sf_dir)
    return C.quality(docs, C.warnings(C.nodes(docs)))


def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references of line items to orders, parts, suppliers, and of orders to customers above 100."""
    items = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders")
    checks = {
        "order": C.dangling(items.select("l_orderkey"), "l_orderkey", orders.where("o_orderkey % 10 <> 3"), "o_orderkey"),
        "part": C.dangling(items.select("l_partkey"), "l_partkey", read(spark, sf_dir, "part"), "p_partkey"),
        "supplier": C.dangling(items.select("l_suppkey"), "l_suppkey", read(spark, sf_dir, "supplier"), "s_suppkey"),
        "customer": C.dangling(orders.select("o_custkey"), "o_custkey", read(spark, sf_dir, "customer").where("c_custkey > 100"), "c_custkey"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("dangling")).select(F.lit(name).alias("reference"), "dangling")
        out = one if out is None else out.unionByName(one)
    return out


def id_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hashes that several documents share."""
    return C.repeated_ids(read(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("document_id")), "document_id")


def asset_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that customers of the first nations should have and have, by which side lacks them."""
    wanted = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("asset"))
    present = read(spark, sf_dir, "orders").where("o_custkey % 3 > 0").select(F.col("o_custkey").alias("asset")).distinct()
    both = wanted.withColumn("w", F.lit(1)).join(present.withColumn("p", F.lit(1)), "asset", "full")
    side = F.when(F.col("p").isNull(), "missing").when(F.col("w").isNull(), "unexpected").otherwise("equal")
    return both.groupBy(side.alias("state")).agg(F.count(F.lit(1)).alias("assets"))


def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.consecutive_runs(read(spark, sf_dir, "documents"), ["lang"], "doc_id")
    return runs.select("lang", "first", "last", "n", A.range_text(F.col("first"), F.col("last")).alias("range"))


def neighbor_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest user turns around each turn."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return A.neighbours(turns, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")))


def occurrence_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th event of a user with the k-th order of the customer of that number."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id")
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return A.pair_by_rank(events, orders, "key", "event_id", "o_orderkey")


def quote_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a benchmark text lies in a document that holds it once."""
    quotes = F.broadcast(read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")))
    pairs = read(spark, sf_dir, "documents").join(quotes, F.col("text").contains(F.col("quote")))
    return pairs.select("doc_id", "item_id", A.unique_position(F.col("text"), F.col("quote")).alias("position"))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    return read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("page"), F.col("vec_id").alias("id"), F.least(e[0], e[2]).alias("x0"), F.least(e[1], e[3]).alias("y0"), F.greatest(e[0], e[2]).alias("x1"), F.greatest(e[1], e[3]).alias("y1")
    )


def spatial_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overlaps(_boxes(spark, sf_dir), "page", CELL, MARGIN)


def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bounding_boxes(_boxes(spark, sf_dir), "page")


QUERIES = {
    f.__name__: f
    for f in (
        document_nodes, table_cells, render_tables, render_documents, warning_summary, quality_status, ref_integrity, id_uniqueness, asset_set_equality,
        consecutive_runs, neighbor_anchors, occurrence_reconcile, quote_positions, spatial_overlap, page_bounds,
    )
}

_NODES = (
    "WITH RECURSIVE " + CONVERSATION_MARKDOWN_SQL + "," + BLOCKS_SQL + r""",
line_rows AS (
  SELECT i.doc_id, i.i, i.block_no, b.kind, l.lines[i.i] AS line, b.kind = 'prose' AND regexp_matches(l.lines[i.i], '^#{1,6}\s+') AS heading,
         b.kind = 'prose' AND regexp_matches(l.lines[i.i], '^\s*([-*+]|\d{1,9}[.)])\s+') AS item
  FROM islands i JOIN block_rows b USING (doc_id, block_no) JOIN line_list l USING (doc_id)
),
cut AS (
  SELECT *, CASE WHEN lag(block_no) OVER w IS DISTINCT FROM block_no OR heading OR item OR lag(heading) OVER w THEN 1 ELSE 0 END AS fresh FROM line_rows WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
parts AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM cut),
joined AS (
  SELECT doc_id, part, min(kind) AS kind, bool_or(heading) AS heading, bool_or(item) AS item, min(i) AS first, max(i) AS last, string_agg(line, chr(10) ORDER BY i) AS text FROM parts GROUP BY doc_id, part
),
node_rows AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS ordinal, CASE WHEN heading THEN 'heading' WHEN item THEN 'list_item' WHEN kind = 'prose' THEN 'paragraph' ELSE kind END AS type,
         CASE WHEN heading THEN length(regexp_extract(text, '^(#{1,6})', 1)) ELSE 0 END AS level, first, last, text
  FROM joined WHERE NOT (kind = 'prose' AND regexp_matches(text, '^\s*$'))
),
nodes AS (SELECT *, 'node-' || substr(sha256(doc_id || '|' || type || '|' || ordinal), 1, 16) AS node_id FROM node_rows),
warned AS (
  SELECT doc_id, node_id, unnest(list_filter([
    CASE WHEN type = 'code' AND (first = last OR NOT regexp_matches(string_split(text, chr(10))[-1], '^\s*(```|~~~)\s*$')) THEN 'open_fence' END,
    CASE WHEN type = 'table' AND NOT regexp_matches(text, '(?m)^\s*\|[^|\n]*\|[^|\n]+\|') THEN 'narrow_table' END,
    CASE WHEN type = 'heading' AND level > 3 THEN 'deep_heading' END], lambda x: x IS NOT NULL)) AS code FROM nodes
)
"""
)
_BOXES = """WITH b AS (SELECT label AS page, vec_id AS id, least(e[1], e[3]) AS x0, least(e[2], e[4]) AS y0, greatest(e[1], e[3]) AS x1, greatest(e[2], e[4]) AS y1
  FROM (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings))"""

ORACLE_SQL = {
    "document_nodes": _NODES + "SELECT doc_id, ordinal, type, level, first, last, sha256(text) AS text, node_id FROM nodes",
    "table_cells": _NODES
    + r""", t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*\|[\s:|-]*-[\s:|-]*$')) AS rows FROM nodes WHERE type = 'table'),
      r AS (SELECT doc_id, k - 1 AS row, string_split(regexp_replace(trim(rows[k]), '^\||\|$', '', 'g'), '|') AS vals FROM t, unnest(range(1, len(rows) + 1)) AS u(k))
      SELECT doc_id, row, c - 1 AS col, count(*) AS cells, min(trim(vals[c])) AS least, max(trim(vals[c])) AS most FROM r, unnest(range(1, len(vals) + 1)) AS u(c) GROUP BY 1, 2, 3""",
    "render_tables": r"""SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN '| key | name |' ELSE '|  |  |' END || chr(10) || '| --- | --- |' || chr(10)
      || string_agg('| ' || n_nationkey || ' | ' || n_name || '\|x |', chr(10) ORDER BY n_nationkey) FILTER (WHERE n_regionkey % 2 = 1 OR place > 1) AS "table"
      FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation) GROUP BY n_regionkey""",
    "render_documents": _NODES
    + r"""SELECT doc_id, length(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS chars,
      sha256('---' || chr(10) || 'type: ""' || chr(10) || 'title: "Talk \"' || doc_id || '\""' || chr(10) || 'description: ""' || chr(10) || 'tags: []' || chr(10) || 'timestamp: "2024-05-01T00:00:00Z"' || chr(10) || '---' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS sha256 FROM nodes GROUP BY doc_id""",
    "warning_summary": _NODES + "SELECT code, code = 'open_fence' AS content_loss, count(*) AS warnings, count(DISTINCT doc_id) AS documents FROM warned GROUP BY 1, 2",
    "quality_status": _NODES
    + "SELECT d.doc_id, CASE WHEN bool_or(code = 'open_fence') THEN 'partial' WHEN count(code) > 0 THEN 'complete_with_warnings' ELSE 'complete' END AS quality, count(code) AS warnings FROM md_docs d LEFT JOIN warned w USING (doc_id) GROUP BY d.doc_id",
    "ref_integrity": """SELECT 'order' AS reference, count(*) AS dangling FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)
      UNION ALL SELECT 'part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
      UNION ALL SELECT 'customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey > 100)""",
    "id_uniqueness": "SELECT sha256(coalesce(text, '')) AS document_id, count(*) AS rows FROM documents GROUP BY 1 HAVING count(*) > 1",
    "asset_set_equality": """SELECT CASE WHEN p IS NULL THEN 'missing' WHEN w IS NULL THEN 'unexpected' ELSE 'equal' END AS state, count(*) AS assets FROM
      (SELECT c_custkey AS w FROM customer WHERE c_custkey % 2 = 0) FULL JOIN (SELECT DISTINCT o_custkey AS p FROM orders WHERE o_custkey % 3 > 0) ON w = p GROUP BY 1""",
    "consecutive_runs": """WITH g AS (SELECT lang, doc_id, doc_id - row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS island FROM (SELECT DISTINCT lang, doc_id FROM documents))
      SELECT lang, min(doc_id) AS first, max(doc_id) AS last, count(*) AS n, CASE WHEN count(*) = 1 THEN min(doc_id)::VARCHAR ELSE min(doc_id) || '-' || max(doc_id) END AS range FROM g GROUP BY lang, island""",
    "neighbor_anchors": """SELECT c.conv_id, c.turn, c.role, (SELECT max(turn) FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn < c.turn AND b.role = 'user') AS before,
      (SELECT min(turn) FROM conversations b WHERE b.conv_id = c.conv_id AND b.turn > c.turn AND b.role = 'user') AS after FROM conversations c""",
    "occurrence_reconcile": """WITH a AS (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      b AS (SELECT o_custkey AS key, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT a.key, a.k, event_id, o_orderkey FROM a LEFT JOIN b USING (key, k)""",
    "quote_positions": """SELECT doc_id, item_id, CASE WHEN length(b.text) > 0 AND strpos(substr(d.text, strpos(d.text, b.text) + 1), b.text) = 0 THEN strpos(d.text, b.text) - 1 END AS position FROM documents d JOIN benchmark b ON contains(d.text, b.text)""",
    "spatial_overlap": _BOXES
    + f" SELECT a.page, a.id AS a, b.id AS b FROM b a JOIN b ON a.page = b.page AND a.id < b.id AND a.x0 <= b.x1 + {MARGIN}::DOUBLE AND b.x0 <= a.x1 + {MARGIN}::DOUBLE AND a.y0 <= b.y1 + {MARGIN}::DOUBLE AND b.y0 <= a.y1 + {MARGIN}::DOUBLE",
    "page_bounds": _BOXES + " SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS boxes FROM b GROUP BY page",
}
