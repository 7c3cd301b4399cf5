"""Queries over recognised spans, matching, package paths and protected text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.operators import blocks as B
from folioquery.operators import chain as C
from folioquery.operators import pages as P
from folioquery.sources.tables import read

LEAST_SCORE = 0.0


def recognised_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as recogniser output: four texts with scores and boxes of two to five numbers."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    source = read(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("e"))
    texts = F.array(*[F.when((F.col("vec_id") + k) % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("w"), F.col("vec_id") + k)) for k in range(4)])
    boxes = F.array(*[F.slice("e", 5 + k, (2 + (F.col("vec_id") + k) % 4).cast("int")) for k in range(4)])
    cleaned = source.select("vec_id", P.clean_spans(texts, F.slice("e", 1, 4), boxes, LEAST_SCORE).alias("c"))
    return cleaned.select("vec_id", F.size("c.spans").alias("spans"), "c.invalid", "c.weak", F.array_join(F.transform("c.spans", lambda s: s["text"]), " ").alias("text"))


def baseline_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as words on pages: lines of each brand's page by gaps between baselines."""
    part = read(spark, sf_dir, "part")
    items = part.select(
        F.col("p_brand").alias("page"), (F.col("p_partkey") % 100).cast("double").alias("x"), F.floor(F.col("p_retailprice") * 2).alias("y"), F.lit(1.0).alias("width"),
        (10 + F.col("p_size") % 3).cast("double").alias("height"), F.col("p_partkey").cast("string").alias("text"),
    )
    lines = P.line_texts(P.baseline_rows(items, ["page"]), ["page"])
    return lines.select("page", "line", "x0", "y0", "x1", "y1", F.length("text").alias("chars"))


def body_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents that hold a benchmark text, a query with a single line being unique."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    body = lines.select(F.concat_ws("-", "doc_id", "at").alias("node_id"), "text")
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return P.match_body(queries, body)


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets relative to the paths of all page URLs."""
    path = F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1)
    target = F.element_at(F.array(*[F.lit(t) for t in ("a/b.png", "../x.png", "../../../y", "/abs/z.png", "./q/../r", "")]), (F.col("page_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", P.resolve_path(path, target).alias("resolved"))


def sampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sampled = read(spark, sf_dir, "documents").select("doc_id", P.sample_offsets(F.length("text"), 160).alias("o"))
    return sampled.select("doc_id", F.size("o").alias("windows"), F.coalesce(F.aggregate("o", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("total"))


def insertion_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as pages: where the signature of each begins."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("signature"))
    return P.insertion_points(turns, "conv_id", "turn", "signature").select("conv_id", "turn", "position")


def replaced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans of each document replaced; in some documents they overlap."""
    docs = read(spark, sf_dir, "documents")
    first = F.struct(F.lit(3).alias("start"), F.when(F.col("doc_id") % 4 == 0, 12).otherwise(6).alias("end"), F.lit("[A]").alias("with"))
    second = F.struct(F.lit(10).alias("start"), F.lit(11).alias("end"), F.lit("[B]").alias("with"))
    return docs.select("doc_id", P.replace_spans(F.col("text"), F.array(second, first)).alias("text")).select("doc_id", F.sha2("text", 256).alias("sha256"))


def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protected spans of texts to which a URL and code are added, and whether they can be put back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see https://x.example/a?b=1 and `code x` or AB-12: "), F.coalesce("text", F.lit(""))).alias("text"))
    bound = docs.select("doc_id", B.let(F.struct(F.col("text").alias("t"), P.protect(F.col("text")).alias("p")), lambda s: F.struct(F.size(s["p"]["kept"]).alias("spans"), F.length(s["p"]["masked"]).alias("chars"), (P.restore(s["p"]["masked"], s["p"]["kept"]) == s["t"]).alias("restored"))).alias("r"))
    return bound.select("doc_id", "r.spans", "r.chars", "r.restored")


def chain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as matches between two sequences of each user: the weight on the heaviest increasing chain."""
    matches = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("page"), F.col("event_id").alias("left"), (F.floor("value") % 50).alias("right"), (F.col("event_id") % 7 + 1).cast("double").alias("weight")
    )
    return C.coverage(matches, C.page_chains(matches, ["page"]), ["page"])


QUERIES = {
    f.__name__: f for f in (chain_coverage, recognised_spans, baseline_lines, body_matches, resolved_paths, sampled_windows, insertion_points, replaced_spans, protected_spans)
}

_PROTECTED_SQL = r"```(?s:.*?)```|`[^`\n]+`|https?://[^\s<>()]+|\$[^$\n]+\$|\b[0-9a-f]{32,64}\b|(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/])+[\w.-]+|\b[A-Z]{2,}-\d+\b"

ORACLE_SQL = {
    "chain_coverage": """WITH RECURSIVE e AS (SELECT user_id AS page, floor(value)::BIGINT % 50 AS r, (event_id % 7 + 1)::DOUBLE AS w, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      walk AS (SELECT DISTINCT page, 0::BIGINT AS k, []::STRUCT(r BIGINT, b DOUBLE)[] AS s FROM e
        UNION ALL SELECT w.page, e.k, list_append(w.s, {'r': e.r, 'b': e.w + coalesce(list_max(list_transform(list_filter(w.s, lambda x: x.r < e.r), lambda x: x.b)), 0)}) FROM walk w JOIN e ON e.page = w.page AND e.k = w.k + 1),
      h AS (SELECT page, max(list_max(list_transform(s, lambda x: x.b))) AS held FROM walk WHERE k > 0 GROUP BY page), t AS (SELECT page, sum(w) AS total FROM e GROUP BY page)
      SELECT page, total, held, held / total >= 0.9 AS enough FROM t JOIN h USING (page)""",
    "recognised_spans": """WITH z AS (SELECT vec_id, k, CASE WHEN (vec_id + k) % 5 = 0 THEN ' ' ELSE 'w' || (vec_id + k) END AS text, round(embedding[k + 1]::DOUBLE, 6) AS score, 2 + (vec_id + k) % 4 AS sides FROM embeddings, unnest(range(0, 4)) AS t(k)),
      j AS (SELECT *, trim(text) = '' OR sides <> 4 AS bad FROM z)
      SELECT vec_id, count(*) FILTER (WHERE NOT bad AND score >= 0) AS spans, count(*) FILTER (WHERE bad) AS invalid, count(*) FILTER (WHERE NOT bad AND score < 0) AS weak,
        coalesce(string_agg(text, ' ' ORDER BY k) FILTER (WHERE NOT bad AND score >= 0), '') AS text FROM j GROUP BY vec_id""",
    "baseline_lines": """WITH i AS (SELECT p_brand AS page, (p_partkey % 100)::DOUBLE AS x, floor(p_retailprice * 2) AS y, (10 + p_size % 3)::DOUBLE AS height, p_partkey::VARCHAR AS text FROM part),
      m AS (SELECT page, median(height) AS h FROM i GROUP BY 1), s AS (SELECT *, (y - lag(y) OVER (PARTITION BY page ORDER BY y, x) > h * 0.3)::INT AS fresh FROM i JOIN m USING (page)),
      l AS (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY page ORDER BY y, x ROWS UNBOUNDED PRECEDING), 0) + 1 AS line FROM s)
      SELECT page, line, min(x) AS x0, min(y) AS y0, max(x + 1) AS x1, max(y + height) AS y1, sum(length(text)) + count(*) - 1 AS chars FROM l GROUP BY 1, 2""",
    "body_matches": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), b AS (SELECT doc_id || '-' || (k - 1) AS node_id, lines[k] AS text FROM l, unnest(range(1, len(lines) + 1)) AS t(k))
      SELECT q.item_id AS query_id, b.node_id, b.text = q.text AS exact FROM benchmark q JOIN b ON b.text = q.text OR (length(q.text) >= 12 AND contains(b.text, q.text))""",
    "resolved_paths": """WITH RECURSIVE p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS path, ['a/b.png', '../x.png', '../../../y', '/abs/z.png', './q/../r', ''][page_id % 6 + 1] AS target FROM pages),
      j AS (SELECT page_id, string_split(CASE WHEN starts_with(target, '/') THEN target ELSE regexp_replace(path, '[^/]*$', '') || target END, '/') AS parts FROM p),
      w AS (SELECT page_id, parts, 0 AS k, []::VARCHAR[] AS stack, false AS escaped FROM j
        UNION ALL SELECT page_id, parts, k + 1, CASE WHEN parts[k + 1] = '..' THEN CASE WHEN len(stack) > 0 THEN stack[:len(stack) - 1] ELSE stack END WHEN parts[k + 1] IN ('', '.') THEN stack ELSE list_append(stack, parts[k + 1]) END,
          escaped OR (parts[k + 1] = '..' AND len(stack) = 0) FROM w WHERE k < len(parts))
      SELECT page_id, CASE WHEN NOT escaped THEN array_to_string(stack, '/') END AS resolved FROM w WHERE k = len(parts)""",
    "sampled_windows": """WITH d AS (SELECT doc_id, greatest(coalesce(length(text), 0) - 160, 0) AS last, greatest(least(64, length(text) - 159), 1) AS n FROM documents),
      o AS (SELECT DISTINCT doc_id, round_even(k * last / greatest(n - 1, 1)::DOUBLE, 0)::BIGINT AS o FROM d, unnest(range(0, greatest(n, 0))) AS t(k))
      SELECT d.doc_id, count(o) AS windows, coalesce(sum(o), 0)::BIGINT AS total FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id""",
    "insertion_points": """SELECT conv_id, turn, coalesce(sum(length(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM conversations""",
    "replaced_spans": """SELECT doc_id, CASE WHEN doc_id % 4 > 0 AND length(text) >= 11 THEN sha256(substr(text, 1, 3) || '[A]' || substr(text, 7, 4) || '[B]' || substr(text, 12)) END AS sha256 FROM documents""",
    "protected_spans": f"""WITH t AS (SELECT doc_id, 'see https://x.example/a?b=1 and `code x` or AB-12: ' || coalesce(text, '') AS text FROM documents)
      SELECT doc_id, len(regexp_extract_all(text, '{_PROTECTED_SQL}')) AS spans, length(regexp_replace(text, '{_PROTECTED_SQL}', 'X', 'g')) AS chars, true AS restored FROM t""",
}
