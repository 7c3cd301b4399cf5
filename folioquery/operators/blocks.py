"""Lines, blocks, chunks and passages: all row by row over arrays, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FENCE = r"^\s*(```|~~~)"
BARE_FENCE = r"^\s*(```|~~~)\s*$"


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, even where it is used inside a lambda."""
    return F.transform(F.array(value), then)[0]


def lines_of(text: Column) -> Column:
    """The text split at newlines; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def fences_of(lines: Column) -> Column:
    """First and last line of each fenced block; an open one runs to the end.

    A fence opens at a line that starts with three backticks or tildes and closes
    at a later line that is nothing else but the same three. Only the lines that
    could be either are folded, so the state stays small.
    """
    candidates = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, FENCE, 1).alias("mark"), x.rlike(BARE_FENCE).alias("bare"))),
        lambda c: c["mark"] != "",
    )
    start = F.struct(F.lit("").alias("mark"), F.lit(0).alias("at"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("spans"))

    def fold(s: Column, c: Column) -> Column:
        closed = F.array_append(s["spans"], F.struct(s["at"].alias("first"), c["at"].alias("last")))
        opened = F.struct(c["mark"].alias("mark"), c["at"].alias("at"), s["spans"].alias("spans"))
        done = F.struct(F.lit("").alias("mark"), F.lit(0).alias("at"), closed.alias("spans"))
        return F.when(s["mark"] == "", opened).when(c["bare"] & (c["mark"] == s["mark"]), done).otherwise(s)

    def finish(s: Column) -> Column:
        rest = F.array_append(s["spans"], F.struct(s["at"].alias("first"), (F.size(lines) - 1).alias("last")))
        return F.when(s["mark"] == "", s["spans"]).otherwise(rest)

    return F.aggregate(candidates, start, fold, finish)


def kinds_of(lines: Column, fences: Column) -> Column:
    """A label for each line that is the same within a block: kind, and for fences and blank lines where it begins."""

    def kind(x: Column, i: Column) -> Column:
        span = F.filter(fences, lambda f: i.between(f["first"], f["last"]))
        return (
            F.when(F.size(span) > 0, F.concat(F.lit("code "), F.get(span, F.lit(0))["first"]))
            .when(F.ltrim(x).startswith("|"), F.lit("table"))
            .when(x.rlike(r"^\s*$"), F.concat(F.lit("prose "), i))
            .otherwise(F.lit("prose"))
        )

    return F.transform(lines, kind)


def blocks_of(lines: Column) -> Column:
    """struct(kind, first, last) of code, table and prose blocks that partition the lines.

    A blank line outside a fence is a prose block of its own.
    """

    def from_kinds(kinds: Column) -> Column:
        last = F.size(kinds) - 1
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(kinds, i) != F.get(kinds, i - 1)))

        def blocks(s: Column) -> Column:
            return F.transform(
                s,
                lambda at, k: F.struct(
                    F.split_part(F.get(kinds, at), F.lit(" "), F.lit(1)).alias("kind"),
                    at.alias("first"),
                    (F.coalesce(F.get(s, k + 1), last + 1) - 1).alias("last"),
                ),
            )

        return let(starts, blocks)

    return let(fences_of(lines), lambda fences: let(kinds_of(lines, fences), from_kinds))


def pack(sizes: Column, limit: int) -> Column:
    """Indices at which a new group starts when sizes are packed greedily up to a limit; a larger item stands alone."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("k"), F.expr("cast(array() as array<int>)").alias("starts"))

    def fold(s: Column, n: Column) -> Column:
        fresh = (s["k"] == 0) | (s["total"] + n > limit)
        return F.struct(
            F.when(fresh, n.cast("long")).otherwise(s["total"] + n).alias("total"),
            (s["k"] + 1).alias("k"),
            F.when(fresh, F.array_append(s["starts"], s["k"])).otherwise(s["starts"]).alias("starts"),
        )

    return F.aggregate(sizes, start, fold, lambda s: s["starts"])


def _groups(lines: Column, blocks: Column, limit: int) -> Column:
    """struct(start, end) of line numbers, from 1, of the packed blocks."""

    def spans(groups: Column) -> Column:
        return F.transform(
            groups,
            lambda g, k: F.struct(
                (F.get(blocks, g)["first"] + 1).alias("start"),
                (F.get(blocks, F.coalesce(F.get(groups, k + 1), F.size(blocks)) - 1)["last"] + 1).alias("end"),
            ),
        )

    return let(pack(F.transform(blocks, lambda b: b["last"] - b["first"] + 1), limit), spans)


def _with_spans(docs: DataFrame, id_col: str, spans) -> DataFrame:
    """(id, lines, at, span): one row for each span of line numbers of the text."""
    both = let(lines_of(F.col("text")), lambda x: F.struct(x.alias("lines"), spans(x).alias("spans")))
    ready = docs.select(id_col, both.alias("b"))
    return ready.select(id_col, F.col("b.lines").alias("lines"), F.posexplode("b.spans").alias("at", "span"))


def chunks(docs: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk, start, end, lines, oversized, text, sha256): whole blocks packed to at most ``limit`` lines."""
    each = _with_spans(docs, id_col, lambda lines: let(blocks_of(lines), lambda blocks: _groups(lines, blocks, limit)))
    n = F.col("span.end") - F.col("span.start") + 1
    out = each.select(
        id_col,
        (F.col("at") + 1).alias("chunk"),
        F.col("span.start").alias("start"),
        F.col("span.end").alias("end"),
        n.alias("lines"),
        (n > limit).alias("oversized"),
        F.array_join(F.slice("lines", F.col("span.start"), n), "\n").alias("text"),
    )
    return out.withColumn("sha256", F.sha2("text", 256))


def review_chunks(docs: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """Chunks after dropping one final newline, with the balance of fence lines in each."""
    out = chunks(docs.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\z", "")), limit, id_col)
    return out.withColumn("fence_lines", F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(FENCE))))


def passages(docs: DataFrame, max_chars: int, id_col: str = "doc_id") -> DataFrame:
    """Whole lines packed to at most ``max_chars`` characters, a newline counted with each; a longer line is an error row."""
    def spans(lines: Column) -> Column:
        return let(
            pack(F.transform(lines, lambda x: F.length(x) + 1), max_chars),
            lambda groups: F.transform(groups, lambda g, k: F.struct((g + 1).alias("start"), F.coalesce(F.get(groups, k + 1), F.size(lines)).alias("end"))),
        )

    each = _with_spans(docs, id_col, spans)
    text = F.array_join(F.slice("lines", F.col("span.start"), F.col("span.end") - F.col("span.start") + 1), "\n")
    return each.select(
        id_col, (F.col("at") + 1).alias("passage"), F.col("span.start").alias("start"), F.col("span.end").alias("end"), text.alias("text")
    ).withColumn("over_capacity", F.length("text") + 1 > max_chars)


def coverage(chunk_table: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Proof per document that its chunks have no gap and rebuild the text."""
    spans = chunk_table.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("chunk", "start", "end", "text"))).alias("c"), F.sum(F.col("end") - F.col("start") + 1).alias("covered")
    )
    inner = F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))
    gapless = F.forall(F.zip_with(inner, F.slice("c", 1, F.size("c")), lambda a, b: a["start"].isNull() | (a["start"] == b["end"] + 1)), lambda ok: ok)
    rebuilt = F.array_join(F.transform("c", lambda x: x["text"]), "\n")
    proof = spans.select(id_col, F.size("c").alias("chunks"), gapless.alias("gapless"), F.sha2(rebuilt, 256).alias("rebuilt"), "covered")
    return proof.join(docs.select(id_col, F.sha2(F.coalesce("text", F.lit("")), 256).alias("source")), id_col).select(
        id_col, "chunks", "covered", "gapless", (F.col("rebuilt") == F.col("source")).alias("equal")
    )


#: Blocks by walking the lines with a recursive query; needs ``md_docs(doc_id, text)``.
BLOCKS_SQL = """
line_list AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM md_docs),
walk AS (
  SELECT doc_id, 1 AS i, regexp_extract(lines[1], '^\\s*(```|~~~)', 1) AS open_mark,
         CASE WHEN regexp_matches(lines[1], '^\\s*(```|~~~)') THEN 'code 1' WHEN starts_with(ltrim(lines[1]), '|') THEN 'table'
              WHEN regexp_matches(lines[1], '^\\s*$') THEN 'prose 1' ELSE 'prose' END AS kind
  FROM line_list
  UNION ALL
  SELECT w.doc_id, w.i + 1,
         CASE WHEN w.open_mark <> '' AND regexp_matches(l.lines[w.i + 1], '^\\s*(```|~~~)\\s*$') AND regexp_extract(l.lines[w.i + 1], '^\\s*(```|~~~)', 1) = w.open_mark THEN ''
              WHEN w.open_mark <> '' THEN w.open_mark ELSE regexp_extract(l.lines[w.i + 1], '^\\s*(```|~~~)', 1) END,
         CASE WHEN w.open_mark <> '' THEN w.kind
              WHEN regexp_matches(l.lines[w.i + 1], '^\\s*(```|~~~)') THEN 'code ' || (w.i + 1)
              WHEN starts_with(ltrim(l.lines[w.i + 1]), '|') THEN 'table'
              WHEN regexp_matches(l.lines[w.i + 1], '^\\s*$') THEN 'prose ' || (w.i + 1) ELSE 'prose' END
  FROM walk w JOIN line_list l USING (doc_id) WHERE w.i < len(l.lines)
),
flagged AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS fresh FROM walk),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS block_no FROM flagged),
block_rows AS (
  SELECT doc_id, block_no, split_part(min(kind), ' ', 1) AS kind, min(i) AS first, max(i) AS last, count(*) AS n FROM islands GROUP BY doc_id, block_no
)
"""


def chunks_sql(limit: int) -> str:
    return f"""{BLOCKS_SQL},
packing AS (
  SELECT doc_id, block_no, n AS total, 1 AS chunk FROM block_rows WHERE block_no = 1
  UNION ALL
  SELECT b.doc_id, b.block_no, CASE WHEN p.total + b.n > {limit} THEN b.n ELSE p.total + b.n END, CASE WHEN p.total + b.n > {limit} THEN p.chunk + 1 ELSE p.chunk END
  FROM packing p JOIN block_rows b ON b.doc_id = p.doc_id AND b.block_no = p.block_no + 1
),
chunk_rows AS (
  SELECT doc_id, chunk, min(first) AS "start", max(last) AS "end", sum(n)::BIGINT AS lines, sum(n) > {limit} AS oversized
  FROM packing JOIN block_rows USING (doc_id, block_no) GROUP BY doc_id, chunk
),
chunk_texts AS (
  SELECT c.*, array_to_string(l.lines[c."start":c."end"], chr(10)) AS text FROM chunk_rows c JOIN line_list l USING (doc_id)
)
"""


def passages_sql(max_chars: int) -> str:
    return f"""
line_list AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
packing AS (
  SELECT doc_id, 1 AS i, length(lines[1]) + 1 AS total, 1 AS passage FROM line_list
  UNION ALL
  SELECT p.doc_id, p.i + 1, CASE WHEN p.total + length(l.lines[p.i + 1]) + 1 > {max_chars} THEN length(l.lines[p.i + 1]) + 1 ELSE p.total + length(l.lines[p.i + 1]) + 1 END,
         CASE WHEN p.total + length(l.lines[p.i + 1]) + 1 > {max_chars} THEN p.passage + 1 ELSE p.passage END
  FROM packing p JOIN line_list l USING (doc_id) WHERE p.i < len(l.lines)
),
passage_rows AS (SELECT doc_id, passage, min(i) AS "start", max(i) AS "end" FROM packing GROUP BY doc_id, passage),
passage_texts AS (SELECT p.*, array_to_string(l.lines[p."start":p."end"], chr(10)) AS text FROM passage_rows p JOIN line_list l USING (doc_id))
"""
