"""Canonical nodes, table cells, rendering and integrity of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.blocks import blocks_of, let, lines_of
from folioquery.operators.structure import HEADING, heading_level, json_escaped


#: White space that ends of cells lose.
WHITE = " \t\r\n\f\v"
#: The marker of a list item.
ITEM = r"^\s*([-*+]|\d{1,9}[.)])\s+"


def nodes(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ordinal, node_id, type, level, first, last, text): headings, paragraphs, list items, code and tables in reading order.

    Blank lines make no node; each heading line is a node of its own, a list item
    takes the lines up to the next item, heading or blank line, and other lines
    are paragraphs. Ids are hashes of document, type and place.
    """

    def parts(lines: Column) -> Column:
        def of(b: Column) -> Column:
            inside = F.sequence(b["first"], b["last"])
            starts = F.filter(
                inside, lambda i: (i == b["first"]) | F.get(lines, i).rlike(HEADING) | F.get(lines, i).rlike(ITEM) | F.get(lines, i - 1).rlike(HEADING)
            )
            begun = F.when(b["kind"] == "prose", starts).otherwise(F.array(b["first"]))
            return let(
                begun,
                lambda s: F.transform(
                    s, lambda at, k: F.struct(b["kind"].alias("kind"), at.alias("first"), (F.coalesce(F.get(s, k + 1), b["last"] + 1) - 1).alias("last"))
                ),
            )

        split = F.flatten(F.transform(blocks_of(lines), of))
        shown = F.transform(
            split,
            lambda p: F.struct(
                p["kind"].alias("kind"), p["first"].alias("first"), p["last"].alias("last"), F.array_join(F.slice(lines, p["first"] + 1, p["last"] - p["first"] + 1), "\n").alias("text")
            ),
        )
        return F.filter(shown, lambda p: ~((p["kind"] == "prose") & p["text"].rlike(r"^\s*$")))

    each = docs.select(id_col, F.posexplode(let(lines_of(F.col("text")), parts)).alias("ordinal", "p"))
    level = F.when(F.col("p.kind") == "prose", heading_level(F.col("p.text"))).otherwise(0)
    kind = F.when(level > 0, "heading").when((F.col("p.kind") == "prose") & F.col("p.text").rlike(ITEM), "list_item").when(F.col("p.kind") == "prose", "paragraph").otherwise(F.col("p.kind"))
    out = each.select(
        id_col, F.col("ordinal"), kind.alias("type"), level.alias("level"), (F.col("p.first") + 1).alias("first"), (F.col("p.last") + 1).alias("last"), F.col("p.text").alias("text")
    )
    identity = F.concat_ws("|", F.col(id_col), "type", "ordinal")
    return out.withColumn("node_id", F.concat(F.lit("node-"), F.substring(F.sha2(identity, 256), 1, 16)))


def cells(node_table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, node_id, row, col, value) of pipe tables; separator rows are left out."""
    rows = F.filter(F.split("text", "\n", -1), lambda x: ~x.rlike(r"^\s*\|[\s:|-]*-[\s:|-]*$"))
    split = F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|", -1), lambda v: F.trim(v)))
    by_row = node_table.where(F.col("type") == "table").select(id_col, "node_id", F.posexplode(split).alias("row", "values"))
    return by_row.select(id_col, "node_id", "row", F.posexplode("values").alias("col", "value"))


def escaped(value: Column) -> Column:
    return F.trim(F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(WHITE))


def render_table(headers: Column, rows: Column, spanned: Column | None = None) -> Column:
    """A pipe table of an array of rows; headers replace the first row if they are as many as the columns.

    Ragged rows, and tables with cells over several rows or columns (``spanned``),
    are lines of their filled cells joined by bars. No rows give an empty text.
    """

    def line(values: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(values, escaped), " | "), F.lit(" |"))

    widths = F.array_distinct(F.transform(rows, F.size))
    width = F.element_at(widths, 1)
    headed = F.coalesce(F.size(headers) == width, F.lit(False))
    head = F.when(headed, headers).otherwise(F.array_repeat(F.lit(""), width))
    body = F.when(headed, F.slice(rows, 2, F.size(rows))).otherwise(rows)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    full = F.array_join(F.concat(F.array(line(head), rule), F.transform(body, line)), "\n")

    def filled(row: Column) -> Column:
        return F.array_join(F.filter(F.transform(row, lambda v: F.trim(F.coalesce(v, F.lit("")), F.lit(WHITE))), lambda v: v != ""), " | ")

    plain = F.trim(F.array_join(F.transform(rows, filled), "\n"), F.lit(WHITE))
    regular = (F.size(widths) == 1) & (width > 0) & ~F.coalesce(spanned if spanned is not None else F.lit(False), F.lit(False))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").when(regular, full).otherwise(plain)


def frontmatter(title: Column, timestamp: Column) -> Column:
    """A header of five keys; title and time stamp are JSON strings."""

    def quoted(x: Column) -> Column:
        return F.concat(F.lit('"'), json_escaped(F.coalesce(x, F.lit(""))), F.lit('"'))

    return F.concat(F.lit('---\ntype: ""\ntitle: '), quoted(title), F.lit('\ndescription: ""\ntags: []\ntimestamp: '), quoted(timestamp), F.lit("\n---\n\n"))


def render(node_table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each document's nodes in reading order with blank lines between."""
    grouped = node_table.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("n"))
    return grouped.select(id_col, F.array_join(F.transform("n", lambda x: x["text"]), "\n\n").alias("text"))


def warnings(node_table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, node_id, code, content_loss): open fences, one-column tables and headings of a deep level."""
    open_fence = (F.col("type") == "code") & ((F.col("first") == F.col("last")) | ~F.element_at(F.split("text", "\n", -1), -1).rlike(r"^\s*(```|~~~)\s*$"))
    narrow = (F.col("type") == "table") & ~F.col("text").rlike(r"(?m)^\s*\|[^|\n]*\|[^|\n]+\|")
    deep = (F.col("type") == "heading") & (F.col("level") > 3)
    codes = F.array_compact(F.array(F.when(open_fence, F.lit("open_fence")), F.when(narrow, F.lit("narrow_table")), F.when(deep, F.lit("deep_heading"))))
    return node_table.select(id_col, "node_id", F.explode(codes).alias("code")).withColumn("content_loss", F.col("code") == "open_fence")


def quality(docs: DataFrame, warning_table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """partial if any warning is a loss of content, else complete_with_warnings if there is any, else complete."""
    summed = warning_table.groupBy(id_col).agg(F.bool_or("content_loss").alias("loss"), F.count(F.lit(1)).alias("warnings"))
    joined = docs.select(id_col).join(summed, id_col, "left")
    state = F.when(F.col("loss"), "partial").when(F.col("warnings") > 0, "complete_with_warnings").otherwise("complete")
    return joined.select(id_col, state.alias("quality"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def dangling(rows: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key is in no row of the target."""
    return rows.join(target.select(F.col(target_key).alias(key)), key, "left_anti")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
