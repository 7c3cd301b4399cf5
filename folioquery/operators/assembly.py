"""Assembly of results: edits, reports, bilingual segments, batch summaries, and reading of result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.blocks import FENCE, blocks_of, let, lines_of, pack

SUFFIXES = ("md", "markdown", "txt", "html", "pdf", "docx", "xlsx", "pptx", "epub", "csv", "json")


def classify_input(value: Column) -> Column:
    """url, or file with a known suffix, or unsupported."""
    suffix = F.lower(F.regexp_extract(value, r"\.([^./?#]+)$", 1))
    return F.when(value.rlike("(?i)^https?://"), "url").when(suffix.isin(*SUFFIXES), "file").otherwise("unsupported")


def url_admissible(url: Column) -> Column:
    """The static half of admission: http or https, a host, and no user in it; addresses of the local machine and private nets are refused."""
    authority = F.regexp_extract(url, "(?i)^https?://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(authority, r":\d*$", ""))
    private = r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.|\[)"
    return F.coalesce((host != "") & ~authority.contains("@") & ~host.rlike(private), F.lit(False))


def source_stem(path: Column) -> Column:
    """Name without its last suffix; of a URL the last part of its path, or the host."""
    bare = F.regexp_replace(F.regexp_replace(path, "[?#].*$", ""), "/+$", "")
    return F.regexp_replace(F.regexp_extract(bare, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def expand_references(given: DataFrame) -> DataFrame:
    """Distinct values (ordinal, value) in the order of their first appearance."""
    first = given.groupBy("value").agg(F.min("ordinal").alias("ordinal"))
    return first.select("ordinal", "value")


def chunk_files(files: DataFrame, language: str) -> DataFrame:
    """(chunk, text) of files named ``chunk_<n>.<language>.md``."""
    number = F.regexp_extract("path", rf"(?:^|/)chunk_(\d+)\.{language}\.md$", 1)
    return files.select(F.nullif(number, F.lit("")).cast("int").alias("chunk"), "text").where("chunk IS NOT NULL")


def result_rows(files: DataFrame, schema: str) -> DataFrame:
    """Results of files with a JSON array or an object with ``results``; others have none."""
    body = F.coalesce(F.get_json_object("text", "$.results"), F.col("text"))
    return files.select("path", F.posexplode(F.from_json(body, f"array<struct<{schema}>>")).alias("place", "r")).select("path", "place", "r.*")


def apply_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Texts with line edits (id, first, last, text) applied; of overlapping edits the earlier in the text stays.

    Each document's edits are folded in order, so lines keep their numbers while they are replaced.
    """
    grouped = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("first", "last", "text"))).alias("_edits"))

    def build(lines: Column) -> Column:
        start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(0).alias("at"))

        def fold(s: Column, e: Column) -> Column:
            ok = (e["first"] > s["at"]) & (e["last"] >= e["first"]) & (e["last"] <= F.size(lines))
            gap = F.slice(lines, s["at"] + 1, F.greatest(e["first"] - s["at"] - 1, F.lit(0)))
            done = F.struct(F.array_append(F.concat(s["out"], gap), e["text"]).alias("out"), e["last"].alias("at"))
            return F.when(ok, done).otherwise(s)

        return F.aggregate("_edits", start, fold, lambda s: F.concat(s["out"], F.slice(lines, s["at"] + 1, F.greatest(F.size(lines) - s["at"], F.lit(0)))))

    joined = docs.join(grouped, id_col, "left")
    edited = F.when(F.col("_edits").isNull(), F.col("text")).otherwise(F.array_join(let(lines_of(F.col("text")), build), "\n"))
    return joined.select(id_col, edited.alias("text"))


def report_cards(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One report text for each document from numbered findings (place, first_line, severity, original, reason)."""
    where = F.when(F.col("first_line").isNull(), F.lit("whole text")).otherwise(F.concat(F.lit("line "), "first_line"))
    card = F.concat(F.lit("### "), "place", F.lit(". "), where, F.lit(" ("), F.coalesce("severity", F.lit("medium")), F.lit(")\n"), F.coalesce("original", F.lit("")), F.lit("\n> "), F.coalesce("reason", F.lit("")))
    grouped = findings.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", card.alias("card")))).alias("c"))
    return grouped.select(id_col, F.array_join(F.transform("c", lambda x: x["card"]), "\n\n").alias("report"))


def bilingual_segments(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Source and target texts of the same key; a side that lacks it is null and the state says so."""
    both = source.select(*key, F.col("text").alias("source")).join(target.select(*key, F.col("text").alias("target")), key, "full")
    state = F.when(F.col("target").isNull(), "untranslated").when(F.col("source").isNull(), "unknown").otherwise("ok")
    return both.withColumn("state", state)


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts of (state) failed, skipped and converted, and the exit code: 1 if any failed, 2 if any was skipped, else 0."""
    counted = results.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("failed", "skipped", "converted")])
    return counted.withColumn("exit_code", F.when(F.col("failed") > 0, 1).when(F.col("skipped") > 0, 2).otherwise(0))


def claim_blocks(docs: DataFrame, max_chars: int, id_col: str = "doc_id") -> DataFrame:
    """(id, part, first, last, chars): whole blocks packed to at most ``max_chars`` characters, newlines between them counted."""

    def parts(lines: Column) -> Column:
        def packed(blocks: Column) -> Column:
            sizes = F.transform(
                blocks, lambda b: F.aggregate(F.slice(lines, b["first"] + 1, b["last"] - b["first"] + 1), F.lit(0), lambda n, x: n + F.length(x) + 1)
            )
            return let(
                pack(sizes, max_chars + 1),
                lambda g: F.transform(
                    g,
                    lambda at, k: F.struct(
                        (F.get(blocks, at)["first"] + 1).alias("first"), (F.get(blocks, F.coalesce(F.get(g, k + 1), F.size(blocks)) - 1)["last"] + 1).alias("last")
                    ),
                ),
            )

        return F.struct(lines.alias("lines"), let(blocks_of(lines), packed).alias("parts"))

    each = docs.select(id_col, let(lines_of(F.col("text")), parts).alias("b")).select(id_col, "b.lines", F.posexplode("b.parts").alias("at", "p"))
    text = F.array_join(F.slice("lines", F.col("p.first"), F.col("p.last") - F.col("p.first") + 1), "\n")
    return each.select(id_col, (F.col("at") + 1).alias("part"), "p.first", "p.last", F.length(text).alias("chars"))


def inline_images(text: Column) -> Column:
    """Array of struct(alt, target) of the Markdown images of a text."""
    shown = F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\([^)\s]+[^)]*\)"), 0)
    return F.transform(shown, lambda m: F.struct(F.regexp_extract(m, r"!\[([^\]]*)\]", 1).alias("alt"), F.regexp_extract(m, r"\]\(([^)\s]+)", 1).alias("target")))


def fence_balance(text: Column) -> Column:
    """Whether the fence lines of a text are even in number."""
    return F.size(F.filter(lines_of(text), lambda x: x.rlike(FENCE))) % 2 == 0


def pdf_problem(content: Column) -> Column:
    """What is wrong with the ends of a PDF file, or null: its magic, or the end mark in its last 4096 bytes."""
    head, size = F.substring(content, 1, 5), F.length(content)
    tail = F.hex(F.substring(content, F.greatest(size - 4095, F.lit(1)), F.lit(4096)))
    return F.when(content.isNull() | (size == 0), "empty").when(head != F.lit(b"%PDF-"), "magic").when(~tail.contains(b"%%EOF".hex().upper()), "end")


def save_glossary(terms: DataFrame) -> DataFrame:
    """One JSON text of all terms (source, target, confidence) in order of source; a glossary is small by nature."""
    entry = F.struct("source", "target", "confidence")
    grouped = terms.agg(F.array_sort(F.collect_list(entry)).alias("terms"))
    return grouped.select(F.to_json(F.struct("terms")).alias("text"))
