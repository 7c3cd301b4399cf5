"""Small rules about parts, locators, formats and the bodies of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.structure import json_escaped, natural_key

#: Prefixes of package parts that come first and second.
FIRST_PARTS = ("ppt/slides/slide", "xl/drawings/drawing")
SECOND_PARTS = ("word/header", "word/footer", "word/footnotes", "word/endnotes")
#: Fields of a locator that tell how it was found, not where it is.
VOLATILE = ("extraction_method", "ocr_provider", "ocr_version", "ocr_confidence")
#: Settings of the export to PDF, for all families and for each.
PDF_PROPERTIES = {
    "EmbedStandardFonts": "true", "ExportBookmarks": "true", "ExportFormFields": "false", "ExportNotes": "false", "IsAddStream": "false", "Quality": "100",
    "ReduceImageResolution": "false", "SelectPdfVersion": "17", "UseLosslessCompression": "true", "UseTaggedPDF": "true",
}
FAMILY_PROPERTIES = {
    "writer": {"ExportNotesInMargin": "false", "IsSkipEmptyPages": "false"},
    "impress": {"ExportHiddenSlides": "false", "ExportNotesPages": "false", "ExportOnlyNotesPages": "false", "UseTransitionEffects": "false"},
    "calc": {"SinglePageSheets": "false"},
}
#: Kinds of nodes that hold text.
TEXT_KINDS = ("heading", "paragraph", "list_item", "code")


def part_order(part: Column) -> Column:
    """Sort key of a package part: the main part, slides and drawings, then headers and notes, then the rest, each in natural order."""
    def any_of(prefixes: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for prefix in prefixes:
            out = out | part.startswith(prefix)
        return out

    rank = F.when((part == "word/document.xml") | any_of(FIRST_PARTS), 0).when(any_of(SECOND_PARTS), 1).otherwise(2)
    return F.struct(rank.alias("rank"), natural_key(part).alias("name"))


def locator_identity(locator: Column) -> Column:
    """A locator (a map) without the fields that change from run to run."""
    return F.map_filter(locator, lambda k, _: ~k.isin(*VOLATILE))


def pdf_properties(spark) -> DataFrame:
    """(family, name, value) of the settings for each family of documents."""
    rows = [(family, name, value) for family, own in FAMILY_PROPERTIES.items() for name, value in {**PDF_PROPERTIES, **own}.items()]
    return spark.createDataFrame(rows, "family string, name string, value string")


def pdf_argument(settings: DataFrame) -> DataFrame:
    """(family, argument): each family's export filter with its settings as JSON, types told by their values."""
    kind = F.when(F.col("value").isin("true", "false"), "boolean").otherwise("long")
    one = F.format_string('"%s":{"type":"%s","value":"%s"}', "name", kind, "value")
    joined = settings.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("j"))
    return joined.select("family", F.concat(F.lit("pdf:"), "family", F.lit("_pdf_Export:{"), "j", F.lit("}")).alias("argument"))


def formats_problem(value: Column) -> Column:
    """Null if a list of formats is empty or means both Markdown and PDF, else "formats"."""
    items = F.filter(F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != "")
    meant = F.array_sort(F.array_distinct(F.transform(items, lambda x: F.when(x.isin("md", "markdown"), "markdown").when(x == "pdf", "pdf").otherwise("?"))))
    return F.when((F.size(items) > 0) & (meant != F.array(F.lit("markdown"), F.lit("pdf"))), "formats")


def usable_bodies(nodes: DataFrame, cells: DataFrame, methods: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, usable): whether a document has a text node or a table cell that isn't blank.

    ``nodes`` (doc_id, node_id, type, text, method), ``cells`` (doc_id, node_id,
    value). With ``methods``, only nodes found in one of these ways count.
    """
    counted = nodes if methods is None else nodes.withColumn("type", F.when(F.col("method").isin(*methods), F.col("type")))
    filled = cells.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("doc_id", "node_id").distinct().withColumn("_filled", F.lit(True))
    joined = counted.join(filled, ["doc_id", "node_id"], "left")
    body = F.col("type").isin(*TEXT_KINDS) & (F.trim(F.coalesce("text", F.lit(""))) != "") | (F.col("type") == "table") & F.col("_filled").isNotNull()
    return joined.groupBy("doc_id").agg(F.bool_or(F.coalesce(body, F.lit(False))).alias("usable"))


def body_digests(nodes: DataFrame) -> DataFrame:
    """(doc_id, digest) of what a document says apart from its images: types and texts of its nodes in order, whatever their ids."""
    one = F.struct("ordinal", F.concat_ws("\t", "type", F.coalesce("text", F.lit(""))).alias("x"))
    shown = nodes.where(~F.coalesce(F.col("type") == "image", F.lit(False))).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("n"))
    return shown.select("doc_id", F.sha2(F.array_join(F.transform("n", lambda v: v["x"]), "\n"), 256).alias("digest"))


def runtime_fingerprint(parts: dict[str, Column]) -> Column:
    """SHA-256 of settings as a JSON object of strings with sorted keys."""
    pairs = [F.concat(F.lit(f'"{name}":"'), json_escaped(value), F.lit('"')) for name, value in sorted(parts.items())]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), 256)


def verified_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem) of files that a bundle names (path, bytes, sha256), against those that are there (path, content): null if one is as named."""
    there = found.select("path", F.octet_length("content").alias("_n"), F.sha2("content", 256).alias("_now"))
    both = expected.join(there, "path", "left")
    problem = F.when(F.col("_now").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "size").when(F.col("_now") != F.lower("sha256"), "hash")
    return both.select("path", problem.alias("problem"))
