"""Glossaries in JSON, CSV and Markdown as rows (source, target), read from a table of texts."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header names that mean the source or the target column.
SOURCE_NAMES = ("source", "english", "en", "original", "from", "key", "term")
TARGET_NAMES = ("target", "chinese", "zh", "translation", "to", "value", "translated")
DELIMITERS = (",", "\t", ";", "|")
#: Characters of a text from which its delimiter is guessed.
SNIFFED = 4096


#: Columns of an entry of the structured shape.
ENTRY = "struct<source:string,target:string,confidence:string,schema_version:string,origin:string,evidence:array<string>,allowed_targets:array<string>>"


def _named(entry: Column, names: tuple[str, ...]) -> Column:
    """Value of the first key of a map that is one of the names."""
    found = F.filter(F.map_entries(entry), lambda e: F.lower(F.trim(e["key"])).isin(*names))
    return F.get(found, F.lit(0))["value"]


def from_json(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, row, source, target) of the three JSON shapes: a flat map, a list of objects or pairs, or ``{"terms": [...]}``.

    Objects of a list may name their parts as a header may; those of ``terms``
    have source and target. Text that is no JSON has no rows.
    """
    flat = F.from_json("text", "map<string,string>")
    shape = F.get_json_object("text", "$.terms")
    terms = F.when(F.ltrim(shape).startswith("["), shape)
    listed = F.coalesce(terms, F.when(F.ltrim("text").startswith("["), F.col("text")))
    objects = F.from_json(listed, "array<map<string,string>>")
    pairs = F.from_json(listed, "array<array<string>>")

    def of_object(o: Column) -> Column:
        source = F.when(terms.isNotNull(), o["source"]).otherwise(_named(o, SOURCE_NAMES))
        target = F.when(terms.isNotNull(), o["target"]).otherwise(_named(o, TARGET_NAMES))
        return F.struct(source.alias("source"), target.alias("target"))

    by_pair = F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("source"), F.get(p, F.lit(1)).alias("target")))
    by_map = F.transform(F.map_entries(flat), lambda e: F.struct(e["key"].alias("source"), e["value"].alias("target")))
    entries = F.when(listed.isNull(), by_map).when(F.regexp_like(listed, F.lit(r"\A\s*\[\s*\[")), by_pair).otherwise(F.transform(objects, of_object))
    return _clean(files.select(id_col, F.posexplode(entries).alias("row", "e")).select(id_col, "row", "e.source", "e.target"), id_col)


def structured(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, row, source, target, confidence, schema_version, origin, evidence, allowed_targets) of all glossaries.

    Entries of a JSON ``terms`` list keep what they have, and every one of them
    stays; those of the other shapes have high confidence. What is missing gets its default:
    the version, an origin in the user's seed, no evidence, and the target as the only one allowed.
    """
    terms = F.when(F.ltrim("text").startswith("{"), F.get_json_object("text", "$.terms"))
    wrapped = F.ltrim(terms).startswith("[") & F.lower(F.col(id_col)).endswith(".json")
    kept = files.where(wrapped).select(id_col, F.posexplode(F.from_json(terms, f"array<{ENTRY}>")).alias("row", "e")).select(id_col, "row", "e.*")
    plain = read_glossaries(files.where(~F.coalesce(wrapped, F.lit(False))), id_col)
    rows = kept.unionByName(plain, allowMissingColumns=True)
    own = F.when(F.coalesce("target", F.lit("")) != "", F.array("target")).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({
        "schema_version": F.coalesce("schema_version", F.lit("3.0")), "origin": F.coalesce("origin", F.lit("user_seed")),
        "evidence": F.coalesce("evidence", F.array().cast("array<string>")), "allowed_targets": F.coalesce("allowed_targets", own),
    })


def _clean(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows with a source and a target; of equal sources the last one wins."""
    full = rows.select(id_col, "row", F.trim("source").alias("source"), F.trim("target").alias("target")).where("source <> '' AND target <> ''")
    return full.groupBy(id_col, "source").agg(F.max("row").alias("row"), F.max_by("target", "row").alias("target")).select(id_col, "row", "source", "target")


def _columns(header: Column) -> tuple[Column, Column]:
    """Places of the two columns by the first header cell with one of their names; null where there is none."""

    def place(names: tuple[str, ...]) -> Column:
        known = F.transform(header, lambda h: F.lower(F.trim(h)).isin(*names))
        return F.nullif(F.array_position(known, F.lit(True)), F.lit(0)) - 1

    return place(SOURCE_NAMES), place(TARGET_NAMES)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def delimited_rows(text: pd.Series) -> pd.Series:
    """Rows of delimited text whose quoted fields may hold delimiters and line ends.

    The delimiter is guessed from the beginning of the text, a comma where that
    fails. Null and empty texts have no rows; blank lines are left out.
    """

    def rows(x: str | None) -> list[list[str]]:
        try:
            dialect = csv.Sniffer().sniff((x or "")[:SNIFFED], delimiters="".join(DELIMITERS))
        except csv.Error:
            dialect = csv.excel
        return [r for r in csv.reader(io.StringIO(x or "", newline=""), dialect) if r]

    return text.map(rows)


def from_csv(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, row, source, target) of delimited text; a first line that names both columns is a header, else all lines are data."""
    return _from_rows(files.select(id_col, delimited_rows("text").alias("rows")).where(F.size("rows") > 0), id_col)


def _from_rows(rows: DataFrame, id_col: str) -> DataFrame:
    source, target = _columns(F.get("rows", F.lit(0)))
    placed = rows.select(id_col, "rows", source.cast("int").alias("s"), target.cast("int").alias("t")).withColumn("headed", F.col("s").isNotNull() & F.col("t").isNotNull())
    each = placed.select(id_col, "headed", "s", "t", F.posexplode("rows").alias("row", "cells")).where(~F.col("headed") | (F.col("row") > 0))
    s, t = F.when(F.col("headed"), F.col("s")).otherwise(0), F.when(F.col("headed"), F.col("t")).otherwise(1)
    return _clean(each.select(id_col, "row", F.get("cells", s).alias("source"), F.get("cells", t).alias("target")), id_col)


def from_markdown(files: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, row, source, target) of the pipe-table lines of a text; separator lines don't count."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^\s*\|[\s:|-]+$"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c)))
    return _from_rows(files.select(id_col, cells.alias("rows")).where(F.size("rows") > 1), id_col)


def read_glossaries(files: DataFrame, id_col: str = "path") -> DataFrame:
    """Rows of all glossaries by their suffix; others are read as JSON if they are, else as CSV."""
    suffix = F.lower(F.regexp_extract(id_col, r"\.([^./]+)$", 1))
    parses = F.try_parse_json("text").isNotNull()
    kind = F.when(suffix.isin("md", "markdown"), "md").when(suffix == "json", "json").when(suffix.isin("csv", "tsv") | ~F.coalesce(parses, F.lit(False)), "csv").otherwise("json")
    typed = files.withColumn("_kind", kind)
    readers = {"json": from_json, "csv": from_csv, "md": from_markdown}
    out = None
    for name, reader in readers.items():
        one = reader(typed.where(F.col("_kind") == name).drop("_kind"), id_col)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("confidence", F.lit("high"))


def text_files(spark, paths: list[str] | str, suffixes: tuple[str, ...] = ("json", "csv", "tsv", "md"), recursive: bool = True) -> DataFrame:
    """(path, text) of the files of a folder with one of the suffixes, sorted by path; texts that aren't UTF-8 are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)
    return files.where(wanted & F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"))


def source_records(files: DataFrame) -> DataFrame:
    """Name, size, hash and media type of each file of a binary listing (path, length, content)."""
    from folioquery.operators.structure import media_type

    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), media_type(F.col("path")).alias("media_type"))
