"""Queries over Office packages, made of the documents, and over glossary files, made of the parts."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.sources import glossary as G
from folioquery.sources import office as O
from folioquery.sources.tables import read

_NAMES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_HEADER = f'<w:hdr {_NAMES}><x descr="a mark" r:embed="r1"/><x r:link="r2"/></w:hdr>'
_RELATIONSHIPS = '<R><A Id="r1" Type="x/image" Target="media/a.png"/><A Id="r2" Type="x/image" Target="http://x/b.png" TargetMode="External"/></R>'
#: Nodes of a shard in the query.
SHARD = 40


@F.pandas_udf(T.BinaryType())
def _zipped(document: pd.Series, comments: pd.Series, image: pd.Series, unsafe: pd.Series) -> pd.Series:
    def package(body, note, picture, bad) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", body)
            z.writestr("word/header1.xml", _HEADER)
            z.writestr("word/_rels/header1.xml.rels", _RELATIONSHIPS)
            for name, content in (("word/comments.xml", note), ("word/media/a.png", picture), ("../x", bad)):
                if content is not None:
                    z.writestr(name, content)
        return out.getvalue()

    return pd.Series([package(*x) for x in zip(document, comments, image, unsafe, strict=True)])


def _escaped(text: Column) -> Column:
    """Text as XML may hold it."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]", "")
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each document as a Word package whose paragraphs are its numbered lines.

    Every third has a revision, every fifth comments, every second an image and
    every seventh an unsafe name; every eleventh is no package.
    """
    d = F.col("doc_id")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def paragraph(line: Column, k: Column) -> Column:
        run = F.concat(F.lit("<w:r><w:t>"), k.cast("string"), F.lit(": "), _escaped(line), F.lit("</w:t></w:r>"))
        revised = F.concat(F.lit("<w:ins>"), run, F.lit("</w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del>"))
        return F.concat(F.lit("<w:p>"), F.when((d % 3 == 0) & (k == 0), revised).otherwise(run), F.lit("</w:p>"))

    document = F.concat(F.lit(f"<w:document {_NAMES}><w:body>"), F.array_join(F.transform(lines, paragraph), ""), F.lit("</w:body></w:document>"))
    content = _zipped(document, F.when(d % 5 == 0, "<c/>"), F.when(d % 2 == 0, "png"), F.when(d % 7 == 0, "x"))
    return read(spark, sf_dir, "documents").select(F.concat(d.cast("string"), F.lit(".docx")).alias("path"), F.when(d % 11 > 0, content).otherwise(F.encode(F.lit("no zip"), "UTF-8")).alias("content"))


def package_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.word_paragraphs(packages(spark, sf_dir)).select("path", "ordinal", F.sha2("text", 256).alias("sha256"))


def package_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.xml_nodes(packages(spark, sf_dir))


def package_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.word_shards(packages(spark, sf_dir), SHARD)


def package_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.image_occurrences(packages(spark, sf_dir))


def package_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.package_warnings(packages(spark, sf_dir))


def package_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.preflight(packages(spark, sf_dir))


def glossary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): each part as a glossary of its name and type, in one of eight shapes."""
    k, name, kind = F.col("p_partkey") % 8, F.col("p_name"), F.col("p_type")
    suffix = F.element_at(F.array(*map(F.lit, (".json", ".json", ".json", ".json", ".csv", ".tsv", ".markdown", ".terms"))), (k + 1).cast("int"))
    shapes = (
        F.format_string('{"%s": "%s"}', name, kind),
        F.format_string('[{"Note": "x", "EN": "%s", "Zh": "%s"}, {"en": "", "zh": "q"}]', name, kind),
        F.format_string('[["%s", "old"], ["%s", "%s"]]', name, name, kind),
        F.format_string('{"terms": [{"source": "%s", "target": "%s", "confidence": "low", "origin": "mined"}]}', name, kind),
        F.format_string('note,Term,Translation\n"one, ""two""\nthree",%s,%s\n', name, kind),
        F.format_string("%s\t%s\n", name, kind),
        F.format_string("# T\n\n| English | Chinese |\n|---|:-:|\n| %s | %s |\n", name, kind),
        F.format_string("source;target\n%s;%s\n", name, kind),
    )
    text = F.when(k == 0, shapes[0])
    for n, shape in enumerate(shapes[1:], 1):
        text = text.when(k == n, shape)
    return read(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), suffix).alias("path"), text.alias("text"))


def glossary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.read_glossaries(glossary_files(spark, sf_dir))


def glossary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = G.structured(glossary_files(spark, sf_dir))
    return entries.withColumns({"evidence": F.size("evidence"), "allowed_targets": F.array_join("allowed_targets", "|")})


QUERIES = {f.__name__: f for f in (package_paragraphs, package_nodes, package_shards, package_images, package_losses, package_problems, glossary_rows, glossary_entries)}

_PACKAGES = """p AS (SELECT doc_id, doc_id || '.docx' AS path, string_split(coalesce(text, ''), chr(10)) AS lines, doc_id % 3 = 0 AS revised FROM documents WHERE doc_id % 11 > 0)"""
_GLOSSARY = """g AS (SELECT p_partkey || ['.json', '.json', '.json', '.json', '.csv', '.tsv', '.markdown', '.terms'][p_partkey % 8 + 1] AS path, [0, 0, 1, 0, 1, 0, 1, 1][p_partkey % 8 + 1] AS "row",
  p_name AS source, p_type AS target, p_partkey % 8 AS k FROM part)"""

ORACLE_SQL = {
    "package_paragraphs": rf"""WITH {_PACKAGES}, l AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS ordinal FROM p)
      SELECT path, ordinal::INT AS ordinal, sha256(ordinal || ': ' || regexp_replace(line, '[\x00-\x08\x0B-\x1F\x{{FFFE}}\x{{FFFF}}]', '', 'g')) AS sha256 FROM l""",
    "package_nodes": f"""WITH {_PACKAGES} SELECT path, 'word/document.xml' AS part, (2 + 4 * len(lines) + CASE WHEN revised THEN 5 ELSE 0 END)::BIGINT AS nodes, NULL::VARCHAR AS problem FROM p
      UNION ALL SELECT path, unnest(['word/header1.xml', 'word/_rels/header1.xml.rels']), 3, NULL FROM p UNION ALL SELECT path, 'word/comments.xml', 1, NULL FROM p WHERE doc_id % 5 = 0""",
    # a block has 4 nodes, the first one 9 where it is revised
    "package_shards": f"""WITH {_PACKAGES}, n AS (SELECT path, revised, len(lines) AS n, CASE WHEN revised THEN ({SHARD} - 5) // 4 ELSE {SHARD} // 4 END AS head, {SHARD} // 4 AS every FROM p),
      s AS (SELECT *, unnest(range(1, 2 + ((greatest(n - head, 0) + every - 1) // every)::INT)) AS shard FROM n),
      b AS (SELECT *, CASE WHEN shard = 1 THEN 1 ELSE head + (shard - 2) * every + 1 END AS "first", least(n, head + (shard - 1) * every) AS "last" FROM s)
      SELECT path, shard::INT AS shard, "first"::INT AS "first", "last"::INT AS "last", (4 * ("last" - "first" + 1) + CASE WHEN revised AND shard = 1 THEN 5 ELSE 0 END)::BIGINT AS nodes, NULL::VARCHAR AS problem FROM b""",
    "package_images": f"""WITH {_PACKAGES} SELECT path, 'word/header1.xml' AS part, 0 AS ordinal, 'r1' AS rel_id, 'a mark' AS alt, 'word/media/a.png' AS member, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'missing' END AS state FROM p
      UNION ALL SELECT path, 'word/header1.xml', 1, 'r2', '', NULL, 'external' FROM p""",
    "package_losses": f"""WITH {_PACKAGES} SELECT path, 'office_comments_not_preserved' AS code, 'Office comments were detected and are not preserved' AS message FROM p WHERE doc_id % 5 = 0
      UNION ALL SELECT path, 'office_revisions_flattened_to_accepted_view', 'Word revisions were flattened to the final accepted view (del=1, ins=1)' FROM p WHERE revised""",
    "package_problems": "SELECT doc_id || '.docx' AS path, CASE WHEN doc_id % 11 = 0 THEN 'not_a_package' ELSE 'unsafe_name' END AS problem FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0",
    "glossary_rows": f"""WITH {_GLOSSARY} SELECT path, "row"::INT AS "row", source, target, 'high' AS confidence FROM g""",
    "glossary_entries": f"""WITH {_GLOSSARY} SELECT path, "row"::INT AS "row", source, target, CASE WHEN k = 3 THEN 'low' ELSE 'high' END AS confidence, '3.0' AS schema_version,
      CASE WHEN k = 3 THEN 'mined' ELSE 'user_seed' END AS origin, 0 AS evidence, target AS allowed_targets FROM g""",
}
