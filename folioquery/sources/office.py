"""Office packages (zip files of XML) as tables: members, relationships, image references, paragraphs and cells.

Packages are read with the standard library, one file at a time, in Arrow
batches of few rows; what is found comes back as rows and everything else is
relational. External entities are never resolved, and packages that declare a
document type are refused.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Limits of a package: bytes of the file, members, bytes of a member and of all, ratio of expansion (from 1 MiB on).
MOST_BYTES, MOST_MEMBERS, MOST_MEMBER, MOST_EXPANDED, MOST_RATIO = 512 << 20, 20_000, 256 << 20, 1 << 30, 250
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

MEMBERS = "path string, member string, bytes long, packed long, crc long"
RELATIONSHIPS = "path string, part string, rel_id string, kind string, target string, external boolean"
REFERENCES = "path string, part string, ordinal int, rel_id string, alt string"
PARAGRAPHS = "path string, ordinal int, style string, text string"
CELLS = "path string, sheet string, cell string, value string"
NODES = "path string, part string, nodes long, problem string"
BLOCKS = "path string, block int, nodes long"
REVISIONS = "path string, part string, tag string, times long"

#: Depth of an XML part, nodes of a shard of a Word body and of its largest block, at most.
MOST_DEPTH, SHARD_NODES, MOST_BLOCK_NODES = 256, 400_000, 1_500_000
# Marks of revisions in Word, and those that have no accepted view.
REVISION_TAGS = (
    "ins", "del", "moveFrom", "moveTo", "rPrChange", "pPrChange", "tblPrChange", "trPrChange", "tcPrChange", "sectPrChange", "tblGridChange", "tblPrExChange",
    "numberingChange", "moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd", "customXmlInsRangeStart", "customXmlInsRangeEnd",
    "customXmlDelRangeStart", "customXmlDelRangeEnd", "customXmlMoveFromRangeStart", "customXmlMoveFromRangeEnd", "customXmlMoveToRangeStart", "customXmlMoveToRangeEnd",
)
UNSUPPORTED_TAGS = ("cellIns", "cellDel", "cellMerge", "conflictIns", "conflictDel")


def _rows(files: DataFrame, schema: str, read: Callable[[zipfile.ZipFile], Iterator[tuple]]) -> DataFrame:
    """Rows that ``read`` finds in each package; files that are no package have none."""
    fields = T._parse_datatype_string(schema)
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    types = [kinds[f.dataType.simpleString()] for f in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as package:
                        rows = [(path, *r) for r in read(package)]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, OSError):
                    continue
                for a in range(0, len(rows), 10_000):
                    columns = zip(*rows[a : a + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=fields.names)

    return files.select("path", "content").mapInArrow(run, fields)


def _xml(package: zipfile.ZipFile, name: str) -> ElementTree.Element:
    raw = package.read(name)
    if b"<!DOCTYPE" in raw:
        raise ValueError("document types are not read")
    return ElementTree.fromstring(raw)


def members(files: DataFrame) -> DataFrame:
    return _rows(files, MEMBERS, lambda z: ((i.filename, i.file_size, i.compress_size, i.CRC) for i in z.infolist()))


def preflight(files: DataFrame) -> DataFrame:
    """(path, problem) of the packages beyond a limit or with unsafe names; no row for the others."""
    listed = members(files)
    summed = listed.groupBy("path").agg(
        F.count(F.lit(1)).alias("members"),
        F.max("bytes").alias("largest"),
        F.sum("bytes").alias("expanded"),
        F.max(F.when(F.col("bytes") >= 1 << 20, F.col("bytes") / F.greatest(F.col("packed"), F.lit(1)))).alias("ratio"),
        F.bool_or(F.col("member").rlike(r"^/|(^|/)\.\.(/|$)|\\|^[A-Za-z]:")).alias("unsafe"),
    )
    joined = files.select("path", F.length("content").alias("bytes")).join(summed, "path", "left")
    problem = (
        F.when(F.col("members").isNull(), "not_a_package")
        .when(F.col("bytes") > MOST_BYTES, "too_large")
        .when(F.col("unsafe"), "unsafe_name")
        .when(F.col("members") > MOST_MEMBERS, "too_many_members")
        .when(F.col("largest") > MOST_MEMBER, "member_too_large")
        .when(F.col("expanded") > MOST_EXPANDED, "expands_too_far")
        .when(F.col("ratio") > MOST_RATIO, "ratio")
    )
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def relationships(files: DataFrame) -> DataFrame:
    def read(package: zipfile.ZipFile) -> Iterator[tuple]:
        for name in package.namelist():
            if found := re.fullmatch(r"(.*?)_rels/([^/]+)\.rels", name):
                for r in _xml(package, name):
                    yield found[1] + found[2], r.get("Id"), (r.get("Type") or "").rpartition("/")[2], r.get("Target"), r.get("TargetMode") == "External"

    return _rows(files, RELATIONSHIPS, read)


def image_references(files: DataFrame) -> DataFrame:
    """Elements that embed or link an image, in document order, with the nearest description above them."""

    def read(package: zipfile.ZipFile) -> Iterator[tuple]:
        for name in sorted(n for n in package.namelist() if n.endswith(".xml") and "/_rels/" not in n):
            ordinal, stack = 0, [(_xml(package, name), "")]
            while stack:
                node, alt = stack.pop()
                described = next((c.get("descr") or c.get("title") for c in node if c.tag.rpartition("}")[2] in ("docPr", "cNvPr") and (c.get("descr") or c.get("title"))), None)
                alt = described or node.get("descr") or alt
                if rel := node.get(_R + "embed") or node.get(_R + "link"):
                    yield name, ordinal, rel, alt
                    ordinal += 1
                stack += [(c, alt) for c in reversed(list(node))]

    return _rows(files, REFERENCES, read)


def image_occurrences(files: DataFrame) -> DataFrame:
    """References joined to their relationships: the member each shows, or why there is none."""
    from folioquery.operators.pages import resolve_path

    joined = image_references(files).join(relationships(files), ["path", "part", "rel_id"], "left")
    member = F.when(~F.col("external"), resolve_path(F.col("part"), F.col("target")))
    resolved = joined.withColumn("member", member).join(members(files).select("path", "member", "bytes"), ["path", "member"], "left")
    state = F.when(F.col("target").isNull(), "no_relationship").when(F.col("external"), "external").when(F.col("bytes").isNull(), "missing").otherwise("ok")
    return resolved.select("path", "part", "ordinal", "rel_id", "alt", "member", state.alias("state"))


def word_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of the main document in order, deleted revisions left out, insertions accepted."""

    def read(package: zipfile.ZipFile) -> Iterator[tuple]:
        body = _xml(package, "word/document.xml")
        for removed in ("del", "moveFrom"):
            for parent in list(body.iter()):
                for child in [c for c in parent if c.tag == _W + removed]:
                    parent.remove(child)
        for k, p in enumerate(body.iter(_W + "p")):
            style = p.find(f"{_W}pPr/{_W}pStyle")
            text = "".join("\t" if n.tag == _W + "tab" else "\n" if n.tag == _W + "br" else n.text or "" for n in p.iter() if n.tag in (_W + "t", _W + "tab", _W + "br"))
            yield k, style.get(_W + "val") if style is not None else None, text

    return _rows(files, PARAGRAPHS, read)


def sheet_cells(files: DataFrame) -> DataFrame:
    """Cells of all worksheets by their shown or stored value."""

    def read(package: zipfile.ZipFile) -> Iterator[tuple]:
        names = package.namelist()
        shared = [("".join(t.text or "" for t in s.iter(_S + "t"))) for s in _xml(package, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for c in _xml(package, name).iter(_S + "c"):
                v = c.find(_S + "v")
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(_S + "t"))
                elif v is None:
                    continue
                else:
                    value = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield name.rpartition("/")[2][:-4], c.get("r"), value

    return _rows(files, CELLS, read)


def xml_nodes(files: DataFrame) -> DataFrame:
    """(path, part, nodes, problem) of each XML part: its elements and those with text before their first child.

    Parts are streamed, so a large one needs no tree. One that is too deep,
    malformed or declares entities of its own has a problem and no count.
    """

    def read(package: zipfile.ZipFile) -> Iterator[tuple]:
        for name in sorted(n for n in package.namelist() if n.endswith((".xml", ".rels"))):
            with package.open(name) as stream:
                yield (name, *_streamed_nodes(stream))

    return _rows(files, NODES, read)


class _Refused(Exception):
    pass


def _streamed_nodes(stream) -> tuple[int | None, str | None]:
    found, open_ = 0, []  # for each open element: whether its text before a child isn't blank, None after the first child

    def begin(*_) -> None:
        nonlocal found
        if open_:
            open_[-1] = None
        open_.append(False)
        found += 1
        if len(open_) > MOST_DEPTH:
            raise _Refused("too_deep")

    def text(value: str) -> None:
        nonlocal found
        if open_ and open_[-1] is False and value.strip():
            open_[-1] = True
            found += 1

    def doctype(_name, _system, _public, internal) -> None:
        if internal:
            raise _Refused("internal_entities")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.StartDoctypeDeclHandler = begin, lambda _: open_.pop(), text, doctype
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    try:
        parser.ParseFile(stream)
    except _Refused as refused:
        return None, str(refused)
    except expat.ExpatError:
        return None, "malformed"
    return found, None


def word_shards(files: DataFrame, most: int = SHARD_NODES) -> DataFrame:
    """(path, shard, first, last, nodes, problem): runs of blocks of a Word body of at most ``most`` nodes, counted from 1.

    A block of its own that is larger stays whole; one beyond the limit of a block makes its shard a problem.
    """
    from folioquery.operators.blocks import pack

    def read(package: zipfile.ZipFile) -> Iterator[tuple]:
        body = _xml(package, "word/document.xml").find(_W + "body")
        for k, block in enumerate(body if body is not None else (), 1):
            yield k, sum(1 + bool(n.text and n.text.strip()) for n in block.iter())

    blocks = _rows(files, BLOCKS, read).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "nodes"))).alias("b"))
    starts = blocks.withColumn("starts", pack(F.transform("b", lambda x: x["nodes"].cast("int")), most))
    each = starts.select("path", "b", "starts", F.posexplode("starts").alias("shard", "at"))
    until = F.coalesce(F.get("starts", F.col("shard") + 1), F.size("b"))
    own = F.transform(F.slice("b", F.col("at") + 1, until - F.col("at")), lambda x: x["nodes"])
    problem = F.when(F.exists("own", lambda n: n > MOST_BLOCK_NODES), "block_too_large")
    out = each.select("path", (F.col("shard") + 1).alias("shard"), (F.col("at") + 1).alias("first"), until.alias("last"), own.alias("own"))
    return out.select("path", "shard", "first", "last", F.aggregate("own", F.lit(0).cast("long"), lambda a, n: a + n).alias("nodes"), problem.alias("problem"))


def word_revisions(files: DataFrame) -> DataFrame:
    """(path, part, tag, times) of the marks of revisions in the body, headers, footers and notes of Word packages."""

    def read(package: zipfile.ZipFile) -> Iterator[tuple]:
        for name in sorted(n for n in package.namelist() if re.fullmatch(r"word/(?:document|(?:header|footer)\d+|footnotes|endnotes)\.xml", n)):
            times = Counter(e.tag[len(_W) :] for e in _xml(package, name).iter() if isinstance(e.tag, str) and e.tag.startswith(_W))
            for tag in (*REVISION_TAGS, *UNSUPPORTED_TAGS):
                if times[tag]:
                    yield name, tag, times[tag]

    return _rows(files, REVISIONS, read)


def package_warnings(files: DataFrame) -> DataFrame:
    """(path, code, message) of what reading a package loses: comments, and revisions that are shown as accepted."""
    named = F.lower("member").contains("comment") & F.col("member").endswith(".xml")
    comments = members(files).where(named).select("path").distinct()
    noted = comments.select("path", F.lit("office_comments_not_preserved").alias("code"), F.lit("Office comments were detected and are not preserved").alias("message"))
    counted = word_revisions(files).where(F.col("tag").isin(*REVISION_TAGS)).groupBy("path", "tag").agg(F.sum("times").alias("times"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tag", "times"))), lambda x: F.concat(x["tag"], F.lit("="), x["times"])), ", ")
    summed = counted.groupBy("path").agg(listed.alias("summary"))
    message = F.concat(F.lit("Word revisions were flattened to the final accepted view ("), "summary", F.lit(")"))
    return noted.unionByName(summed.select("path", F.lit("office_revisions_flattened_to_accepted_view").alias("code"), message.alias("message")))
