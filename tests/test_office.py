import io
import zipfile

import pytest

from folioquery.sources import office as O

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def package(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", ".").replace("RELS", "_rels"), text)
    return out.getvalue()


@pytest.fixture(scope="module")
def files(spark):
    word = package(
        word__document_dot_xml=f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>'
        f'<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:t>old</w:t></w:r></w:del><w:r><w:tab/><w:t>text</w:t></w:r></w:p>'
        f'<w:p><docPr descr="a cat"/><x r:embed="r1"/><x r:embed="r2"/><x r:link="r3"/><x r:embed="r9"/></w:p></w:body></w:document>',
        word__RELS__document_dot_xml_dot_rels='<R><r Id="r1" Type="x/image" Target="media/a.png"/><r Id="r2" Type="x/image" Target="../b.png"/>'
        '<r Id="r3" Type="x/image" Target="http://x" TargetMode="External"/></R>',
        word__media__a_dot_png=b"png",
    )
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = package(
        xl__sharedStrings_dot_xml=f"<sst {s}><si><t>he</t><t>llo</t></si></sst>",
        xl__worksheets__sheet1_dot_xml=f'<w {s}><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c><c r="D1"/></w>',
    )
    bad = package(**{"__etc__passwd": "x", "z": "0" * (2 << 20)})
    doctype = package(word__document_dot_xml="<!DOCTYPE x []><x/>")
    rows = [("a.docx", word), ("b.xlsx", sheet), ("c.zip", bad), ("d.docx", b"no zip"), ("e.docx", None), ("f.docx", doctype), ("g.zip", package(z="0" * (2 << 20)))]
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")


def test_word(files):
    assert [(r.ordinal, r.style, r.text) for r in O.word_paragraphs(files).collect()] == [(0, "Heading1", "Title"), (1, None, "new\ttext"), (2, None, "")]


def test_images(files):
    got = sorted((r.ordinal, r.alt, r.member, r.state) for r in O.image_occurrences(files).where("path = 'a.docx'").collect())
    assert got == [(0, "a cat", "word/media/a.png", "ok"), (1, "a cat", "b.png", "missing"), (2, "a cat", None, "external"), (3, "a cat", None, "no_relationship")]


def test_cells(files):
    assert sorted((r.sheet, r.cell, r.value) for r in O.sheet_cells(files).collect()) == [("sheet1", "A1", "hello"), ("sheet1", "B1", "2.5"), ("sheet1", "C1", "in")]


def test_preflight(files):
    assert {r.path: r.problem for r in O.preflight(files).collect()} == {"c.zip": "unsafe_name", "d.docx": "not_a_package", "e.docx": "not_a_package", "g.zip": "ratio"}


def test_nodes_of_parts(spark):
    deep = "<a>" * 257 + "</a>" * 257
    parts = {"a.xml": "<a> <b>x</b>tail<c/></a>", "b.xml": "<a>x<b> </b></a>", "c.xml": deep, "d.xml": "<a>", "e.xml": '<!DOCTYPE a [<!ENTITY x "y">]><a/>', "f.xml": "<!DOCTYPE html><a/>"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    files = spark.createDataFrame([("p", bytearray(out.getvalue()))], "path string, content binary")
    got = {r.part: (r.nodes, r.problem) for r in O.xml_nodes(files).collect()}
    assert got == {"a.xml": (4, None), "b.xml": (3, None), "c.xml": (None, "too_deep"), "d.xml": (None, "malformed"), "e.xml": (None, "internal_entities"), "f.xml": (1, None)}


def test_revisions_shards_and_warnings(files):
    assert [(r.path, r.part, r.tag, r.times) for r in O.word_revisions(files).collect()] == [("a.docx", "word/document.xml", t, 1) for t in ("ins", "del")]
    assert {(r.path, r.message) for r in O.package_warnings(files).collect()} == {("a.docx", "Word revisions were flattened to the final accepted view (del=1, ins=1)")}
    got = [(r.shard, r.first, r.last, r.nodes) for r in O.word_shards(files, 14).orderBy("shard").collect()]
    assert got == [(1, 1, 1, 6), (2, 2, 2, 13), (3, 3, 3, 6)]
