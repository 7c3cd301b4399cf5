from pyspark.sql import functions as F

from folioquery.operators import align, blocks, canonical, pages, review, runs, structure, terms


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def block_list(spark, text):
    row = docs(spark, text).select(blocks.let(blocks.lines_of(F.col("text")), blocks.blocks_of).alias("b")).first()
    return [(b.kind, b.first, b.last) for b in row.b]


def test_blocks(spark):
    assert block_list(spark, None) == block_list(spark, "") == [("prose", 0, 0)]
    assert block_list(spark, "a\nb\n\nc") == [("prose", 0, 1), ("prose", 2, 2), ("prose", 3, 3)]
    assert block_list(spark, "```\nx\n~~~\n```\ny\n| t |\n |u|") == [("code", 0, 3), ("prose", 4, 4), ("table", 5, 6)]
    assert block_list(spark, "a\n~~~py\nx\n```") == [("prose", 0, 0), ("code", 1, 3)]
    assert block_list(spark, "```\na\n```\n```\nb\n```") == [("code", 0, 2), ("code", 3, 5)]


def test_chunks_and_passages(spark):
    text = "\n".join(["a"] * 3 + [""] + ["b"] * 5 + [""] + ["c"]) + "\n"
    got = [(r.chunk, r.start, r.end, r.lines, r.oversized) for r in blocks.chunks(docs(spark, text), 4).collect()]
    assert got == [(1, 1, 4, 4, False), (2, 5, 9, 5, True), (3, 10, 12, 3, False)]
    assert blocks.review_chunks(docs(spark, text), 4).agg(F.max("end")).first()[0] == 11
    proof = blocks.coverage(blocks.chunks(docs(spark, text, "", None), 4), docs(spark, text, "", None)).collect()
    assert all(r.gapless and r.equal for r in proof) and len(proof) == 3
    broken = blocks.chunks(docs(spark, text), 4).where("chunk <> 2")
    assert not blocks.coverage(broken, docs(spark, text)).first().gapless
    parts = blocks.passages(docs(spark, "aaa\nbbb\n" + "c" * 20), 8).collect()
    assert [(r.start, r.end, r.over_capacity) for r in parts] == [(1, 2, False), (3, 3, True)]


def test_pack_at_the_limit(spark):
    df = spark.createDataFrame([([3, 1, 4, 5, 1],), ([],)], "n array<int>")
    assert [r[0] for r in df.select(blocks.pack(F.col("n"), 4)).collect()] == [[0, 2, 3, 4], []]


def test_structure(spark):
    text = "# A\n## B\npara\n| x |\n\n| y |\n```\n# no\n```\nlast"
    row = docs(spark, text).select(structure.heading_counts(F.col("text")), structure.paragraph_lines(F.col("text")), structure.table_count(F.col("text"))).first()
    assert list(row) == [[2, 1, 0, 0, 0, 0], 2, 2]
    t = docs(spark, "---\na: b\n---\n# *T* [l](u)\n```\n# x\n```", "```\n# x\n```", None)
    assert [r[0] for r in t.select(structure.title(F.col("text"), F.lit("none"))).collect()] == ["T l", "none", "none"]
    n = docs(spark, "1,234", "(5.5)", "12,34", "", None, "-3", "abc", " 7 ")
    assert [r[0] for r in n.select(structure.numeric_cell(F.col("text"))).collect()] == [1234.0, -5.5, 1234.0, None, None, -3.0, None, 7.0]
    u = docs(spark, "HTTPS://u:p@h.x:8/a?q#f", "http://h", "nothing", None)
    assert [r[0] for r in u.select(structure.redact_url(F.col("text"))).collect()] == ["https://h.x:8/a", "http://h/", None, None]
    c = docs(spark, "ok.txt", "CON.txt", "a/b", "x.", "..", "", None, "t\x01")
    assert [r[0] for r in c.select(structure.component_problem(F.col("text"))).collect()] == [None, "device", "separator", "trailing", "relative", "empty", "empty", "control"]


def test_ledger(spark):
    text = "Hello éhello HELLO\nhello_ hello"
    glossary = spark.createDataFrame([("t", "hello"), ("c", "中")], "term_id string, source string")
    got = terms.occurrence_ledger(docs(spark, text, None, "x中中"), glossary).orderBy("doc_id", "offset").collect()
    assert [(r.doc_id, r.term_id, r.offset, r.line) for r in got] == [(0, "t", 0, 1), (0, "t", 13, 1), (0, "t", 26, 2), (2, "c", 1, 1), (2, "c", 2, 1)]
    assert len({r.occurrence_id for r in got}) == 5


def test_grounding(spark):
    claims = spark.createDataFrame([(1,), (2,), (3,), (4,)], "claim_id long")
    passages = spark.createDataFrame([(1,), (2,)], "passage_id long")
    rows = [(1, 1, "supported"), (1, 2, "no-basis"), (2, 1, "contradicted"), (2, 2, "supported"), (3, 1, "no-basis"), (3, 2, "no-basis"), (4, 1, "contradicted"), (4, 9, "supported")]
    assessed = spark.createDataFrame(rows, "claim_id long, passage_id long, status string")
    assert {r.claim_id: r.verdict for r in review.grounding(claims, passages, assessed).collect()} == {1: "supported", 2: "contradicted", 3: "no-basis", 4: "unverified"}
    assert {r.verdict for r in review.grounding(claims, passages.limit(0), assessed.limit(0)).collect()} == {"supported"}


def test_reducer_layers(spark):
    df = spark.createDataFrame([(1, 1), (2, 4), (3, 5), (4, 64), (5, 65)], "doc_id long, leaves long")
    got = sorted((r.doc_id, r.layer, r.cells) for r in review.reducer_tree(df).collect())
    assert got == [(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 16), (4, 2, 4), (4, 3, 1), (5, 1, 17), (5, 2, 5), (5, 3, 2)]


def test_render_table(spark):
    rows = [(["a", "b"], [["1", " x|y"], ["2\n3", None]]), (["a"], [["1", "2"]]), ([], [[" 1 ", ""], ["2", "3", " "]]), (None, [["a", "b"]]), (["a"], [])]
    df = spark.createDataFrame(rows, "h array<string>, r array<array<string>>")
    got = [r[0] for r in df.select(canonical.render_table(F.col("h"), F.col("r"))).collect()]
    assert got == ["| a | b |\n| --- | --- |\n| 2 3 |  |", "|  |  |\n| --- | --- |\n| 1 | 2 |", "1\n2 | 3", "|  |  |\n| --- | --- |\n| a | b |", ""]
    assert df.select(canonical.render_table(F.col("h"), F.col("r"), F.lit(True))).first()[0] == "1 | x|y\n2\n3"


def test_alignment(spark):
    df = spark.createDataFrame([("aXbX", "X"), ("abc", "bc"), ("aaa", "aa"), ("a", ""), (None, "x")], "t string, n string")
    assert [r[0] for r in df.select(align.unique_position(F.col("t"), F.col("n"))).collect()] == [None, 1, None, None, None]
    runs_of = align.consecutive_runs(spark.createDataFrame([("g", x) for x in (1, 2, 3, 5, 7, 8, 8)], "g string, v long"), ["g"], "v")
    assert sorted((r.first, r.last, r.n) for r in runs_of.collect()) == [(1, 3, 3), (5, 5, 1), (7, 8, 2)]


def test_paths_and_spans(spark):
    df = spark.createDataFrame([("a/b/c.xml", "../d.png"), ("a.xml", "../x"), ("a/b", "/z"), ("a/", "./q")], "b string, t string")
    assert [r[0] for r in df.select(pages.resolve_path(F.col("b"), F.col("t"))).collect()] == ["a/d.png", None, "z", "a/q"]
    text = docs(spark, "use `x` at https://a.b/c and $m$ in AB-1", "", None)
    kept = text.select("text", pages.protect(F.col("text")).alias("p")).select("text", "p.kept", pages.restore(F.col("p.masked"), F.col("p.kept")).alias("r")).collect()
    assert kept[0].kept == ["`x`", "https://a.b/c", "$m$", "AB-1"] and kept[0].r == kept[0].text and kept[1].r == ""


def test_runs(spark):
    taken = spark.createDataFrame([("a",), ("a_1",), ("a_3",), ("b_1",)], "name string")
    stems = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    assert {r.stem: r.name for r in runs.free_name(stems, taken).collect()} == {"a": "a_2", "b": "b", "c": "c"}
    cache = spark.createDataFrame([("k1", 1, "v")], "key string, seq long, value string")
    entries = spark.createDataFrame([("k1", 5, "x"), ("k2", 3, "late"), ("k2", 2, "first")], "key string, seq long, value string")
    assert [tuple(r) for r in runs.publish(cache, entries).collect()] == [("k2", 2, "first")]


def test_assembly(spark):
    from folioquery.operators import assembly as A

    given = docs(spark, "1\n2\n3\n4", "a", None)
    edits = spark.createDataFrame([(0, 2, 3, "X"), (0, 3, 3, "Y"), (0, 9, 9, "Z"), (1, 1, 1, "b\nc")], "doc_id long, first int, last int, text string")
    assert {r.doc_id: r.text for r in A.apply_edits(given, edits).collect()} == {0: "1\nX\n4", 1: "b\nc", 2: None}
    urls = docs(spark, "http://a.com/x.tar.gz?q", "https://u@h/", "ftp://x", "http://127.0.0.1/", "http://LOCALHOST", None)
    assert [r[0] for r in urls.select(A.url_admissible(F.col("text"))).collect()] == [True, False, False, False, False, False]
    assert [r[0] for r in urls.select(A.source_stem(F.col("text"))).collect()][0] == "x.tar"
    pdf = spark.createDataFrame([(bytearray(b"%PDF-1.7 ... %%EOF\n"),), (bytearray(b"%PDF-1.7"),), (bytearray(b"x %%EOF"),), (None,)], "c binary")
    assert [r[0] for r in pdf.select(A.pdf_problem(F.col("c"))).collect()] == [None, "end", "magic", "empty"]
    files = spark.createDataFrame([("w/chunk_2.fr.md", "b"), ("w/chunk_10.fr.md", "c"), ("w/chunk_1.de.md", "x"), ("n.md", "y")], "path string, text string")
    assert sorted(tuple(r) for r in A.chunk_files(files, "fr").collect()) == [(2, "b"), (10, "c")]
    results = spark.createDataFrame([("a", '[{"cell": "c1", "ok": true}]'), ("b", '{"results": [{"cell": "c2", "ok": false}]}'), ("c", "no")], "path string, text string")
    assert sorted((r.path, r.cell, r.ok) for r in A.result_rows(results, "cell:string,ok:boolean").collect()) == [("a", "c1", True), ("b", "c2", False)]
    saved = A.save_glossary(spark.createDataFrame([("b", "y", "high"), ("a", "x", None)], "source string, target string, confidence string")).first().text
    assert saved == '{"terms":[{"source":"a","target":"x"},{"source":"b","target":"y","confidence":"high"}]}'
    refs = spark.createDataFrame([(0, "x"), (1, "y"), (2, "x")], "ordinal int, value string")
    assert sorted(tuple(r) for r in A.expand_references(refs).collect()) == [(0, "x"), (1, "y")]


def values(spark, rows, make):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [r[0] for r in df.select(make(F.col("v"))).collect()]


def test_expected_values_of_names_and_numbers(spark):
    assert values(spark, ["report.md", "a/report.zh.md", "report.EN-US.docx", "report.pt.md", "x.it.md", "r.zh.en.md", "plain", "a.b/plain"], lambda v: structure.language_path(v, "fr")) == [
        "report.fr.md", "a/report.fr.md", "report.fr.md", "report.fr.md", "x.it.fr.md", "r.fr.md", "plain.fr.md", "a.b/plain.fr.md",
    ]
    assert values(spark, ["report.md", "a/r.zh.md", "x"], lambda v: structure.glossary_path(v, "zh")) == ["report.glossary.zh.json", "a/r.zh.glossary.zh.json", "x.glossary.zh.json"]
    slugs = {"http://u:p@h.com/a%20b": "h-com-a-b", "http://u:p@h.com:80": "h-com-80", "https://h.com/caf%C3%A9+x;v=1?q#f": "h-com-caf-x", "http://h/%E4%B8%AD": "h-中", "http://h/%zz": "h-zz", "x://": "untitled", "http://h/" + "a" * 200: "h-" + "a" * 118, "http://h/" + "a" * 117 + "/b": "h-" + "a" * 117}
    assert values(spark, list(slugs), structure.url_slug) == list(slugs.values())
    cells = {"12,34": 1234.0, " (1,000.5) ": -1000.5, "-3": -3.0, "(-3)": 3.0, "1.": None, "": None, "n/a": None, "+7": 7.0}
    assert values(spark, list(cells), structure.numeric_cell) == list(cells.values())
    order = ["a2", "a02b", "a10", "a" + "9" * 25, "a1" + "0" * 25, "ab"]
    got = spark.createDataFrame([(x,) for x in reversed(order)], "v string").orderBy(structure.natural_key(F.col("v"))).collect()
    assert [r.v for r in got] == order


def test_expected_values_of_texts(spark):
    text = "# Title\n#tag\n\npara one\n| a |\n  # indented\n```\ncode\n```\npara two"
    assert values(spark, [text, "", "~~~\nx"], structure.paragraph_lines) == [2, 0, 0]
    words = {"don't well-known 中文": "en", "don't 中文": "zh", "été a1 中": "zh", "---\nx y z\n---\n中": "zh", "```a b c```中": "zh", "a-b-c 中文": "zh", "": "en"}
    assert values(spark, list(words), structure.language_by_words) == list(words.values())
    assert values(spark, ["see these\tthree  words", "a b c", "`one two three four`"], structure.latin_fragments) == [["see these\tthree  words"], [], []]
    assert values(spark, ["a 中文 b 中 `中文`"], structure.ideograph_fragments) == [["中文"]]
    offsets = spark.createDataFrame([(5, 10), (10, 10), (12, 10), (100, 10), (0, 4), (None, 4)], "n int, w int")
    assert [r[0] for r in offsets.select(pages.sample_offsets(F.col("n"), F.col("w"), 4)).collect()] == [[0], [0], [0, 1, 2], [0, 30, 60, 90], [0], [0]]
    head = spark.range(1).select(canonical.frontmatter(F.lit('A "b"\n'), F.lit("2024"))).first()[0]
    assert head == '---\ntype: ""\ntitle: "A \\"b\\"\\n"\ndescription: ""\ntags: []\ntimestamp: "2024"\n---\n\n'


def test_parts_of_words_are_matched(spark):
    queries = spark.createDataFrame([(1, "ear marmalade sandwiches"), (2, "ear marmalade"), (3, "a bear"), (4, "unknown words in here"), (5, "")], "query_id long, text string")
    body = spark.createDataFrame([("x", "a bear marmalade sandwiches"), ("y", "a bear"), ("z", "bear marmalades")], "node_id string, text string")
    got = sorted((r.query_id, r.node_id, r.exact) for r in pages.match_body(queries, body).collect())
    assert got == [(1, "x", False), (2, "x", False), (2, "z", False), (3, "y", True)]


def test_ledger_ids_and_terms_with_any_characters(spark):
    import hashlib
    import json

    text = "The API is fast.\nan api \\E( x [a] api-x 中文 中文"
    rows = [(k, t, None) for k, t in enumerate(["api", "\\E(", "[a]", "中文", "the  API", " ", "is fast"])] + [(9, "Api", "acronym")]
    out = terms.occurrence_ledger(docs(spark, text), spark.createDataFrame(rows, "term_id int, source string, kind string")).collect()
    found = {}
    for r in sorted(out, key=lambda r: (r.term_id, r.offset)):
        assert text[r.offset : r.offset + r.length].lower() == r.source.lower() and r.line == text.count("\n", 0, r.offset) + 1
        found.setdefault(r.term_id, []).append(r)
    assert {k: len(v) for k, v in found.items()} == {0: 3, 1: 1, 2: 1, 3: 2, 6: 1, 9: 3}
    sha = hashlib.sha256(text.encode()).hexdigest()

    def key(**parts):
        return hashlib.sha256(json.dumps(parts, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:24]

    for group in found.values():
        term = key(kind="term", source=group[0].source.lower(), source_hash=sha, first_offset=group[0].offset)
        assert {r.term_key for r in group} == {term}
        assert [r.occurrence_id for r in group] == [key(kind="occurrence", term_id=term, source_hash=sha, offset=r.offset, length=r.length) for r in group]
    assert [found[k][0].key_item for k in (0, 3, 6, 9)] == [False, False, False, True]


def test_retrieval_without_marks(spark):
    passages = spark.createDataFrame([("p1", "r1", "un été, un ete", "Été"), ("p2", "r1", "ETE", ""), ("p3", "r2", "中文", "")], "passage_id string, ref string, text string, title string")
    wanted = spark.createDataFrame([("t", "été"), ("c", "中")], "term_id string, source string")
    got = sorted((r.term_id, r.place, r.passage_id, r.score) for r in terms.passage_top_k(wanted, passages, 3).collect())
    assert got == [("c", 1, "p3", 1), ("t", 1, "p1", 3), ("t", 2, "p2", 1)]
