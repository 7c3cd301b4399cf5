import random

import pytest

from folioquery.functions.text import align, strip_marks, target_present, unified_diff, visible_signature
from folioquery.operators.review import ingest
from folioquery.plans.runs import page_alignment
from folioquery.sources import glossary as G
from folioquery.streaming.ingest import ingest_stream


def texts(spark, **files):
    return spark.createDataFrame([(k.replace("_", "."), v) for k, v in files.items()], "path string, text string")


@pytest.mark.parametrize(
    "name, text",
    [
        ("a.json", '{"cat": "chat", "dog": "chien"}'),
        ("a.json", '[{"source": "cat", "target": "chat"}, {"term": "dog", "translation": "chien"}]'),
        ("a.json", '[["cat", "chat"], ["dog", "x"], ["dog", "chien"]]'),
        ("a.json", '{"terms": [{"source": " cat ", "target": "chat"}, {"source": "dog", "target": "chien"}, {"source": "", "target": "q"}]}'),
        ("a.csv", "Source,Target\ncat,chat\ndog,old\ndog,chien\n"),
        ("a.tsv", "note\ttranslation\tterm\nx\tchat\tcat\ny\tchien\tdog"),
        ("a.csv", 'cat;chat\n"dog";"chien"\n'),
        ("a.csv", "cat|chat\ndog|chien"),
        ("a.md", "# T\n\n| Term | Translation |\n|---|:--|\n| cat | chat |\n| dog | chien |\n"),
        ("a.unknown", '{"cat": "chat", "dog": "chien"}'),
        ("a.unknown", "cat,chat\ndog,chien"),
    ],
)
def test_glossaries(spark, name, text):
    rows = G.read_glossaries(spark.createDataFrame([(name, text)], "path string, text string")).collect()
    assert sorted((r.source, r.target, r.confidence) for r in rows) == [("cat", "chat", "high"), ("dog", "chien", "high")]


def test_quoted_fields(spark):
    rows = G.from_csv(spark.createDataFrame([("a.csv", 'source,target\n"a, ""b""",c\n')], "path string, text string")).collect()
    assert [(r.source, r.target) for r in rows] == [('a, "b"', "c")]


def test_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.json").write_text('{"x": "y"}')
    (tmp_path / "b" / "c.csv").write_text("source,target\nu,v\n")
    (tmp_path / "d.json").write_bytes(b"\xff\xfe")
    (tmp_path / "e.exe").write_text("no")
    files = G.text_files(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["a.json", "c.csv"]
    assert sorted((r.source, r.target) for r in G.read_glossaries(files).collect()) == [("u", "v"), ("x", "y")]
    records = G.source_records(spark.read.format("binaryFile").load(str(tmp_path / "a.json"))).first()
    assert records.size_bytes == 10 and records.media_type == "application/json"


def test_unicode_functions(spark):
    df = spark.createDataFrame([("Été", "un ÉTÉ chaud"), ("ete", "compete"), ("中文", "x中文y"), (None, "a")], "t string, x string")
    rows = df.select(target_present(df.t, df.x).alias("p"), strip_marks(df.x).alias("s"), visible_signature(df.x).alias("v")).collect()
    assert [r.p for r in rows] == [True, False, True, None]
    assert rows[0].s == "un ete chaud" and rows[0].v.signature == "unétéchaud" and rows[0].v.offsets[:3] == [0, 1, 3]
    d = spark.createDataFrame([("a\nb", "a\nc"), ("a", "a"), (None, "")], "a string, b string").select(unified_diff("a", "b").alias("d")).collect()
    assert "-b" in d[0].d and "+c" in d[0].d and d[1].d == d[2].d == ""


def test_page_alignment():
    page = "".join(chr(97 + (k * k) % 23) + str(k) for k in range(200))
    assert align("xx" + page + "yy", page) == (2, 2 + len(page))
    assert align(page + page, page) is None and align("abc", "") is None
    changed = page[:300] + "#" + page[301:]
    assert align("xx" + changed + "yy", page) == (2, 2 + len(page))


def test_page_alignment_is_proven_to_both_ends():
    page = "".join(chr(97 + (k * k) % 23) + str(k) for k in range(200))
    for at in (9, 20, len(page) - 10):  # between the ends and the windows that agree
        assert align("xx" + page[:at] + "#" + page[at + 1 :] + "yy", page) is None
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    # two windows of each width agree, at six places of the page together
    damaged = long[:170] + "".join("#" if k % 20 == 0 else c for k, c in enumerate(long[170:-170])) + long[-170:]
    assert align("xx" + damaged + "yy", long) == (2, 20_002)
    assert align("xx" + page[50:] + "yy", page) is None


def test_page_alignment_query_despite_case_and_first_words(spark, tmp_path):
    rng = random.Random(8)
    quote, other = (" ".join("".join(rng.choice("abcdefgé") for _ in range(5)) for _ in range(30)) for _ in range(2))
    upper = quote.upper().replace(" ", ",\n")
    texts = ["One. " + quote, f"Two: {upper}!", "x" + quote[1:], f"{upper} / {upper}", other, None, "", "Q w-Z 9", quote[:60] + "zz" + quote[90:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, quote), (2, "q wz9"), (3, "..."), (4, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r.doc_id, r.item_id): (r.start, r.end) for r in page_alignment(spark, str(tmp_path)).collect()}
    none = (None, None)
    assert got == {(0, 1): (3, 153), (1, 1): (3, 153), (2, 1): none, (3, 1): none, (7, 2): (0, 4), (8, 1): none}


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [(e % 5, e, "ab"[e % 4 == 0], e % 3 != 0, e % 11 == 0) for e in range(1, 200)]
    schema = "cell_id long, seq long, payload string, valid boolean, stale boolean"
    for k in range(4):
        spark.createDataFrame(rows[k * 50 : (k + 1) * 50], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = ingest_stream(stream).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.cell_id, r.seq): r.outcome for r in spark.table("outcomes").collect()}
    want = {(r.cell_id, r.seq): r.outcome for r in ingest(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(got) == 199


def test_fields_with_line_ends_and_one_known_header(spark):
    files = [("a.csv", 'Term,Note,To\n"two\nlines",x,y\n'), ("b.csv", "Source,Rest\nu,v\n"), ("c.csv", ""), ("d.csv", None)]
    got = sorted((r.path, r.source, r.target) for r in G.from_csv(spark.createDataFrame(files, "path string, text string")).collect())
    assert got == [("a.csv", "two\nlines", "y"), ("b.csv", "Source", "Rest"), ("b.csv", "u", "v")]


def test_structured_glossaries_keep_what_they_have(spark):
    files = [("a.json", '{"terms": [{"source": "u", "target": "v", "confidence": "low", "allowed_targets": ["v", "w"]}, {"source": "u"}]}'), ("b.json", '{"x": "y"}')]
    got = sorted((r.path, r.source, r.confidence, r.origin, tuple(r.allowed_targets)) for r in G.structured(spark.createDataFrame(files, "path string, text string")).fillna("-", ["confidence"]).collect())
    assert got == [("a.json", "u", "-", "user_seed", ()), ("a.json", "u", "low", "user_seed", ("v", "w")), ("b.json", "x", "high", "user_seed", ("y",))]
