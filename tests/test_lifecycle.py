import hashlib
import json

from pyspark.sql import functions as F

from folioquery.functions.markup import convert_script, html_markdown, plain_key
from folioquery.operators import lifecycle, projection


def test_cells_and_attempts(spark):
    cells = spark.createDataFrame([("r", "a", ["x", 'q"'], '{"k":1}'), ("r", "a", None, None), ("r", "b", [], "2")], "run_id string, cell_id string, checks array<string>, input string")
    made = sorted(lifecycle.create_cells(cells).collect(), key=lambda r: (r.cell_id, r.input or ""))
    assert [r.duplicate for r in made] == [True, True, False] and {r.status for r in made} == {"pending"}
    body = json.dumps({"checks": ["x", 'q"'], "id": "a", "input": {"k": 1}}, sort_keys=True, separators=(",", ":"))
    assert hashlib.sha256(body.encode()).hexdigest() in {r.input_hash for r in made}
    tries = [("r", "a", 1, False), ("r", "a", 2, True), ("r", "a", 3, True), ("r", "b", 1, False), ("r", "b", 2, False), ("r", "b", 3, False), ("r", "b", 4, True), ("r", "c", 1, False), ("s", "a", 9, None)]
    got = {(r.run_id, r.cell_id): (r.attempts, r.status) for r in lifecycle.attempt_status(spark.createDataFrame(tries, "run_id string, cell_id string, seq int, valid boolean")).collect()}
    assert got == {("r", "a"): (2, "accepted"), ("r", "b"): (3, "failed"), ("r", "c"): (1, "pending"), ("s", "a"): (1, "pending")}


def test_steps_of_reference_stages(spark):
    cells = [
        ("none", "claim", "accepted", True), ("open", "claim", "dispatched", False), ("split", "claim", "split", True), ("ready", "claim", "accepted", True), ("ready", "claim", "split", False),
        ("done", "semantic", "accepted", True), ("bad", "semantic", "failed", True), ("bad", "semantic", "accepted", True), ("wait", "semantic", "dispatched", True),
    ]
    runs = [("none", 0, False, False), ("open", 1, False, False), ("split", 1, False, False), ("ready", 1, False, False), ("done", 1, True, False), ("bad", 1, True, False), ("wait", 1, True, False), ("bare", 1, True, False), ("new", 1, False, False)]
    out = lifecycle.reference_step(spark.createDataFrame(cells, "run_id string, stage string, status string, required boolean"), spark.createDataFrame(runs, "run_id string, references int, semantic_scheduled boolean, final_scheduled boolean"))
    assert {r.run_id: r.step for r in out.collect()} == {
        "none": None, "open": None, "split": None, "ready": "schedule_semantic", "done": "schedule_final", "bad": "mark_incomplete", "wait": None, "bare": None, "new": "schedule_semantic",
    }


def test_older_findings(spark):
    rows = [(5, "q", "s", None, "", "i"), (None, "", None, "c", None, None)]
    df = spark.createDataFrame(rows, "line int, quote string, suggestion string, change string, reason string, issue string")
    one, two = lifecycle.normalised_findings(df, "zh").collect()
    assert ([tuple(x) for x in one.locations], one.original_text, one.revised_text, one.change, one.reason) == ([(5, 5)], "q", "s", "s", "i")
    assert (two.locations, two.original_text, two.change, two.reason) == ([], "[原文缺失]", "c", "Review finding") and two.revised_text.startswith("需作者确认")


def test_parts_formats_and_settings(spark):
    parts = ["docProps/a.xml", "word/header2.xml", "ppt/slides/slide10.xml", "word/document.xml", "ppt/slides/slide9.xml"]
    got = spark.createDataFrame([(p,) for p in parts], "p string").orderBy(projection.part_order(F.col("p"))).collect()
    assert [r.p for r in got] == ["ppt/slides/slide9.xml", "ppt/slides/slide10.xml", "word/document.xml", "word/header2.xml", "docProps/a.xml"]
    formats = spark.createDataFrame([("md,pdf",), ("PDF , Markdown",), ("",), (None,), ("pdf",), ("md,pdf,x",)], "f string")
    assert [r[0] for r in formats.select(projection.formats_problem(F.col("f"))).collect()] == [None, None, None, None, "formats", "formats"]
    arguments = {r.family: r.argument for r in projection.pdf_argument(projection.pdf_properties(spark)).collect()}
    settings = json.loads(arguments["calc"].removeprefix("pdf:calc_pdf_Export:"))
    assert len(settings) == 11 and settings["Quality"] == {"type": "long", "value": "100"} and settings["SinglePageSheets"] == {"type": "boolean", "value": "false"}
    locator = spark.range(1).select(F.create_map(*map(F.lit, ("page", "1", "ocr_version", "2"))).alias("l"))
    assert locator.select(projection.locator_identity(F.col("l"))).first()[0] == {"page": "1"}


HTML = """<html><head><title>x</title></head><body><h1>A &amp; <b>b</b></h1><p>one<br>two <a href="/u">link  t</a><ul><li>x<li>y<ol><li>z</ol></ul>
<pre>a\n  b</pre><table><tr><th>h<td>i|j<tr><td>1</table><blockquote><p>q</blockquote><script>var t="</p>";</script>end <code>c</code> <em> s </em>.<img src=i.png alt=A>"""
MARKDOWN = """# A & **b**

one
two [link t](/u)

- x
- y
  1. z

```
a
  b
```

| h | i\\|j |
| --- | --- |
| 1 |  |

> q

end `c` *s* .![A](i.png)"""


def test_markup(spark):
    df = spark.createDataFrame([(HTML,), (None,), ("",), ("<p>open <b>mark",), ("<table><tr><td>a",), ("plain",)], "h string")
    assert [r[0] for r in df.select(html_markdown("h")).collect()] == [MARKDOWN, None, "", "open mark", "| a |\n| --- |", "plain"]
    assert [r[0] for r in df.select(plain_key(F.lit("<i>Stra\u00dfe</i> &amp; <b>X-1</b>"))).limit(1).collect()] == ["strassex1"]
    convert = convert_script({"ab": "X", "a": "Y"})
    text = spark.createDataFrame([("a ab `ab` http://a/ab {{a}} ba",), (None,)], "t string")
    assert [r[0] for r in text.select(convert(F.col("t"))).collect()] == ["Y X `ab` http://a/ab {{a}} bY", None]
    assert text.select(convert_script({})(F.col("t"))).first()[0].startswith("a ab")
