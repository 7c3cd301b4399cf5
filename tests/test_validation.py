from pyspark.sql import functions as F

from folioquery.operators import validation as V


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_focus_and_categories(spark):
    got = values(spark, V.focus_checks(F.col("f")), [("ALL",), (None,), ("style",), ("x",)], "f string")
    assert got == [V.FOCUS_CHECKS["all"]] * 2 + [["style"], None]
    got = values(spark, V.dimensions(F.col("c")), [(["grammar", "logic", "style"],), ([],)], "c array<string>")
    assert got == [["grammar-style", "logic-consistency"], []]
    rows = [("local", None, ["grammar", "logic"]), ("reference", "adjudication", []), ("reference", "other", []), ("x", None, ["logic"])]
    got = values(spark, V.allowed_categories(F.col("s"), F.col("d"), F.col("c")), rows, "s string, d string, c array<string>")
    assert got == [["spelling", "grammar", "logic"], ["fact", "contradiction", "unsupported"], [], []]


def test_findings(spark):
    finding = {k: F.col(k) for k in ("start", "end", "original", "category", "severity")}
    column = V.finding_problems(finding, F.col("lines"), F.lit(1), F.lit(3), F.array(F.lit("style")))
    lines = ["one two", "three", "four", "five"]
    rows = [(1, 2, "two\nthree", "style", None, lines), (2, 1, "x", "style", "high", lines), (4, 4, "five", "logic", "worst", lines), (None, None, None, None, None, lines)]
    got = values(spark, column, rows, "start int, end int, original string, category string, severity string, lines array<string>")
    assert got == [[], ["bounds", "verbatim"], ["outside", "category", "severity"], ["bounds", "outside", "verbatim", "category"]]
    assert values(spark, V.location_problems(F.col("a"), F.col("b")), [(1, 1), (0, 3), (5, 4), (None, 1)], "a int, b int") == [[], ["start"], ["end"], ["start", "end"]]
    bound = V.binding_problems({"a": F.col("a"), "b": F.lit(1)}, {"a": F.col("b"), "b": F.col("b")})
    assert values(spark, bound, [(None, None), (1, 1)], "a int, b int") == [["b"], []]


def test_cells(spark):
    plan = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "cell_id string")
    results = spark.createDataFrame([("a", "h", 1, None), ("b", "h", 0, ["x"]), ("c", "h", 0, [])], "cell_id string, result_hash string, findings int, problems array<string>")
    attempts = spark.createDataFrame([("a", "accepted", "h"), ("b", "accepted", "h")], "cell_id string, ledger_status string, accepted_hash string")
    got = {r.cell_id: (r.status, r.errors) for r in V.collect_results(plan, results, attempts).collect()}
    assert got == {"a": ("accepted", []), "b": ("FAILED", ["x"]), "c": ("valid_unaccepted", []), "d": ("FAILED", ["no_result"])}
    got = {r.cell_id: (r.status, r.errors) for r in V.collect_results(plan, results, attempts.withColumn("accepted_hash", F.lit("old")), True).collect()}
    assert got["a"] == ("FAILED", ["result_changed"]) and got["c"] == ("FAILED", ["not_accepted"])
    cells = spark.createDataFrame([("x", [1, 2, 3]), ("y", [1])], "cell_id string, items array<int>")
    assert [tuple(r) for r in V.split_cell(cells, "items").collect()] == [("x.a", [1], "x", None), ("x.b", [2, 3], "x", None), ("y", [1], None, "indivisible")]
    once = V.exactly_once(plan, spark.createDataFrame([("a",), ("a",), ("z",)], "cell_id string"), ["cell_id"]).first()
    assert (once.missing, once.unknown, once.duplicate, once.ok) == (3, 1, 1, False)
    assert V.exactly_once(plan, plan, ["cell_id"]).first().ok
    room = V.stage_room(spark.range(61).select(F.lit("s").alias("stage"))).first()
    assert room.cells == 61 and not room.within


def test_checks_pass(spark):
    rows = [({"a": "pass", "b": "pass"}, ["warning"]), ({"a": "pass"}, []), ({"a": "pass", "b": "pass"}, ["error"]), (None, None)]
    assert values(spark, V.passes(F.col("c"), F.col("s"), ["a", "b"]), rows, "c map<string,string>, s array<string>") == [True, False, False, False]


def test_assets_and_paths(spark):
    rows = [("image/png", b"\x89PNG\r\n\x1a\nxx"), ("image/png", b"GIF89a"), ("image/webp", b"RIFF0000WEBP"), ("text/plain", b"x"), ("image/svg", b"x")]
    got = values(spark, V.asset_problem(F.col("m"), F.col("c")), [(m, bytearray(c)) for m, c in rows], "m string, c binary")
    assert got == [None, "magic_mismatch", None, "not_an_image", "unsupported"]
    rows = [("a", "a", True, True, False), ("d/", "d/x", False, False, False), ("b", "a", False, False, False), ("b", "a", True, True, True), ("b", "a", True, True, False), ("b", "a", True, False, False), ("http://a", "http://a", False, False, False)]
    got = values(spark, V.target_action(*[F.col(c) for c in "tseor"], F.lit(True)), rows, "t string, s string, e boolean, o boolean, r boolean")
    assert got == ["refuse", "refuse", "write", "rename", "overwrite", "collision", "write"]
    assert values(spark, V.is_within(F.col("a"), F.col("b")), [("a/b", "a"), ("ab", "a"), ("a", "a/")], "a string, b string") == [True, False, True]
    assert values(spark, V.result_file(F.col("a")), [("x y/z",)], "a string") == ["x__y__z.json"]
    assert values(spark, V.safe_stem(F.col("a")), [("..é a..",), ("._",), ("ok",), ("ok.tar.gz",), (".hidden",)], "a string") == ["a", "reference", "ok", "ok.tar", "hidden"]
    assert values(spark, V.relationship_part(F.col("a")), [("word/document.xml",), ("x.xml",)], "a string") == ["word/_rels/document.xml.rels", "_rels/x.xml.rels"]
    rows = [("letter " * 8,), ("short",), ("letter " * 8 + "�",), (None,), ("letter " * 8 + V.MOJIBAKE[1],)]
    assert values(spark, V.readable(F.col("a"), F.replace("a", F.lit(" ")), F.lit("suspected_garbled_text")), rows, "a string") == [True, False, False, False, False]
    assert values(spark, V.readable(F.col("a"), F.col("a"), F.lit("scanned")), rows[:1], "a string") == [False]


def test_images_and_shards(spark):
    nodes = spark.createDataFrame([(1, 0, "image", "a", "x"), (1, 1, "paragraph", None, "p"), (1, 2, "image", "b", "y"), (1, 3, "image", "a", "z")], "doc_id long, ordinal int, type string, asset_id string, text string")
    found = spark.createDataFrame([("a", "seen"), ("b", "late")], "asset_id string, text string")
    got = [(r.ordinal, r.type, r.text) for r in V.enrich_images(nodes, found, 1).orderBy("ordinal").collect()]
    assert got == [(0, "image", "x"), (1, "paragraph", "seen"), (2, "paragraph", "p"), (3, "image", "y"), (4, "image", "z"), (5, "paragraph", "seen")]
    assets = spark.createDataFrame([(1, 2, "p", "h"), (1, 1, "p", "h"), (1, 2, "q", "h")], "doc_id long, shard int, part string, sha256 string")
    warned = spark.createDataFrame([(1, 1, "c", "m"), (1, 2, "c", "m")], "doc_id long, shard int, code string, message string")
    a, w = V.merge_shards(assets, warned)
    assert sorted((r.part, r.shard, r.asset) for r in a.collect()) == [("p", 1, 1), ("q", 2, 2)] and [(r.shard, r.times) for r in w.collect()] == [(1, 2)]
