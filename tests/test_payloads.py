from pyspark.sql import functions as F

from folioquery.operators import payloads as P

LINE = "struct<key:string,x0:double,y0:double,x1:double,y1:double,baseline:double>"


def line(key, top, x0=0.0, height=10.0):
    return (key, x0, top - height, x0 + 100.0, top, top - height + 2)


def test_tail_follows_lines_of_the_same_column(spark):
    page = [line("abcdefghijklmnop", 700.0), line("qr", 688.0), line("qrst", 688.0, 5.0), line("uv", 676.0), line("uvw", 676.0, 90.0), line("x", 500.0)]
    whole = "abcdefghijklmnopqrstuv"
    rows = [(whole, [0], page), (whole + "x", [0], page), (whole[:16], [0], page), ("zz", [0], page), (whole, [1], page), (None, None, None), (whole, [0], page[:2])]
    got = spark.createDataFrame(rows, f"value string, members array<int>, lines array<{LINE}>").select(P.adjacent_tail("value", "members", "lines")).collect()
    assert [r[0] for r in got] == [[2, 3], [], [], [], [], [], []]


def test_tail_takes_32_lines_at_most(spark):
    for more, taken in ((32, 32), (33, 0)):
        keys = ["a" * 16] + [chr(0x4E00 + k) for k in range(more)]
        page = [line(k, 1000.0 - 12 * i) for i, k in enumerate(keys)]
        got = spark.createDataFrame([("".join(keys), [0], page)], f"value string, members array<int>, lines array<{LINE}>").select(P.adjacent_tail("value", "members", "lines")).first()[0]
        assert len(got) == taken


def test_jobs_are_packed_and_a_passage_too_large_is_marked(spark):
    claims = spark.createDataFrame([("r", "a", 10), ("r", "b", 30), ("r", "b", 30)], "run_id string, origin string, chars int")
    passages = spark.createDataFrame([("r", "p1", 20), ("r", "p2", 20), ("r", "p3", 90), ("s", "p", 5)], "run_id string, passage_id string, chars int")
    got = sorted((r.run_id, r.cell_id[-3:], r.origin, r.first, r.passages, r.collects_facts, r.fits, r.dimension) for r in P.semantic_jobs(claims, passages, 90).collect())
    assert got == [
        ("r", "001", "a", "p1", 2, True, True, "semantic-routing"), ("r", "002", "a", "p3", 1, True, False, "semantic-routing"),
        ("r", "003", "b", "p1", 1, False, False, "semantic-routing"), ("r", "004", "b", "p2", 1, False, False, "semantic-routing"), ("r", "005", "b", "p3", 1, False, False, "semantic-routing"),
        ("s", "001", None, "p", 1, True, True, "facts-only"),
    ]


def test_gaps_name_five_ids(spark):
    expected = spark.createDataFrame([("r", f"o{k}") for k in range(9)] + [("r", None), ("q", "x")], "run_id string, occurrence_id string")
    claimed = spark.createDataFrame([("r", "o0"), ("r", "o0"), ("r", "z"), ("q", "x")], "run_id string, occurrence_id string")
    got = [tuple(r) for r in P.occurrence_gaps(expected, claimed).collect()]
    assert got == [("r", 8, 1, 1, "o1, o2, o3, o4, o5", "z")]


def test_reducers_of_no_leaves(spark):
    leaves = spark.createDataFrame([(1, 0), (2, 1), (3, 5)], "doc_id int, leaves int")
    got = sorted((r.doc_id, r.depth, r.batch, r.first, r.last) for r in P.reducer_cells(leaves).collect())
    assert got == [(2, 1, 1, 1, 1), (3, 1, 1, 1, 4), (3, 1, 2, 5, 5), (3, 2, 1, 1, 2)]


def test_empty_ledger(spark):
    ledger = spark.createDataFrame([], "run_id string, occurrence_id string, disposition string, reason string, key_item boolean")
    assert P.ledger_problems(ledger).count() == 0 and P.occurrence_gaps(ledger, ledger).count() == 0
    assert spark.range(1).select(P.math_text(F.lit(None).cast("string"), F.lit(True))).first()[0] == ""
