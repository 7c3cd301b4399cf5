import random

import pytest
from pyspark.sql import functions as F

from folioquery.llm.line_dedup import dedup_lines, half_keys, op7_line_dedup, within_one


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, min_chars=20):
    order = sorted((d is not None, d or 0, k, l.strip(" \t\r"), r) for r, (d, t) in enumerate(rows) if t is not None for k, l in enumerate(t.split("\n")))
    gone = set()
    for i, (_, _, k, line, r) in enumerate(order):
        if len(line) >= min_chars and any(len(x[3]) >= min_chars and abs(len(x[3]) - len(line)) <= 1 and distance(x[3], line) <= 1 for x in order[:i]):
            gone.add((r, k))
    return [None if t is None else "\n".join(l for k, l in enumerate(t.split("\n")) if (r, k) not in gone) for r, (d, t) in enumerate(rows)]


def varied(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randrange(17, 48))) for _ in range(12)]
    rows = []
    for doc in range(n):
        lines = []
        for _ in range(rng.randrange(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(line))
                line[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", "a"])
            lines.append(rng.choice(["", " ", "\t"]) + "".join(line))
        rows.append((doc if doc else None, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = varied(seed, 60)
    df = spark.createDataFrame([(a, b, "clash", [1]) for a, b in rows], "doc_id long, text string, row string, place array<int>").repartition(3)
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == {d: t for (d, _), t in zip(rows, brute(rows), strict=True)}
    assert dedup_lines(df).columns[:4] == df.columns


def test_halves_of_neighbours_share_a_key(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(rng.choice("abcdé") for _ in range(rng.randrange(20, 60)))
        at = rng.randrange(len(a))
        b = a[:at] + rng.choice(["", "Z", "Z" + a[at]]) + a[at + 1 :]
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").where(F.length("b") >= 20)
    assert df.where(F.size(F.array_intersect(half_keys(F.col("a")), half_keys(F.col("b")))) == 0).count() == 0


def test_defined_cases(spark):
    line, other = "a line that is long enough", "another line, long enough as well"
    long = "word " * 30000
    rows = [
        (1, None), (2, ""), (3, line + "\nshort\nshort"), (4, f"short\n{line}.\n{other}"), (4, f"short\n{line}.\n{other}"), (4, f"{other}!"),
        (5, f"{line}\n{line}"), (6, long), (7, long.strip() + "x\n"), (8, other.upper()),
    ]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, i): r for i, r in enumerate(out)}
    assert len(out) == len(rows)
    assert got[1, 0].text is None and got[2, 1].text == "" and got[3, 2].text == rows[2][1] and got[3, 2]._removed == []
    same = [r for (d, _), r in got.items() if d == 4]
    assert same[0] == same[1] and "short" in same[0].text and line not in same[0].text
    assert sum(other in (r.text or "") for r in same) in (1, 2)
    assert got[5, 6].text == "" and got[5, 6]._kept_in == [3, 5] or got[5, 6]._kept_in == [3]
    assert got[6, 7].text == long and got[7, 8].text == "" and got[8, 9].text == other.upper()
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_within_one():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert within_one(a, b) == (distance(a, b) <= 1), (a, b)


def test_short_lines_in_the_query(spark, tmp_path):
    line = "a line that is long enough"
    rows = [(1, f"Les.\n\n{line}"), (2, "Les.\nLes!\n}\n"), (3, f"}}\n Les. \nLes!\n\n{line}s")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.removed, r.kept_in) for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][1], "", ""), 2: ("Les!\n}\n", "0", "1"), 3: ("", "0,1,2,4", "1,2")}


def test_names_that_the_operator_uses_itself(spark):
    df = spark.createDataFrame([(1, "a line that is long enough\nx", 5, 6, 7), (2, "a line that is long enough\ny", 5, 6, 7)], "doc_id long, text string, _id int, _row int, _Removed int")
    out = dedup_lines(df)
    assert out.columns == [*df.columns, "__removed", "_kept_in"]
    assert {r.doc_id: (r.text, r._id, r._row, r._Removed, r["__removed"]) for r in out.collect()} == {1: (df.first().text, 5, 6, 7, []), 2: ("y", 5, 6, 7, [0])}
