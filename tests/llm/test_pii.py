import datetime
import hmac
import re

import pytest
from pyspark.sql import functions as F

from folioquery.llm.pii import ROUNDS, feistel, found, op8_feistel_pseudonyms, pseudonymise

KEY = "k" * 70  # longer than a block of the hash


def brute_feistel(symbols, radices, kind, key=KEY):
    h = len(symbols) // 2
    left, right, lx, rx = symbols[:h], symbols[h:], radices[:h], radices[h:]
    for r in range(1, ROUNDS + 1):
        other = ",".join(map(str, right))
        new = [(x + int(hmac.new(key.encode(), f"{kind}|{r}|{i}|{other}".encode(), "sha256").hexdigest()[:12], 16)) % lx[i] for i, x in enumerate(left)]
        left, right, lx, rx = right, new, rx, lx
    return left + right


def run(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(found(F.col("t"), KEY).alias("v")).first().v


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_values_against_brute_force(spark):
    text = "dB.7@ex.io, 17.252.227.210; 2020-02-29 ssn 123-45-6789 card 4337-1664-6559-8439 / 4337166598464399 tel +1 (632) 555-4827."
    got = [(v.kind, v.value, v.pseudonym) for v in run(spark, text)]
    assert [g[0] for g in got] == ["email", "ip", "date", "ssn", None, "card", "phone"]
    new = dict((g[0], g[2]) for g in got)
    x = brute_feistel([3, 1, 0, 7], [26, 26, 1, 10], "email")
    assert new["email"] == f"{chr(97 + x[0])}{chr(65 + x[1])}.{x[3]}@ex.io"
    assert new["ip"] == ".".join(map(str, brute_feistel([17, 252, 227, 210], [256] * 4, "ip")))
    n = (datetime.date(2020, 2, 29) - datetime.date(1900, 1, 1)).days
    a, b = brute_feistel([n // 4297, n % 4297], [17, 4297], "date")
    assert new["date"] == str(datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b))
    a, g, s = brute_feistel([122, 44, 6788], [898, 99, 9999], "ssn")
    assert new["ssn"] == f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"
    body = "".join(map(str, brute_feistel([int(c) for c in "33716659846439"], [10] * 14, "card")))
    assert new["card"][:15] == "4" + body and luhn(new["card"])
    low = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]
    x = brute_feistel([int(c) - o for c, o in zip("6325554827", low)], [8 if o else 10 for o in low], "phone")
    d = "".join(str(v + o) for v, o in zip(x, low))
    assert new["phone"] == f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"


def test_permutation(spark):
    df = spark.range(17 * 4297).select(F.array(F.floor(F.col("id") / 4297).cast("long"), F.col("id") % 4297).alias("s"))
    out = df.select(feistel(F.col("s"), F.array(F.lit(17).cast("long"), F.lit(4297).cast("long")), "k", "date").alias("x"))
    assert out.distinct().count() == 17 * 4297
    assert out.where("x[0] < 0 or x[0] > 16 or x[1] < 0 or x[1] > 4296").count() == 0


@pytest.mark.parametrize("text", ["2.0.", "1.2.3", "300.1.1.1", "29.02.2021", "000-12-1234", "666-12-1234", "4337166598464398", "12345678901234567890", "a@b", "x1234567890123456", ""])
def test_invalid_values_stay(spark, text):
    assert all(v.kind is None and v.pseudonym == v.value for v in run(spark, text))


def test_dates_with_the_day_first_and_with_a_time(spark):
    years = [1900, 1904, 1999, 2000, 2024, 2096, 2099]
    every = [datetime.date(y, 1, 1) + datetime.timedelta(k) for y in years for k in range(366 if y % 4 == 0 and y > 1900 else 365)]
    first = [f"{d:%d/%m/%Y}" for d in every if d.day > 12]
    got = run(spark, " ".join(first))
    assert [v.value for v in got] == first and {v.kind for v in got} == {"date"}
    new = [v.pseudonym for v in got]
    assert len(set(new)) == len(first) and sum(a == b for a, b in zip(first, new)) < 20
    assert all(datetime.datetime.strptime(x, "%d/%m/%Y").day > 12 and 1900 <= int(x[6:]) <= 2099 for x in new)
    a, b = brute_feistel([124, [*dict.fromkeys(x[:5] for x in first if x[6:] == "1999")].index("25/12")], [200, 221], "day-first")
    assert run(spark, "25/12/2024")[0].pseudonym == f"{[x[:5] for x in first if x[6:] == '1999'][b]}/{a + 1900}"
    assert [v.kind for v in run(spark, "29/02/2023 31/04/2024 25/13/2024 25/12/1899 29/02/1900 12/25/2024")] == [None] * 5 + ["date"]
    stamps = run(spark, "2024-05-01T10:00:00Z 2024-05-01 2024-05-01Tx 2024-05-01t1000")
    assert [(v.kind, v.value) for v in stamps] == [("date", "2024-05-01")] * 3 and len({v.pseudonym for v in stamps}) == 1
    text = pseudonymise(spark.createDataFrame([("at 2024-05-01T10:00:00Z.",)], "text string"), KEY).first().text
    assert text == f"at {stamps[0].pseudonym}T10:00:00Z."


def test_rows_columns_and_links(spark):
    rows = [(1, "a@b.co 4918 1871 2863 5271", "c"), (1, "a@b.co 4918 1871 2863 5271", "c"), (None, None, None), (2, "", "x"), (3, "4918187128635271 " + "word " * 20000 + "a@b.co", "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = pseudonymise(df, KEY).collect()
    assert [(r.doc_id, r.kind) for r in out] == [(r[0], r[2]) for r in rows]
    assert out[0].text == out[1].text != rows[0][1] and out[2].text is None and out[3].text == "" and out[3]._pii == []
    assert re.sub(r"\D", "", out[0].text.split(" ", 1)[1]) == out[4].text.split(" ")[0]
    assert out[4].text.endswith(out[0].text.split(" ")[0]) and "word word" in out[4].text
    assert pseudonymise(df.limit(0), KEY).count() == 0


def test_query_counts(spark):
    out = op8_feistel_pseudonyms(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) == 200 and out[["n_email", "n_ip", "n_card", "n_phone"]].sum().min() > 0


def test_column_of_the_same_name(spark):
    out = pseudonymise(spark.createDataFrame([("a@b.com", 1, 2)], "text string, _pii int, x int"), KEY)
    assert out.columns == ["text", "_pii", "x", "__pii"]
    r = out.first()
    assert r._pii == 1 and r.text != "a@b.com" and r["__pii"][0].kind == "email"
