import hashlib

from pyspark.sql import functions as F

from folioquery.llm.fingerprints import MASK, N_SUMS, N_WORDS, add, as_text, edited_text, fingerprint, id_ranges, likeness, subtract, with_next


def value(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(fingerprint("t").alias("f")).first().f


def test_sums_are_those_of_the_paragraphs(spark):
    text = "one\ntwo\n\nétwo. three! four"
    got = value(spark, text)
    for k in range(N_SUMS):
        assert got[k] == sum(int(hashlib.sha256(p.encode()).hexdigest()[15 * k : 15 * k + 15], 16) for p in text.split("\n")) & MASK
    assert got[N_SUMS] == 6
    assert value(spark, "two\none\nétwo. three! four\n") == got
    assert value(spark, None) == value(spark, "")


def test_insertion_and_deletion(spark):
    df = spark.createDataFrame([("a\nb", "c. d", "a\nb\nc. d")], "x string, y string, z string")
    r = df.select(*[fingerprint(c).alias(c) for c in "xyz"]).select(
        (add(F.col("x"), F.col("y")) == F.col("z")).alias("added"), (subtract(F.col("z"), F.col("y")) == F.col("x")).alias("taken")
    )
    assert r.first() == (True, True)


def test_likeness(spark):
    left = "\n".join(f"sentence number {i}." for i in range(200))
    right = "\n".join(f"sentence number {i}." for i in range(100, 300))
    other = "\n".join(f"another text {i}." for i in range(200))
    df = spark.createDataFrame([(left, right, other)], "l string, r string, o string").select(*[fingerprint(c).alias(c) for c in "lro"])
    same, half, none = df.select(likeness(F.col("l"), F.col("l")), likeness(F.col("l"), F.col("r")), likeness(F.col("l"), F.col("o"))).first()
    assert same == 1.0 and 0.2 < half < 0.8 and none < 0.4
    assert df.select(F.length(as_text(F.col("l")))).first()[0] == 16 * N_WORDS


def test_counts_of_a_million_sentences_stay_apart(spark):
    n = (1 << 20) + 5
    df = spark.createDataFrame([("a\n" * (n - 1) + "a", "a\n" * (n - 1) + "b", "b\n" * (n - 1) + "b")], "l string, r string, o string").select(*[fingerprint(c).alias(c) for c in "lro"])
    bits = int(hashlib.md5(b"a").hexdigest()[:15], 16)
    words = df.select("l").first().l
    for j in range(29):
        assert words[N_SUMS + 1 + j] == n * (bits >> j & 1) + (n * (bits >> (j + 31) & 1) << 31)
    near, far = df.select(likeness(F.col("l"), F.col("r")), likeness(F.col("l"), F.col("o"))).first()
    assert 0.9999 < near < 1 and far < 0.5


def test_ranges_are_even_for_ids_in_clusters(spark):
    ids = [-(2**63), 2**63 - 1, 10**15] + list(range(3000)) + [10**12 + 1000 * i for i in range(3000)] + [7] * 40
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long")
    got = df.select("doc_id", id_ranges(df, block=16).alias("r")).collect()
    assert [r.r for r in got if r.doc_id is None] == [-1]
    order = [r.r for r in sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id)]
    assert order == sorted(order) and order[0] >= 0
    sizes = {x: order.count(x) for x in set(order)}
    assert max(sizes.values()) <= 16 + 40 + 16 and len(sizes) > len(ids) / 40


def test_next_document(spark):
    rows = [(i * 7919 % 3001, f"t{i}") for i in range(1500)] + [(5, None), (5, None), (5, "x"), (None, "null id"), (10**12, "far")]
    df = spark.createDataFrame([(a, b, "clash", 0) for a, b in rows], "doc_id long, text string, value string, range int").repartition(3)
    got = sorted(map(str, with_next(df, F.length("text"), block=16).collect()))
    texts = sorted(((a is not None, a or 0, b or ""), a, b or "") for a, b in rows)
    want = []
    for k, (_, a, b) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][2]
        want.append(str((a, b, len(b), after, len(after))))
    got = [g.replace("Row(doc_id=", "(").replace("text=", "").replace("value=", "").replace("next_", "") for g in got]
    assert sorted(got) == sorted(want)


def test_single_and_empty(spark):
    schema = "doc_id long, text string"
    wide = with_next(spark.createDataFrame([(-(2**63), "low"), (2**63 - 1, "high"), (0, "mid")], schema), block=2).collect()
    assert {r.text: r.next_text for r in wide} == {"low": "mid", "mid": "high", "high": "low"}
    assert with_next(spark.createDataFrame([(3, "abc")], schema)).first().next_text == "abc"
    assert with_next(spark.createDataFrame([], schema)).count() == 0
    assert with_next(spark.createDataFrame([(None, None)], schema)).first().next_text == ""


def test_edited_text(spark):
    rows = [("abcde", "xyz"), ("abcdef", "x"), ("", "x"), ("é", "x"), ("ab", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(edited_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["abcxy", "abcx", "", "é", "a"]
