import hashlib
import re
from collections import Counter

import pytest

from folioquery.llm.common import numbered
from folioquery.llm.mixing import digest, mix, mixing_plan, source_targets, word_count

DOCS = [(i, " ".join(["w"] * (i % 7 + 1)), s) for i, s in enumerate(["a"] * 300 + ["b"] * 30 + ["c"] * 40 + [None] * 60 + ["zero"] * 3)]
DOCS = [(i, None if s == "zero" else t, s) for i, t, s in DOCS] + [(7, "w", "a"), *[(None, "w w\tw", "b")] * 9, *[(55, "w w", None)] * 4, (9999, "", "c")]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * left / w for s in order}
        over = {s for s in order if target[s] > 3 * sizes[s]}
        if not over - capped:
            return target
        capped |= over


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(a, b, c, "x", 1.5) for a, b, c in rows], "doc_id long, text string, source string, size string, target double")


def test_plan_matches_brute_force(spark):
    from pyspark.sql import functions as F

    df = frame(spark)
    measured = df.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest().alias("digest"))
    out = mixing_plan(numbered(measured, "digest", "ordinal")).collect()
    sizes, by_source = [(d, s, len(re.findall(r"[^ \t-\r]+", t or "")), t) for d, t, s in DOCS], {}
    seen = Counter()
    for _, s, n, _ in sizes:
        by_source[s] = by_source.get(s, 0) + n
    target = brute_targets(by_source)
    expect = []
    for d, s, n, t in sizes:
        rate = target[s] / by_source[s] if by_source[s] else 0
        key = hashlib.md5("\x1f".join(["mix", "" if d is None else str(d), s or "", t or ""]).encode()).hexdigest()
        seen[key] += 1
        u = int(hashlib.md5(f"{key}:{seen[key]}".encode()).hexdigest()[:13], 16) / 16**13
        expect.append((str(d), str(s), n, by_source[s], round(target[s], 6), n * (int(rate) + (u < rate - int(rate)))))
    assert sorted((str(r.doc_id), str(r.source), r.size, r.source_size, round(r.target, 6), r.taken) for r in out) == sorted(expect)
    for s in by_source:
        taken = sum(r.taken for r in out if r.source == s)
        assert taken <= 3 * by_source[s] and abs(taken - target[s]) <= 0.35 * by_source[s] + 5


def test_mix_repeats_rows_and_keeps_columns(spark):
    df = frame(spark)
    out = mix(df)
    assert out.columns == df.columns
    again = sorted(map(str, mix(df.repartition(5)).collect()))
    assert sorted(map(str, out.collect())) == again


def test_rows_that_are_equal_have_a_draw_each(spark):
    rows = [(None, "a b c", "x")] * 1000 + [(i, "w", "y") for i in range(3000)]
    df = frame(spark, rows).repartition(7)
    out = mix(df)
    counts = out.groupBy("source").count().collect()
    targets = brute_targets({"x": 3000, "y": 3000})
    for r in counts:
        size = 3 if r.source == "x" else 1
        assert abs(r["count"] * size - targets[r.source]) <= 0.05 * targets[r.source]
    assert sorted(map(str, out.collect())) == sorted(map(str, mix(frame(spark, rows[::-1])).collect()))


def test_names_that_the_operator_uses_itself(spark):
    names = ["_source", "_rate", "rate", "digest", "ordinal", "part", "base", "copy", "n", "rate_source", "a.b", "Copy_"]
    df = spark.createDataFrame([(i % 5, "w w", "s", *range(len(names))) for i in range(50)], ["doc_id", "text", "source", *names])
    out = mix(df)
    assert out.columns == df.columns and out.count() > 0
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))}


def test_long_texts(spark):
    out = mix(frame(spark, [(1, "word " * 400_000, "a"), (2, "x" * 1_000_000, "b")])).collect()
    assert {len(r.text) for r in out} <= {2_000_000, 1_000_000} and out


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "b")]])
def test_nothing_to_mix(spark, rows):
    assert mix(frame(spark, rows)).count() == 0


def test_targets_stop_at_three_times(spark):
    sizes = {"a": 1, "b": 1000, "c": 2, "d": 50, "e": 0}
    out = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert out == pytest.approx(brute_targets(sizes))
