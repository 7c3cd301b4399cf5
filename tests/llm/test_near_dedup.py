import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from folioquery.llm.components import components
from folioquery.llm.near_dedup import (
    COUNTERS,
    _counter,
    document_frequencies,
    drop_near_duplicates,
    idf_table,
    near_classes,
    similarities,
    weighted,
    weighted_samples,
)


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def corpus(seed=3):
    """Texts with exact copies, groups of near copies of one base at all similarities, and shared passages."""
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 150)) for _ in range(40)]
    passage = words(rng, 60)
    texts += [words(rng, 70) + passage + words(rng, 30) for _ in range(20)]
    base = words(rng, 200)
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(1, 9)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        texts.append(copy)
    rows = [" ".join(t) for t in texts]
    rows += [rows[5], rows[5], rows[70].upper(), rows[0] + "  ", "", "a b c", "A  b c", "a b d"]
    return list(enumerate(rows)) + [(500, None), (501, ""), (70, rows[70]), (70, rows[70]), (None, rows[90])]


def tfidf(texts):
    """Weighted shingles of all texts by plain Python, but for the counters' hash."""
    import math
    from collections import Counter

    lists = []
    for t in texts:
        w = (t or "").lower().split()
        lists.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    return [{s: 1 + math.log(n) for s, n in c.items()} for c in lists]


def brute_classes(rows):
    """Components under weighted Jaccard >= 0.8 with the module's idf."""
    texts = [t or "" for _, t in rows]
    counts = np.zeros(COUNTERS, np.int64)
    row, shingle, weight = weighted(pa.array(texts), np.ones(COUNTERS, np.float32))
    np.add.at(counts, np.unique(row * COUNTERS + _counter(shingle)) % COUNTERS, 1)
    row, shingle, weight = weighted(pa.array(texts), idf_table(counts, len(texts)))
    sets = [dict(zip(shingle[row == k].tolist(), weight[row == k].tolist(), strict=True)) for k in range(len(texts))]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = sets[a], sets[b]
        low = sum(min(w, y[s]) for s, w in x.items() if s in y)
        if texts[a] == texts[b] or x and y and low >= 0.8 * (sum(x.values()) + sum(y.values()) - low):
            parent[find(a)] = find(b)
    return [find(k) for k in range(len(texts))]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_classes_against_brute_force(spark, rows):
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, node string, component int").repartition(3)
    got = near_classes(df).collect()
    assert len(got) == len(rows)
    groups = {}
    for (doc, _), c in zip(rows, brute_classes(rows), strict=True):
        groups.setdefault(c, []).append(str(doc))
    ours = {}
    for r in got:
        ours.setdefault(str(r.class_id) + ("?" if r.class_id is None else ""), []).append(str(r.doc_id))
        assert r.class_size >= 1
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, groups.values()))


def test_shingle_weights_are_tf_idf(rows):
    texts = [t for _, t in rows]
    row, shingle, weight = weighted(pa.array(texts), np.ones(COUNTERS, np.float32))
    for k, want in enumerate(tfidf(texts)):
        assert np.allclose(sorted(weight[row == k]), sorted(want.values()), rtol=1e-5)
    idf = idf_table(np.array([0, 1, 10, 1000]), 1000)
    assert idf[0] == idf[1] and np.allclose(idf[[1, 3]], [1.25, 1.0]) and idf[2] < idf[1]


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(0)
    universe = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = universe[:300], universe[100:]
    wa, wb = rng.uniform(0.5, 4, 300).astype(np.float32), rng.uniform(0.5, 4, 300).astype(np.float32)
    a, wa = a[np.argsort(a)], wa
    b, wb = b[np.argsort(b)], wb
    true = similarities([a], [wa], [b], [wb])[0, 0]
    low = sum(min(x, dict(zip(b.tolist(), wb.tolist(), strict=True)).get(s, 0)) for s, x in zip(a.tolist(), wa.tolist(), strict=True))
    assert abs(true - low / (wa.sum() + wb.sum() - low)) < 1e-5
    rows_ = np.repeat([0, 1], 300)
    s = weighted_samples(rows_, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 512)
    assert abs((s[0] == s[1]).mean() - true) < 0.08


def test_document_frequencies(spark, rows):
    counts, n = document_frequencies(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    row, shingle, _ = weighted(pa.array([t for _, t in rows]), np.ones(COUNTERS, np.float32))
    want = np.bincount(np.unique(row * COUNTERS + _counter(shingle)) % COUNTERS, minlength=COUNTERS)
    assert n == len(rows) and (counts == want).all()


def test_one_of_each_class_stays(spark, rows):
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, _row int")
    kept = drop_near_duplicates(df).collect()
    classes = {}
    for (doc, text), c in zip(rows, brute_classes(rows), strict=True):
        classes.setdefault(c, []).append((doc is None, doc or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min(v) for v in classes.values())


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "only")], [(1, "x y"), (1, "x y")], [(7, None), (7, "")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_classes(df).count() == len(rows)
    assert drop_near_duplicates(df).count() == min(1, len(rows))


def test_components(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**9), 200)
    edges = list(zip(ids[:100], ids[1:100], strict=False)) + [(ids[100], x) for x in ids[101:150]] + [(ids[160], ids[161]), (ids[161], ids[160]), (ids[170], ids[170])]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[x] for x in ids[:100]} == {min(ids[:100])} and {got[x] for x in ids[100:150]} == {min(ids[100:150])}
    assert got[ids[160]] == got[ids[161]] == min(ids[160:162])


def test_names_that_the_operator_uses_itself(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, 5, 6, 7), (2, text, 5, 6, 7), (2, text, 5, 6, 7), (3, None, 5, 6, 7), (None, "other", 5, 6, 7)], "doc_id long, text string, _id int, _node int, node int")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "3", "None"]


def test_different_shingles_are_never_one_element():
    words = np.arange(1, 200_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    samples = weighted_samples(np.arange(200_000) // 2, words, np.ones(200_000, np.float32), 100_000, 4)
    # four samples take both shingles of a pair but for one case in eight
    assert abs(len(np.unique(samples)) - 100_000 * (2 - 1 / 8)) < 500


def test_long_texts(spark):
    long = " ".join(f"w{i % 9973}x{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "w " * 100_000)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_classes(df).collect()} == {1: 1, 2: 1, 3: 3}
