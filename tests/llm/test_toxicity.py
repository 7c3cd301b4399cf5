import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioquery.llm.toxicity import Model, Sample, features, fit, held_out, leveled, op2_nnpu_toxicity, reject_toxic, risk, selected, train, with_scores


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice("alpha beta gamma delta omega sigma".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(20, 120))]
        bad = i % 8 == 0
        if bad:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vilest", "nastyling", "nastyous", "vilest!!"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(1600)
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 3 == 0 or y], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_features_of_words_and_prefixes():
    column = pa.array(["Abcdefgh x", None, "abcdefgh! abcd", ""])
    h, rows = features(column)
    by_row = [sorted(h[rows == k].tolist()) for k in range(4)]
    assert len(by_row[0]) == 5 and by_row[1] == by_row[3] == [] and len(by_row[2]) == 5
    assert len(set(by_row[0]) & set(by_row[2])) == 4
    keys, at = leveled(np.array([7, 7, 7, 7, 9], np.uint32), np.zeros(5, int))
    assert sorted(keys.tolist()) == [28, 29, 30, 36] and set(at.tolist()) == {0}


def test_held_out_accuracy(tables):
    docs, labels, truth = tables
    scored = with_scores(docs, train(docs, labels)).where(held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in scored) and len(scored) > 300
    right = sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in scored)
    assert right >= 0.98 * len(scored) and all(0 <= r.score <= 1 for r in scored)


def test_held_out_labels_are_not_read(tables):
    docs, labels, _ = tables
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train(docs, labels), train(docs, flipped)
    assert (a.keys == b.keys).all() and np.allclose(a.weights, b.weights) and a.bias == b.bias


def test_reject_keeps_columns(tables):
    docs, labels, truth = tables
    extra = docs.withColumn("score", F.lit("clash")).withColumn("_toxicity", F.lit(1))
    kept = reject_toxic(extra, labels)
    assert kept.columns == extra.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, y in truth.items() if not y}
    assert len(ids & clean) >= 0.99 * len(clean) and len(ids - clean) <= 5


def test_edge_cases(spark, tables):
    docs, labels, _ = tables
    rows = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "vilest " * 40000)], "doc_id long, text string")
    got = with_scores(rows, train(docs, labels)).collect()
    assert [r.score < 0.3 for r in got] == [True, True, True, False]
    empty = train(docs.limit(0), labels), train(docs, labels.limit(0)), train(docs, labels.withColumn("toxic", F.lit(None).cast("int")))
    assert all(len(m.keys) == 0 for m in empty)
    assert with_scores(rows.limit(0), Model()).count() == 0
    with pytest.raises(ValueError):
        with_scores(rows.withColumn("score", F.lit(1)), Model())


def random_sample(rng, n_p=30, n_u=200, n_keys=40):
    p = [np.unique(np.append(rng.integers(1, n_keys, 6), 0)) for _ in range(n_p)]
    u = [np.unique(np.append(rng.integers(1, n_keys, 6), [0] if k % 10 == 0 else [])).astype(int) for k in range(n_u)]
    row = lambda docs: np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return p, u, Sample(row(p), np.concatenate(p), row(u), np.concatenate(u), n_p, n_u, n_keys)


def test_risk_and_gradient_against_a_plain_loop():
    rng = np.random.default_rng(4)
    p, u, sample = random_sample(rng)
    weights, prior = rng.normal(0, 0.7, 41), 0.13

    def plain(w):
        z = lambda d: w[40] + sum(w[k] for k in d)
        loss = lambda x: math.log1p(math.exp(-x))
        toxic = prior * sum(loss(z(d)) for d in p) / len(p)
        clean = sum(loss(-z(d)) for d in u) / len(u) - prior * sum(loss(-z(d)) for d in p) / len(p)
        return toxic, clean

    toxic, clean, of_toxic, of_clean = risk(weights, sample, prior)
    assert (toxic, clean) == pytest.approx(plain(weights), rel=1e-12)
    for k in range(41):
        up, down = weights.copy(), weights.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        a, b = plain(up), plain(down)
        assert of_toxic[k] == pytest.approx((a[0] - b[0]) / 2e-5, abs=1e-8)
        assert of_clean[k] == pytest.approx((a[1] - b[1]) / 2e-5, abs=1e-8)


def test_training_keeps_the_corrected_risk_from_falling_below_zero():
    p, u, sample = random_sample(np.random.default_rng(0))
    model = fit(np.arange(40, dtype=np.uint32), sample, 0.1)
    _, clean, _, _ = risk(np.append(model.weights, model.bias), sample, 0.1)
    assert clean > -0.01 and np.isfinite(model.weights).all() and model.bias < -1 and model.weights.argmax() == 0


def test_selection_against_a_plain_loop(spark):
    rng = random.Random(6)
    counts = [(k, rng.randrange(40), rng.randrange(60)) for k in range(500)]
    got = selected(spark.createDataFrame(counts, "key long, p long, u long"), 50, 400, 30).tolist()
    scores = {}
    for key, p, u in counts:
        a, b = min(p / 50, 1 - 1e-9), (u + 1) / 402
        if p >= 3 and a >= 2.5 * b and (g := 100 * (a * math.log(a / b) + (1 - a) * math.log((1 - a) / (1 - b)))) >= 24:
            scores[key] = g
    assert got == sorted(sorted(scores, key=lambda k: (-scores[k], k))[:30])


def test_only_labelled_documents_are_sampled(tables):
    docs, labels, _ = tables
    known = labels.select("doc_id")
    a, b = train(docs, labels), train(docs.join(known, "doc_id", "left_semi"), labels)
    assert (a.keys == b.keys).all() and np.allclose(a.weights, b.weights)


def test_query_columns(spark):
    out = op2_nnpu_toxicity(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
