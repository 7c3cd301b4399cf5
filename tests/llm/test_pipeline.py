import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioquery.llm.mixing import source_targets
from folioquery.llm.packing import load_encoder, default_vocabulary

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read as by the runner."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    out["input"] = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{folder}/{k}")
        docs = out[name] = spark.read.parquet(f"{folder}/{k}")
    return out


def test_order_and_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    for name in names[:-1]:
        assert stages[name].columns == stages["input"].columns


def test_stages_by_hand(stages):
    start = {r.doc_id: r for r in stages["input"].collect()}
    kept = {r.doc_id: r for r in stages["toxicity"].collect()}
    assert set(kept) <= set(start) and len(kept) >= 0.7 * len(start) and all(kept[k] == start[k] for k in kept)
    lines = {r.doc_id: r for r in stages["line_dedup"].collect()}
    assert set(lines) == set(kept)
    seen, repeats = set(), 0
    for k in sorted(lines):
        assert lines[k].n_chars == len(lines[k].text) and set(lines[k].text.split("\n")) <= set(kept[k].text.split("\n")) | {""}
        for line in lines[k].text.split("\n"):
            line = line.strip(" \t\r")
            repeats += len(line) >= 20 and line in seen
            seen.add(line)
    assert repeats == 0
    near = {r.doc_id: r for r in stages["near_dedup"].collect()}
    assert all(near[k] == lines[k] for k in near) and len({r.text for r in near.values()}) == len(near)
    assert {r.text for r in near.values() if len(r.text.split()) < 5} == {r.text for r in lines.values() if len(r.text.split()) < 5}
    mixed = collections.Counter(r.doc_id for r in stages["mixing"].collect())
    size = {k: len(re.findall(r"[^ \t-\r]+", r.text)) for k, r in near.items()}
    assert set(mixed) <= set(near) and max(mixed.values()) <= 3
    total = sum(size.values())
    assert abs(sum(size[k] * n for k, n in mixed.items()) - total) <= 0.3 * total


def test_packed_ids(stages):
    encoder = load_encoder(default_vocabulary())
    mixed = stages["mixing"].collect()
    want = sum(len(encoder.encode_ordinary(r.text or "")) + 1 for r in mixed)
    packed = stages["packing"]
    assert packed.agg(F.sum("length")).first()[0] == want
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, DATA)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, stages["packing"].select(columns).collect()))


def test_targets_of_one_source(spark):
    assert source_targets(spark.createDataFrame([("a", 10)], "source string, source_size long")).first().target == 10.0
