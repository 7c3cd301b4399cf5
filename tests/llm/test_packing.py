import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioquery.llm.packing import HarmonicPacker, pack


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def reference_ids(text):
    return np.array([*tokenizer().encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"word{i} été" for i in range(3000))
    return [(0, "hello world"), (1, None), (2, ""), (3, long), (3, long), (None, "no id"), (5, "<|endoftext|> x"), (6, "a<|endoftext|>b  <|endoftext|><|endoftext|>\n c <|endoftext|"), *((10 + i, "tok " * i) for i in range(150))]


def test_pieces_cover_documents_and_fill_sequences(spark, rows):
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, start string, sequence_id int").repartition(3)
    out = pack(df).toPandas()
    by_doc = {}
    for doc, text in rows:
        by_doc.setdefault(doc, []).append(reference_ids(text))
    for doc, copies in by_doc.items():
        ids = copies[0]
        part = out[out.doc_id.isna() if doc is None else out.doc_id == doc].sort_values("start")
        assert part.length.sum() == len(ids) * len(copies)
        assert set(part.doc_tokens) == {len(ids)}
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.to_numpy() == np.concatenate([[0], np.cumsum(seq.length)[:-1]])).all()
        total = seq.length.sum()
        assert total <= 1024
        assert set(seq.padded_length) == {total if total & (total - 1) == 0 else 1024}
    waste = out.groupby("sequence_id").agg(n=("length", "sum"), p=("padded_length", "first"))
    assert (waste.p - waste.n).sum() <= 0.01 * waste.p.sum()


@pytest.mark.parametrize("length", [1, 60, 100, 170, 341, 342, 512, 513, 700, 1023, 1024, 1025, 3000])
def test_bins_hold_a_fixed_count_and_no_padding(length):
    packer = HarmonicPacker(1024)
    bins = [b for i in range(80) for b in packer.add(i, np.full(length, i, np.uint32))]
    for b in bins:
        assert sum(len(p[2]) for p in b) == 1024
        k = 1024 // len(b[0][2])
        assert k == 1 or all(1024 // len(p[2]) == k for p in b[:k])  # what follows fills the bin up
    rest = list(packer.finish())
    assert all((n := sum(len(p[2]) for p in b)) & (n - 1) == 0 for b in rest)
    seen = {}
    for b in bins + rest:
        for tag, start, ids in b:
            assert len(ids) and (ids == tag).all()
            seen.setdefault(tag, []).append((start, start + len(ids)))
    for tag in range(80):
        spans = sorted(seen[tag])
        assert spans[0][0] == 0 and spans[-1][1] == length and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_mixed_lengths_are_cut_at_most_once_for_each_bin():
    rng = np.random.default_rng(3)
    packer, pieces, bins = HarmonicPacker(1024), 0, 0
    lengths = rng.integers(1, 1500, 500)
    out = [b for i, n in enumerate(lengths) for b in packer.add(i, np.zeros(n, np.uint32))]
    out += list(packer.finish())
    assert sum(len(p[2]) for b in out for p in b) == lengths.sum()
    assert sum(len(b) for b in out) <= len(lengths) + 2 * len(out)


def test_special_tokens_are_those_of_the_tokenizer():
    from folioquery.llm.packing import default_vocabulary, load_encoder

    encoder = load_encoder(default_vocabulary())
    for text in ("<|endoftext|>", "a<|endoftext|>b", " <|endoftext|>  <|endoftext|>x", "<|endoftext", "<|ENDOFTEXT|>", "é<|endoftext|>\n\n d"):
        assert list(encoder.encode_to_numpy(text, allowed_special="all")) == list(reference_ids(text)[:-1])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df).count() == 0


def test_bad_capacity():
    with pytest.raises(ValueError):
        HarmonicPacker(1000)
