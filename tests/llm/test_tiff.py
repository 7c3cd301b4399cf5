import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.llm import tiff
from folioquery.llm.tiff import decode_tiff, lzw_decode, lzw_encode, media_features, packbits, payload_of, read_tiff, store, unpackbits, write_tiff


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    assert lzw_decode(lzw_encode(data)) == data
    assert unpackbits(packbits(data)) == data


def test_lzw_widths_and_clears():
    data = bytes(random.Random(3).randrange(256) for _ in range(40_000)) + b"abc" * 9000
    assert lzw_decode(lzw_encode(data)) == data
    for n in range(240, 262):  # around the change to ten bits
        part = data[:n]
        assert lzw_decode(lzw_encode(part)) == part


def test_packbits_example():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert unpackbits(packed).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    assert unpackbits(b"\x80\x00\x41") == b"A"


def test_lzw_example_of_the_specification():
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert list(lzw_decode(packed)) == [7, 7, 7, 8, 8, 7, 7, 6, 6]
    assert lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed


def test_decoders_stop_at_what_a_block_needs():
    bomb = zlib.compress(bytes(50_000_000), 9)
    assert len(tiff.inflate(bomb, 100)) == 100
    assert len(lzw_decode(lzw_encode(bytes(100_000)), 10)) < 5000
    assert len(unpackbits(packbits(bytes(100_000)), 10)) <= 138


def crafted(width, height, compression, count, rows=None):
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (273, 4, ["b0"]), (279, 4, [count])]
    return build("<", tags + ([(278, 4, [rows])] if rows else []), [zlib.compress(bytes(4096))])


def test_crafted_sizes_give_a_reason(spark):
    sizes = [(2**31, 2**31), (300_000, 300_000), (2**32 - 1, 2**32 - 1), (0, 0), (4096, 1)]
    files = [(k, crafted(w, h, c, n)) for k, (w, h) in enumerate(sizes) for c in (1, 5, 8, 32773) for n in (0, 20, 2**32 - 1)]
    out = decode_tiff(spark.createDataFrame(files, "id int, data binary"), "id", "data").toPandas()
    assert len(out) == len(files)
    assert out[out.id < 3].error.notna().all()
    good = out[(out.id == 4) & out.error.isna()]
    assert len(good) and all(len(d) == 4096 for d in good.data)
    small = decode_tiff(spark.createDataFrame([(1, crafted(64, 64, 8, 100))], "id int, data binary"), "id", "data", most_bytes=4000).collect()
    assert small[0].error == "page of more than 4000 bytes" and small[0].page == 0


def test_any_change_of_a_file_gives_rows(spark):
    rng = random.Random(11)
    pages = [np.arange(2000, dtype=np.uint8).reshape(20, 100) for _ in range(2)]
    files = []
    for k in range(400):
        raw = bytearray(write_tiff(pages, rng.choice([1, 5, 8, 32773]), order=rng.choice("<>"), **rng.choice([{}, {"tile": (16, 16)}, {"predictor": 2}])))
        for _ in range(rng.randrange(1, 6)):
            raw[rng.choice([rng.randrange(len(raw)), len(raw) - 1 - rng.randrange(140)])] = rng.choice([0, 1, 255, rng.randrange(256)])
        files.append((k, bytes(raw[: rng.choice([len(raw), rng.randrange(len(raw))])])))
    out = decode_tiff(spark.createDataFrame(files, "id int, data binary"), "id", "data").toPandas()
    assert set(out.id) == set(range(400))
    assert (out.error.notna() | out.data.notna()).all()


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [tiff.STORED, tiff.LZW, tiff.PACKBITS, tiff.ADOBE_DEFLATE, tiff.DEFLATE])
@pytest.mark.parametrize("layout", [{}, {"strip_rows": 3}, {"tile": (16, 16)}, {"tile": (32, 16), "predictor": 2}, {"predictor": 2}])
def test_layouts_round_trip(order, compression, layout):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 256, shape, dtype=np.uint8) for shape in ((37, 61), (1, 1), (16, 64))]
    got = read_tiff(write_tiff(pages, compression, order=order, **layout))
    assert len(got) == 3 and all((g.samples[:, :, 0] == p).all() for g, p in zip(got, pages, strict=True))


def build(order, tags, blobs):
    """A one-page file by hand: blobs lie after the header, their places are named in the tags."""
    head = {"<": b"II", ">": b"MM"}[order]
    out, at = b"", 8
    places = []
    for blob in blobs:
        places.append(at)
        out += blob
        at += len(blob)
    entries = b""
    for tag, kind, values in sorted(tags):
        values = [places[int(v[1:])] if isinstance(v, str) else v for v in values]
        body = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        assert len(body) <= 4
        entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return head + struct.pack(order + "HI", 42, at) + out + struct.pack(order + "H", len(tags)) + entries + bytes(4)


def test_bits_and_samples():
    bilevel = build("<", [(256, 3, [10]), (257, 3, [2]), (258, 3, [1]), (259, 3, [1]), (273, 4, ["b0"]), (279, 4, [4])], [bytes([0b10110001, 0b01000000, 0xFF, 0x80])])
    assert read_tiff(bilevel)[0].samples[:, :, 0].tolist() == [[1, 0, 1, 1, 0, 0, 0, 1, 0, 1], [1] * 9 + [0]]
    deep = np.arange(12, dtype=">u2").reshape(2, 6) * 5000
    coded = np.concatenate([deep[:, :1], np.diff(deep.astype(np.uint16), axis=1)], axis=1).astype(">u2").tobytes()
    wide = build(">", [(256, 3, [6]), (257, 3, [2]), (258, 3, [16]), (259, 3, [8]), (317, 3, [2]), (273, 4, ["b0"]), (279, 4, [len(zlib.compress(coded))])], [zlib.compress(coded)])
    assert (read_tiff(wide)[0].samples[:, :, 0] == deep).all()
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    chunky = build("<", [(256, 3, [4]), (257, 3, [2]), (258, 3, [8]), (259, 3, [1]), (277, 3, [3]), (273, 4, ["b0"]), (279, 4, [24])], [rgb.tobytes()])
    assert (read_tiff(chunky)[0].samples == rgb).all()
    real = np.array([[1.5, -2.25, 3e9, 0.1]], ">f4")
    planes = real.view(np.uint8).reshape(1, 4, 4).transpose(0, 2, 1).reshape(-1)
    floats = build("<", [(256, 3, [4]), (257, 3, [1]), (258, 3, [32]), (259, 3, [1]), (339, 3, [3]), (317, 3, [3]), (273, 4, ["b0"]), (279, 4, [16])], [np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes()])
    assert (read_tiff(floats)[0].samples[0, :, 0] == real[0].astype(np.float32)).all()


def test_rows_per_page_and_broken_files(spark):
    good = write_tiff([np.full((2, 3), k, np.uint8) for k in range(3)])
    loop = bytearray(good)
    rows = [(1, good, 9), (1, good, 9), (2, None, 9), (3, b"", 9), (4, good[:40], 9), (5, b"II*\0" + b"\xff" * 9, 9), (None, bytes(loop), 9)]
    out = decode_tiff(spark.createDataFrame(rows, "id int, data binary, page int"), "id", "data").collect()
    pages = [(r.id, r.page, r.height, r.width, bytes(r.data)) for r in out if r.error is None]
    assert sorted(pages, key=str) == sorted([(i, k, 2, 3, bytes([k]) * 6) for i in (1, 1, None) for k in range(3)], key=str)
    assert sorted(r.id for r in out if r.error) == [2, 3, 4, 5]


def test_pages_after_one_that_cannot_be_decoded(spark):
    good = write_tiff([np.full((2, 3), k, np.uint8) for k in range(3)])
    entry = struct.pack("<HHIH", 259, 3, 1, tiff.ADOBE_DEFLATE)
    at = good.index(entry, good.index(entry) + 1)
    jpeg = good[: at + 8] + struct.pack("<H", 7) + good[at + 10 :]
    cut = good[:-4] + struct.pack("<I", len(good) + 9)
    out = decode_tiff(spark.createDataFrame([(1, jpeg), (2, cut)], "id int, data binary"), "id", "data").collect()
    rows = sorted(((r.id, r.page, r.error is None, r.data and bytes(r.data)) for r in out), key=lambda r: (r[0], r[1] is None, r[1]))
    whole = [(k, True, bytes([k]) * 6) for k in range(3)]
    assert rows == [(1, *whole[0]), (1, 1, False, None), (1, *whole[2]), *((2, *w) for w in whole), (2, None, False, None)]


def test_media_features(spark):
    long = "é0123456789 " * 200_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "abc", "x"), (4, "abc", "x"), (5, long, "x"), (None, "z" * 64, "x")]
    got = {r.doc_id: r for r in media_features(spark.createDataFrame(rows, "doc_id long, text string, feature string")).collect()}
    for doc, text, _ in rows:
        n, payload = payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) - n <= 64 and (got[doc].n_bytes, got[doc].payload_bytes) == (n, len(payload))
        assert got[doc].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[doc].tail_crc32 == zlib.crc32(payload[-64:])
        assert got[doc].media_sha256 == hashlib.sha256(store(payload)).hexdigest() and got[doc].media_bytes == len(store(payload))
    assert got[3][1:] == got[4][1:] and got[1][1:] == got[2][1:] and got[5].feature.startswith("pages=3;")
    assert media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("size", [64, 6400, 640_000])
def test_every_layout_at_every_size(size):
    rng = random.Random(size)
    seen = set()
    for _ in range(30):
        payload = (" ".join(rng.choice(["aaaa", "le", "été", "word"]) for _ in range(size // 4)).encode() + bytes(size))[:size]
        pages = read_tiff(store(payload))
        assert b"".join(p.samples.tobytes() for p in pages) == payload
        seen |= {(p.compression, p.tiled) for p in pages}
        if len(seen) == 4:
            break
    assert seen == {(tiff.PACKBITS, False), (tiff.LZW, False), (tiff.ADOBE_DEFLATE, True), (tiff.ADOBE_DEFLATE, False)}
