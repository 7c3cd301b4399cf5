"""TIFF media columns: decode image files to one row per page, and store bytes as images.

The reader walks the image directories of classic and big files in either byte
order, decodes strips and tiles (stored, PackBits, LZW, deflate), undoes the
horizontal and floating-point predictors and returns each page's samples. The
writer makes grey 8-bit pages from bytes in any of these layouts.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.llm.common import arrow_rows, slices, table

#: Tags and values of the TIFF 6.0 specification.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
STORED, LZW, ADOBE_DEFLATE, PACKBITS, DEFLATE = 1, 5, 8, 32773, 32946
_TYPES = {1: "u1", 2: "u1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 10: "i4", 11: "f4", 12: "f8", 13: "u4", 16: "u8", 17: "i8", 18: "u8"}
_PER_VALUE = {5: 2, 10: 2}
#: Bytes of a page's samples, at most; a larger one doesn't fit a binary value beside others.
MOST_BYTES = 1 << 30
#: Rows of a page that the writer makes, and samples of a row.
PAGE_ROWS, ROW = 16384, 64


class TiffError(ValueError):
    """The bytes are no TIFF file that this reader knows."""


def unpackbits(data: bytes, need: int = MOST_BYTES) -> bytes:
    """Decoders stop once they have the ``need`` bytes of a strip or tile."""
    out, at, n, done = [], 0, len(data), 0
    while at < n and done < need:
        head = data[at]
        if head < 128:
            out.append(data[at + 1 : at + 2 + head])
            at += head + 2
            done += head + 1
        elif head > 128:
            out.append(data[at + 1 : at + 2] * (257 - head))
            at += 2
            done += 257 - head
        else:
            at += 1
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, at = [], 0
    for run in re.finditer(rb"(?s)(.)\1{2,127}", data):
        out += _literal(data[at : run.start()])
        out.append(bytes([257 - (run.end() - run.start())]) + run[1])
        at = run.end()
    return b"".join(out + _literal(data[at:]))


def _literal(data: bytes) -> list[bytes]:
    return [bytes([len(part) - 1]) + part for k in range(0, len(data), 128) if (part := data[k : k + 128])]


def lzw_decode(data: bytes, need: int = MOST_BYTES) -> bytes:
    """Codes of 9 to 12 bits, high bits first, widened one code early; 256 clears, 257 ends."""
    roots = [bytes([k]) for k in range(256)] + [b"", b""]
    words, out, last = list(roots), [], b""
    bits, held, width, done = 0, 0, 9, 0
    for byte in data:
        bits = (bits << 8) | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 256:
            words, last, width = list(roots), b"", 9
            continue
        if code == 257:
            break
        if not last:
            if code > 255:
                raise TiffError("LZW data start with a code that isn't defined")
            word = roots[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            words.append(last + word[:1])
        out.append(word)
        done += len(word)
        if done >= need:
            break
        last = word
        size = len(words)
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    roots = {bytes([k]): k for k in range(256)}
    words, size, width, bits, held = dict(roots), 258, 9, 256, 9
    out, word = bytearray(), b""
    for k in range(len(data)):
        char = data[k : k + 1]
        longer = word + char
        if longer in words:
            word = longer
            continue
        bits, held = (bits << width) | words[word], held + width
        words[longer] = size
        size += 1
        if size == 4094:
            bits, held = (bits << 12) | 256, held + 12
            words, size = dict(roots), 258
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = char
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1
    if word:
        bits, held, size = (bits << width) | words[word], held + width, size + 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    bits, held = (bits << width) | 257, held + width
    spare = -held % 8
    return bytes(out) + (bits << spare).to_bytes((held + spare) // 8, "big")


def inflate(data: bytes, need: int) -> bytes:
    return zlib.decompressobj().decompress(data, need) if need else b""


_DECODERS = {STORED: lambda d, need: d[:need], LZW: lzw_decode, PACKBITS: unpackbits, ADOBE_DEFLATE: inflate, DEFLATE: inflate}
#: No byte of a block becomes more than so many: 2 for 128 in PackBits, a word of 4096 bytes for 9 bits in LZW, 1032 in deflate.
_MOST_GROWTH = {STORED: 1, LZW: 4096, PACKBITS: 64, ADOBE_DEFLATE: 1032, DEFLATE: 1032}
_ENCODERS = {STORED: bytes, LZW: lzw_encode, PACKBITS: packbits, ADOBE_DEFLATE: lambda d: zlib.compress(d, 1), DEFLATE: lambda d: zlib.compress(d, 1)}


@dataclass
class Page:
    """One decoded directory: samples have the shape (height, width, samples a pixel)."""

    samples: np.ndarray
    bits: int
    compression: int
    predictor: int
    photometric: int
    tiled: bool


def directories(data: bytes) -> Iterator[tuple[str, dict[int, np.ndarray]]]:
    """Byte order and tags of each image directory, in file order; a chain that comes back ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic == 42:
        at, count_type, entry, field = struct.unpack_from(order + "I", data, 4)[0], "H", 12, "I"
    elif magic == 43 and len(data) >= 16:
        at, count_type, entry, field = struct.unpack_from(order + "Q", data, 8)[0], "Q", 20, "Q"
    else:
        raise TiffError("unknown version of TIFF")
    seen, room, entries = set(), struct.calcsize(field), 0
    while at and at not in seen:
        seen.add(at)
        try:
            n = struct.unpack_from(order + count_type, data, at)[0]
            at += struct.calcsize(count_type)
            entries += n
            if entries * entry > len(data):
                raise TiffError("directories overlap")
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(f"{order}HH{field}", data, at + k * entry)
                if kind not in _TYPES:
                    continue
                dtype = np.dtype(_TYPES[kind]).newbyteorder(order)
                count *= _PER_VALUE.get(kind, 1)
                place = at + k * entry + 4 + room
                if count * dtype.itemsize > room:
                    place = struct.unpack_from(order + field, data, place)[0]
                tags[tag] = np.frombuffer(data, dtype, count, place)
            at = struct.unpack_from(order + field, data, at + n * entry)[0]
        except TiffError:
            raise
        except (struct.error, ValueError, OverflowError) as broken:
            raise TiffError("directory beyond the end of the file") from broken
        yield order, tags


def _one(tags: dict[int, np.ndarray], tag: int, default: int | None = None) -> int:
    if tag not in tags or not len(tags[tag]):
        if default is None:
            raise TiffError(f"tag {tag} is missing")
        return default
    value = tags[tag][0]
    if not 0 <= value < 2**63:
        raise TiffError(f"tag {tag} is out of range")
    return int(value)


def _block(raw: bytes, shape: tuple[int, int, int], bits: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """Samples of a decoded strip or tile; missing bytes are an error, spare ones are left out."""
    height, width, planes = shape
    if bits < 8:
        row_bytes = (width * planes * bits + 7) // 8
        if len(raw) < height * row_bytes:
            raise TiffError("strip or tile is too short")
        packed = np.unpackbits(np.frombuffer(raw, np.uint8, height * row_bytes).reshape(height, row_bytes), axis=1)
        groups = packed[:, : width * planes * bits].reshape(height, width, planes, bits)
        return (groups << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
    need = height * width * planes * dtype.itemsize
    if len(raw) < need:
        raise TiffError("strip or tile is too short")
    if predictor == 3:
        rows = np.frombuffer(raw, np.uint8, need).reshape(height, width * dtype.itemsize, planes).copy()
        rows = np.add.accumulate(rows, axis=1, dtype=np.uint8).reshape(height, dtype.itemsize, width * planes)
        return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape).astype(dtype.newbyteorder("="))
    out = np.frombuffer(raw, dtype, need // dtype.itemsize).reshape(shape).astype(dtype.newbyteorder("="))
    if predictor == 2:
        out = np.add.accumulate(out, axis=1, dtype=out.dtype)
    return out


def read_page(data: bytes, order: str, tags: dict[int, np.ndarray], most_bytes: int = MOST_BYTES) -> Page:
    """Sizes are checked against the bytes that the file has for them before anything is allocated."""
    width, height = _one(tags, WIDTH), _one(tags, HEIGHT)
    samples, planar, predictor = _one(tags, SAMPLES, 1), _one(tags, PLANAR, 1), _one(tags, PREDICTOR, 1)
    bits, compression = _one(tags, BITS, 1), _one(tags, COMPRESSION, 1)
    if len(set(map(int, tags.get(BITS, [bits])))) > 1:
        raise TiffError("samples of different sizes")
    if compression not in _DECODERS:
        raise TiffError(f"compression {compression} is not supported")
    kind = {1: "u", 2: "i", 3: "f"}.get(_one(tags, SAMPLE_FORMAT, 1), "u")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or predictor not in (1, 2, 3) or predictor == 3 and kind != "f":
        raise TiffError("kind of samples is not supported")
    if kind == "f" and bits < 16 or bits < 8 and predictor != 1 or not samples:
        raise TiffError("kind of samples is not supported")
    dtype = np.dtype(f"{kind}{max(1, bits // 8)}").newbyteorder(order) if bits >= 8 else np.dtype("u1")
    tiled = TILE_OFFSETS in tags
    block_w = _one(tags, TILE_WIDTH) if tiled else width
    block_h = _one(tags, TILE_HEIGHT) if tiled else min(height, _one(tags, ROWS_PER_STRIP, height)) or 1
    offsets, counts = (tags.get(t) for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (STRIP_OFFSETS, STRIP_COUNTS)))
    across, down = -(-width // block_w) if block_w else 0, -(-height // block_h) if block_h else 0
    groups, planes = (samples, 1) if planar == 2 else (1, samples)
    if offsets is None or counts is None or len(offsets) < across * down * groups or len(counts) < len(offsets):
        raise TiffError("offsets of strips or tiles are missing")
    n_blocks = across * down * groups
    spans = [(int(a), min(int(a) + int(n), len(data))) for a, n in zip(offsets[:n_blocks], counts[:n_blocks], strict=True)]
    block_bytes = block_h * ((block_w * planes * bits + 7) // 8)
    if max(height * width * samples * dtype.itemsize, block_bytes) > most_bytes:
        raise TiffError(f"page of more than {most_bytes} bytes")
    if any(a < 0 or a > len(data) for a, _ in spans) or height * width * samples * bits > 8 * _MOST_GROWTH[compression] * sum(max(0, b - a) for a, b in spans):
        raise TiffError("strip or tile is too short")
    out = np.zeros((height, width, samples), np.uint8 if bits < 8 else dtype.newbyteorder("="))
    for k in range(n_blocks):
        group, place = divmod(k, across * down)
        y, x = (place // across) * block_h, (place % across) * block_w
        rows = block_h if tiled else min(block_h, height - y)
        need = rows * ((block_w * planes * bits + 7) // 8)
        try:
            raw = _DECODERS[compression](data[spans[k][0] : spans[k][1]], need)
        except zlib.error as broken:
            raise TiffError("deflate data are broken") from broken
        block = _block(raw, (rows, block_w, planes), bits, dtype, predictor)[: height - y, : width - x]
        at = slice(group, group + 1) if planar == 2 else slice(None)
        out[y : y + block.shape[0], x : x + block.shape[1], at] = block
    return Page(out, bits, compression, predictor, _one(tags, PHOTOMETRIC, 1), tiled)


def read_tiff(data: bytes) -> list[Page]:
    return [read_page(data, order, tags) for order, tags in directories(data)]


def write_tiff(pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = 256, order: str = "<") -> bytes:
    """A classic file of grey 8-bit pages of shape (height, width)."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        blocks = []
        step_y, step_x = (tile[1], tile[0]) if tile else (strip_rows, width)
        for y in range(0, height, step_y):
            for x in range(0, width, step_x):
                block = page[y : y + step_y, x : x + step_x]
                if tile:
                    block = np.pad(block, ((0, step_y - block.shape[0]), (0, step_x - block.shape[1])))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
                blocks.append(_ENCODERS[compression](np.ascontiguousarray(block, np.uint8).tobytes()))
        places = []
        for block in blocks:
            places.append(len(out))
            out += block + b"\0" * (len(block) % 2)
        shape = [(TILE_WIDTH, 3, [step_x]), (TILE_HEIGHT, 3, [step_y])] if tile else [(ROWS_PER_STRIP, 4, [step_y])]
        spots = [((TILE_OFFSETS if tile else STRIP_OFFSETS), 4, places), ((TILE_COUNTS if tile else STRIP_COUNTS), 4, [len(b) for b in blocks])]
        entries = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        packed = []
        for tag, kind, values in sorted(entries + shape + spots):
            body = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack(order + "I", at)
            packed.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(packed)) + b"".join(packed)
        link = len(out)
        out += bytes(4)
    return bytes(out)


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, data binary, error string"


def decode_tiff(files: DataFrame, id_col: str, data_col: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per page of each file: its shape and its samples in row order, native byte order.

    A page that can't be decoded, or whose samples have more than ``most_bytes``
    bytes, gives a row with its number and the reason. A
    null or empty file, or a chain of directories that is broken, gives one with
    a null page; the pages before the break are kept. Rows may repeat.
    Further columns aren't read. One file is decoded at a time.
    """
    schema = T.StructType([T.StructField(id_col, files.schema[id_col].dataType)] + T._parse_datatype_string(PAGE_FIELDS).fields)

    def pages(data: bytes | None) -> Iterator[tuple]:
        try:
            for number, (order, tags) in enumerate(directories(data or b"")):
                try:
                    p = read_page(data, order, tags, most_bytes)
                except (TiffError, ValueError, OverflowError, MemoryError) as broken:
                    yield (number,) + (None,) * 8 + (str(broken) or type(broken).__name__,)
                    continue
                h, w, n = p.samples.shape
                yield (number, w, h, n, p.bits, p.compression, p.predictor, p.tiled, p.samples.tobytes(), None)
        except TiffError as broken:
            yield (None,) * 9 + (str(broken),)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
        for batch in slices(batches, most_rows=64):
            for at in range(batch.num_rows):
                rows = list(pages(batch.column(1)[at].as_py()))
                if rows:
                    ids = batch.column(0).take(pa.array([at] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

    return arrow_rows(files).select(id_col, F.col(data_col).cast("binary").alias("_data")).mapInArrow(run, schema)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes filled up with zeros to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(ROW - len(raw), -len(raw) % ROW))


#: Layouts, one of which the payload's checksum picks at every size.
LAYOUTS = (
    {"compression": PACKBITS},
    {"compression": LZW, "predictor": 2},
    {"compression": ADOBE_DEFLATE, "predictor": 2, "tile": (64, 16)},
    {"compression": ADOBE_DEFLATE, "strip_rows": 64},
)


def store(payload: bytes) -> bytes:
    """The payload as grey pages of 64 samples a row; the layout depends on the payload alone."""
    grey = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    turn = zlib.crc32(payload)
    return write_tiff([grey[y : y + PAGE_ROWS] for y in range(0, len(grey), PAGE_ROWS)], order="<>"[turn >> 3 & 1], **LAYOUTS[turn % 4])


def feature(pages: list[Page]) -> str:
    """Pages, rows, mean, deviation, entropy and mean step between neighbours of the samples."""
    counts = sum((np.bincount(p.samples.ravel(), minlength=256) for p in pages), np.zeros(256, np.int64))
    n = int(counts.sum())
    values = np.arange(256)
    mean = float((counts * values).sum() / n)
    spread = float(np.sqrt((counts * values * values).sum() / n - mean * mean))
    share = counts[counts > 0] / n
    steps = sum(int(np.abs(np.diff(p.samples[:, :, 0].astype(np.int16), axis=1)).sum()) for p in pages)
    return f"pages={len(pages)};rows={sum(p.samples.shape[0] for p in pages)};mean={mean:.4f};sd={spread:.4f};entropy={-float((share * np.log2(share)).sum()):.4f};step={steps / n:.4f}"


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as an image file, decoded again, with digests and a feature of what was read back.

    Null and empty texts are 64 zero bytes. Whole texts are stored, long ones on
    several pages; one text is held at a time. Rows may repeat, ids may be null,
    further columns aren't read.
    """
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + T._parse_datatype_string(fields).fields)

    def one(text: str | None) -> tuple:
        n, payload = payload_of(text)
        media = store(payload)
        pages = read_tiff(media)
        back = b"".join(p.samples.tobytes() for p in pages)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in slices(batches):
            rows = [one(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

    return arrow_rows(docs).select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as an image file and read back."""
    return media_features(table(spark, sf_dir, "documents"))
