"""Harmonic packing of tokenised documents into fixed-capacity sequences.

Class k holds lengths in (capacity/(k+1), capacity/k], and a bin of class k takes
exactly k pieces. A document's whole capacities are bins of their own, and what
is left of it goes uncut into the open bin of its class. Each worker fills the
bins of its own input split, so the packing needs no shuffle and no shared state.

A bin that has its k pieces is short of the capacity by less than one more piece
of its class. It waits for the documents that come next, whose first ids fill it
up; nothing else is cut. What a worker has left in open bins at its end is put in
a row and cut at the capacity, and the last of it into powers of two, which need
no padding.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.llm.common import arrow_rows, slices, table

#: The id that closes a document.
END_ID = 0
#: The vocabulary's special token; its id follows those of the ranks.
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    """Path of the byte-level vocabulary as ranks; the same ids as ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoder(path: str):
    """A tiktoken encoder over a rank file; where a text spells out the special token, it is that token, as in ``byte_bpe_50k.json``."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


class HarmonicPacker:
    """Fills the bins of one worker. Pieces are (tag, start, ids); bins come out as lists of pieces."""

    def __init__(self, capacity: int = 1024):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity = capacity
        self.open: dict[int, list] = {}
        #: Bins with all pieces of their class that aren't full, with what they lack.
        self.short: deque[tuple[list, int]] = deque()

    def add(self, tag, ids: np.ndarray) -> Iterator[list]:
        at = 0
        while self.short and at < len(ids):
            pieces, lack = self.short.popleft()
            part = ids[at : at + lack]
            pieces.append((tag, at, part))
            at += len(part)
            if len(part) == lack:
                yield pieces
            else:
                self.short.appendleft((pieces, lack - len(part)))
        while len(ids) - at >= self.capacity:
            yield [(tag, at, ids[at : at + self.capacity])]
            at += self.capacity
        if at < len(ids):
            k = self.capacity // (len(ids) - at)
            pieces = self.open.setdefault(k, [])
            pieces.append((tag, at, ids[at:]))
            if len(pieces) == k:
                lack = self.capacity - sum(len(x) for _, _, x in self.open.pop(k))
                if lack:
                    self.short.append((pieces, lack))
                else:
                    yield pieces

    def finish(self) -> Iterator[list]:
        bins = [pieces for pieces, _ in self.short] + [self.open[k] for k in sorted(self.open)]
        self.short.clear()
        self.open.clear()
        rest = [piece for pieces in bins for piece in pieces]
        total = sum(len(ids) for _, _, ids in rest)
        size, filled, bin_ = self.capacity, 0, []
        for tag, start, ids in rest:
            at = 0
            while at < len(ids):
                while total < size:  # only the last bins are below the capacity
                    size //= 2
                part = ids[at : at + size - filled]
                bin_.append((tag, start + at, part))
                at, filled = at + len(part), filled + len(part)
                if filled == size:
                    yield bin_
                    total, filled, bin_ = total - size, 0, []


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    capacity: int = 1024,
) -> DataFrame:
    """One row per piece: where its ids lie in the document and in a sequence.

    Null texts count as empty and give the closing id alone; ids may be null or
    repeat (each row is a document of its own); an empty table gives no rows.
    Only ``id_col`` and ``text_col`` are read, so further columns of any name do
    no harm. Texts are tokenised whole. A worker holds one batch of texts and
    its open bins, at most ``capacity`` ids in each of as many classes.
    ``padded_length`` is the sequence's length, rounded up to ``capacity`` unless
    it is a power of two.
    """
    path = vocabulary or default_vocabulary()
    fields = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, fields)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = load_encoder(path), HarmonicPacker(capacity)
        next_id = TaskContext.get().partitionId() << 33
        rows: list[list] = [[] for _ in schema.fields]
        arrow_types = None

        def close(bin_: list) -> None:
            nonlocal next_id
            total, at = sum(len(p[2]) for p in bin_), 0
            padded = total if total & (total - 1) == 0 else capacity
            for (doc, n), start, ids in bin_:
                for column, value in zip(rows, (doc, start, len(ids), zlib.crc32(ids.tobytes()), n, next_id, at, padded), strict=True):
                    column.append(value)
                at += len(ids)
            next_id += 1

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, arrow_types, strict=True)], names=schema.names)
            for column in rows:
                column.clear()
            return out

        for batch in slices(batches):
            arrow_types = [batch.schema.field(0).type] + [pa.int64()] * 7
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode_to_numpy(text or "", allowed_special="all").astype("<u4", copy=False)
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                for bin_ in packer.add((doc, len(ids)), ids):
                    close(bin_)
            if len(rows[0]) >= 20_000:
                yield flush()
        for bin_ in packer.finish():
            close(bin_)
        if rows[0]:
            yield flush()

    return arrow_rows(df).select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
