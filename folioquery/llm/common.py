"""What the training-data operators share: inputs, checkpoints and word arrays."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Multiplier of the polynomial hash of a word's bytes (odd, so that it has an inverse modulo 2**64).
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(HASH_BASE), -1, 2**64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where that isn't set (as in a local test)."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder: it outlives any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    # files of shuffles that nothing refers to any more go when the driver collects its garbage, which it may put off for long
    context._jvm.System.gc()
    return out


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores in front of those that a column has already (in whatever case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def numbered(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The rows with a new column ``ordinal``: 1 to n among the n rows of one key.

    Only keys that repeat are numbered, in two levels: within the part of a
    table that a task reads, and by sums over these parts. So a key that a third
    of all rows share is spread over as many tasks as read it. Which of the rows
    gets which number is left open.
    """
    repeats = durable(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    n_repeats = repeats.count()
    if not n_repeats:
        return df.withColumn(ordinal, F.lit(1).cast("long"))
    few = F.broadcast(repeats) if n_repeats <= 100_000 else repeats
    (part,) = fresh([*df.columns, ordinal], "part")
    again = durable(df.join(few, key, "left_semi").withColumn(part, F.spark_partition_id()))
    before = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = again.groupBy(key, part).agg(F.count(F.lit(1)).alias(ordinal))
    bases = counts.select(key, part, F.coalesce(F.sum(ordinal).over(before), F.lit(0)).alias(ordinal))
    local = F.row_number().over(Window.partitionBy(key, part).orderBy(part))
    (base,) = fresh([*df.columns, ordinal, part], "base")
    numbers = again.withColumn(ordinal, local).join(bases.withColumnRenamed(ordinal, base), [key, part])
    rest = df.join(few, key, "left_anti").withColumn(ordinal, F.lit(1).cast("long"))
    return rest.unionByName(numbers.withColumn(ordinal, (F.col(ordinal) + F.col(base)).cast("long")).select(*quoted(rest.columns)))


#: Rows of an Arrow batch between Spark and Python, at most: long texts keep a batch within some tens of MB.
BATCH_ROWS = 2000


def arrow_rows(df: DataFrame) -> DataFrame:
    """The rows, with the session's Arrow batches bounded; what a task holds of them doesn't grow with the table."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def release_memory() -> None:
    """Give freed memory of this Python process back to the system, where the C library can; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20, most_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``most_bytes`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        per_row = max(1, batch.nbytes // batch.num_rows)
        step = int(min(most_rows, max(1, most_bytes // per_row)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    release_memory()


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the mixing step of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        base = HASH_BASE if kind == "up" else _INVERSE
        out = np.full(size, base, np.uint64)
        out[0] = 1
        _POWERS[kind] = np.multiply.accumulate(out)
    return _POWERS[kind][:n]


def utf8_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its offsets (nulls are empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``h[i]`` is the sum of ``data[j] * BASE**j`` over ``j < i``, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that do not depend on where the ranges lie."""
    raw = (prefix[ends] - prefix[starts]) * _powers("down", len(prefix))[starts]
    return splitmix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of each text, and each text's offsets in them.

    A word is a maximal run of bytes other than ASCII white space. The whole text
    is read; null and empty texts have no words.
    """
    data, offsets = utf8_bytes(pc.utf8_lower(column))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return range_hashes(prefix_hashes(data), starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words; a text of fewer words has one, of all its words."""
    counts = np.diff(offsets)
    n_out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(n_out)]).astype(np.int64)
    if not len(words):
        return np.zeros(0, np.uint64), out_offsets
    # position of each shingle's first word
    first = np.repeat(offsets[:-1], n_out) + (np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], n_out))
    end = np.repeat(offsets[1:], n_out)
    mixed = np.zeros(len(first), np.uint64)
    for k in range(width):
        at = first + k
        word = np.where(at < end, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        mixed = splitmix(mixed * HASH_BASE + word + np.uint64(k + 1))
    return mixed, out_offsets
