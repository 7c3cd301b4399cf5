"""Line de-duplication across documents by a deletion-neighbourhood join.

Two lines are alike if they are equal or one edit apart; short lines, of which
any two may be an edit apart, only if they are equal. Equal lines meet by their
hash. For the others, each line emits what is left of it after deleting
any one code point, and the line itself, as hashed keys with the deleted
position; lines that share a key are candidates, and the edit distance of each
is verified. A line goes if an earlier one is alike, in the order of doc_id, row
and place; the earliest stays.

Emitting the whole neighbourhood of every line would cost the square of its
length in bytes and one row for each of its characters, so only lines are
expanded that can have a neighbour: an edit leaves the first or the last half of
a line as it was, and a line that shares neither half with a different line has
no neighbour. That filter loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquery.llm.common import HASH_BASE, arrow_rows, durable, fresh, quoted, slices, splitmix, table

#: Lines of fewer code points, without the white space around them, have no neighbours but equal lines.
MIN_CHARS = 20
#: Tables of at most so many narrow rows are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 500_000
_STEP = 8


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The (durable) table, marked for broadcast if it is small enough."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _half(n: Column) -> Column:
    """Length of the halves that are compared of a line of n code points: a multiple of _STEP."""
    return (F.floor(n / (2 * _STEP)) * _STEP).cast("int")


def lines_of(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, place, line, h1, h2) of each line of at least so many code points; ``row`` tells rows of one id apart by their text."""
    split = docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("place", "raw"))
    trimmed = split.select("doc_id", "row", "place", F.trim("raw", F.lit(" \t\r")).alias("line")).where(F.length("line") >= max(1, least))
    return trimmed.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), F.col("line"))})


def half_keys(line: Column) -> Column:
    """Hashes of the first and the last half, for the line's length and for one less."""
    n = F.length(line)

    def both(h: Column) -> list[Column]:
        return [F.xxhash64(F.lit(1), h, F.substring(line, F.lit(1), h)), F.xxhash64(F.lit(2), h, F.substring(line, n - h + 1, h))]

    own, less = _half(n), _half(n - 1)
    return F.when(own == less, F.array(*both(own))).otherwise(F.array(*both(own), *both(less)))


def deletions(lines: DataFrame) -> DataFrame:
    """(key, cut, ...) of lines (doc_id, row, place, line, h1, h2, early, late): the neighbourhood in hashed keys.

    ``cut`` is the place of the deleted code point, -1 for the line itself.
    ``early`` and ``late`` tell in which half an edit can lie. One slice of lines
    is expanded at a time.
    """
    kept = ["doc_id", "row", "place", "h1", "h2"]
    fields = ", ".join(["key long, cut int"] + [f"{f} {lines.schema[f].dataType.simpleString()}" for f in kept])

    def expand(line: str, early: bool, late: bool) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(code)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, HASH_BASE, np.uint64)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(code * power[:n], dtype=np.uint64)])
        half = (n - 1) // (2 * _STEP) * _STEP
        cuts = np.arange(half if not early else 0, n - half if not late else n)
        # what follows the cut moves one place down: its terms are summed with the powers of the places before
        shifted = np.concatenate([[np.uint64(0)], np.cumsum(code[1:] * power[: n - 1], dtype=np.uint64)])
        keys = total[cuts] + (shifted[n - 1] - shifted[cuts])
        keys = np.append(keys, total[n])
        sizes = np.append(np.full(len(cuts), n - 1), n).astype(np.uint64)
        return splitmix(keys + sizes * np.uint64(0xD6E8FEB86659FD93)).view(np.int64), np.append(cuts, -1).astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=256 << 10):
            found = [expand(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(5, 8)), strict=True)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
            keys, cuts = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            for a in range(0, len(keys), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[part]), pa.array(cuts[part])] + [batch.column(k).take(at[part]) for k in range(5)],
                    names=["key", "cut", *kept],
                )

    return arrow_rows(lines).select(*kept, "line", "early", "late").mapInArrow(run, fields)


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance is at most 1, in time linear in the length (but for a logarithm)."""
    if abs(len(a) - len(b)) > 1:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # length of the common start
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low + 1 :] == b[low + 1 :] if len(a) == len(b) else a[low + 1 :] == b[low:] if len(a) > len(b) else a[low:] == b[low + 1 :]


def verified(pairs: DataFrame) -> DataFrame:
    """Rows whose last two columns, two lines, are at most one edit apart, without these."""
    schema = pairs.drop("line", "kept_line").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            same = [within_one(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield batch.select([0, 1, 2]).filter(pa.array(same))

    return arrow_rows(pairs).mapInArrow(run, schema)


def _place(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("doc_id", "row", "place")])


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_equal: int | None = None) -> DataFrame:
    """(doc_id, row, place, kept_doc_id) of each line that goes, with the document of the earlier line.

    Lines of at least ``min_equal`` code points (``min_chars`` if not given) are
    compared for equality, those of at least ``min_chars`` also for an edit.

    Rows are aggregated before each shuffle, so a line that a third of all rows
    hold costs one row a task; joins back to the lines go by a broadcast of
    checked size or a shuffled join, whose hot keys Spark splits.
    """
    lines = lines_of(docs, min_chars if min_equal is None else min(min_equal, min_chars))
    fuzzy_too = F.length("line") >= min_chars
    occurrences = durable(lines.withColumn("keys", F.when(fuzzy_too, half_keys(F.col("line")))).drop("line"))
    firsts = occurrences.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"))

    # lines that share a half with another line
    exploded = occurrences.select("h1", "h2", F.posexplode("keys").alias("kind", "key"))
    shared = durable(exploded.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key"))
    prefix = F.col("kind") % 2 == 0
    suspects = durable(
        exploded.join(small(shared), "key", "left_semi").groupBy("h1", "h2").agg(F.max(~prefix).alias("early"), F.max(prefix).alias("late"))
    )
    known = lines.where(fuzzy_too).join(small(suspects), ["h1", "h2"]).groupBy("h1", "h2").agg(
        F.min(_place()).alias("first"), F.any_value("line").alias("line"), F.any_value("early").alias("early"), F.any_value("late").alias("late")
    )
    known = durable(known.select("h1", "h2", "first.*", "line", "early", "late"))

    # within a key, equal cuts mean a substitution, and a cut against the line itself an insertion
    me = F.struct("doc_id", "row", "place", "h1", "h2")
    by_key, by_cut = Window.partitionBy("key"), Window.partitionBy("key", "cut")
    met = deletions(known).withColumns(
        {
            "same": F.min(me).over(by_cut),
            "whole": F.min(F.when(F.col("cut") == -1, me)).over(by_key),
            "part": F.min(F.when(F.col("cut") >= 0, me)).over(by_key),
        }
    )
    earlier = F.when(F.col("cut") >= 0, F.least("same", "whole")).otherwise(F.least("same", "part"))
    candidates = (
        met.withColumn("earlier", earlier)
        .where((F.struct("earlier.doc_id", "earlier.row", "earlier.place") < _place()) & ~((F.col("earlier.h1") == F.col("h1")) & (F.col("earlier.h2") == F.col("h2"))))
        .groupBy("h1", "h2")
        .agg(F.min("earlier").alias("earlier"))
    )
    texts = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("line").alias("kept_line"))
    paired = candidates.join(known.select("h1", "h2", "line"), ["h1", "h2"]).join(
        texts, (F.col("earlier.h1") == F.col("k1")) & (F.col("earlier.h2") == F.col("k2"))
    )
    near = durable(verified(paired.select("h1", "h2", F.col("earlier.doc_id").alias("kept_doc_id"), "line", "kept_line")))
    repeats = durable(firsts.where("n > 1").drop("n"))
    exact = occurrences.join(small(repeats), ["h1", "h2"]).where(_place() > F.col("first"))
    exact = exact.select("doc_id", "row", "place", F.col("first.doc_id").alias("kept_doc_id"), F.lit(1).alias("equal"))
    fuzzy = occurrences.join(small(near), ["h1", "h2"]).select("doc_id", "row", "place", "kept_doc_id", F.lit(0).alias("equal"))
    every = exact.unionByName(fuzzy).groupBy("doc_id", "row", "place").agg(F.max(F.struct("equal", "kept_doc_id")).alias("x"))
    return every.select("doc_id", "row", "place", "x.kept_doc_id")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_equal: int | None = None) -> DataFrame:
    """The documents without lines of which an earlier one is alike, with arrays ``_removed`` and ``_kept_in``.

    ``_removed`` has the places of the removed lines, ``_kept_in`` the ids of the
    documents that hold an earlier one. All rows stay, a text all of whose lines
    went becomes empty; null and empty texts and blank lines stay as they are.
    Both names get an underscore more where a column has them already.
    Lines under ``min_chars`` go only if an earlier one is equal and they have
    ``min_equal`` code points, by default ``min_chars``, so that they stay. Null ids come first; rows equal in id and text count as one and
    end alike; rows of one id go by a hash of the text. Columns besides doc_id
    and text are carried along, whatever their names but the two new ones.
    """
    lost, kept_in, doc, row = fresh(docs.columns, "_removed", "_kept_in", "_id", "_row")
    gone = (
        repeated_lines(docs, min_chars, min_equal)
        .groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_set("place")).alias(lost), F.array_sort(F.collect_set("kept_doc_id")).alias(kept_in))
    )
    gone = durable(gone.select(F.col("doc_id").alias(doc), F.col("row").alias(row), lost, kept_in))
    # a merge join at every size: what goes grows with the input
    joined = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(row)), "left")
    split = F.split("text", "\n", -1)
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(lost)), lambda k: F.get(split, k))
    cleaned = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = {lost: F.expr("cast(array() as array<int>)"), kept_in: F.expr(f"cast(array() as array<{kind}>)")}
    return joined.withColumn("text", cleaned).withColumns({k: F.coalesce(k, v) for k, v in none.items()}).select(*quoted(docs.columns), *none)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines, with what was removed and which documents hold it earlier."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_equal=1)
    return out.select("doc_id", F.size("_removed").cast("long").alias("n_removed"), F.array_join("_removed", ",").alias("removed"), F.array_join("_kept_in", ",").alias("kept_in"), "text")
