"""Unicode functions that Spark lacks, as pandas functions over Arrow batches."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SIGNATURE = T.StructType([T.StructField("signature", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(T.StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    """Lower case without combining marks, in compatibility decomposition; null stays null."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())


_OTHERS = re.compile(r"[\W_]+")


@functools.cache
def _folded(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", char).casefold() if c.isalnum())


@F.pandas_udf(_SIGNATURE)
def visible_signature(text: pd.Series) -> pd.DataFrame:
    """Letters and digits in compatibility form and folded case, with the offset in the text of each."""
    rows = []
    for x in text:
        marks, offsets = [], []
        for at, c in enumerate(x or ""):
            for folded in _folded(c):
                marks.append(folded)
                offsets.append(at)
        rows.append(("".join(marks), offsets))
    return pd.DataFrame(rows, columns=["signature", "offsets"])


@F.pandas_udf(T.StringType())
def bare_signature(text: pd.Series) -> pd.Series:
    """The visible signature without offsets; null is empty."""
    return text.map(lambda x: "".join(map(_folded, x or "")))


@F.pandas_udf(T.StringType())
def letters_and_digits(text: pd.Series) -> pd.Series:
    """Letters and digits as they stand, without compatibility form or folded case; null is empty."""
    return text.map(lambda x: _OTHERS.sub("", x or ""))


#: Code points of a piece of a signature. A window of 2 * PIECE - 1 or more holds one that starts at a multiple of PIECE of its page.
PIECE = 16


def _pieces(signature: str, step: int) -> np.ndarray:
    code = np.frombuffer(signature.encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.arange(0, len(code) - PIECE + 1, step)
    out = np.zeros(len(starts), np.uint64)
    for k in range(PIECE if len(starts) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + code[starts + k]
        out ^= out >> np.uint64(29)
    return np.unique(out).view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def every_piece(signature: pd.Series) -> pd.Series:
    """Hashes of all pieces of a signature, wherever they start."""
    return signature.map(lambda x: _pieces(x or "", 1))


@F.pandas_udf(T.ArrayType(T.LongType()))
def page_pieces(signature: pd.Series) -> pd.Series:
    """Hashes of the pieces of a page's signature that lie side by side."""
    return signature.map(lambda x: _pieces(x or "", PIECE))


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """A unified diff of two texts by lines; empty where they are equal."""
    out = []
    for a, b in zip(before, after, strict=True):
        a, b = a or "", b or ""
        out.append("" if a == b else "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), "before", "after", lineterm="")))
    return pd.Series(out, dtype="object")


#: Windows of a page's signature that vote for its place, longest first, and how many must agree.
WINDOWS, VOTES, MOST_WINDOWS = (160, 120, 80, 48, 32), 3, 64


def unique_at(whole: str, part: str) -> int:
    """Where a part that occurs exactly once lies in the whole, overlaps counted; else -1."""
    first = whole.find(part)
    return first if first >= 0 and whole.find(part, first + 1) < 0 else -1


def align(whole: str, page: str) -> tuple[int, int] | None:
    """Start and end of a page's signature in the whole: a unique match, or windows that agree and extend to both ends.

    Windows of all widths vote together. From the first and last window of the
    place with most votes the match must go on, character by character, to both
    ends of the page. Of places with equally many votes the first voted for wins.
    """
    if not page or not whole:
        return None
    first = unique_at(whole, page)
    if first >= 0:
        return first, first + len(page)
    votes: dict[int, list[tuple[int, int]]] = {}
    for width in WINDOWS:
        last = len(page) - width
        if last < 0:
            continue
        n = min(MOST_WINDOWS, last + 1)
        for at in sorted({round(k * last / max(1, n - 1)) for k in range(n)}):
            hit = unique_at(whole, page[at : at + width])
            if hit >= 0:
                votes.setdefault(hit - at, []).append((at, at + width))
    if not votes:
        return None
    delta, support = max(votes.items(), key=lambda v: len(v[1]))
    if delta < 0 or len({at for at, _ in support}) < VOTES or len(whole) < delta + len(page):
        return None
    start, end = min(at for at, _ in support), max(to for _, to in support)
    if whole[delta : delta + start] != page[:start] or whole[delta + end : delta + len(page)] != page[end:]:
        return None
    return delta, delta + len(page)


@F.pandas_udf(_SPAN)
def page_span(whole: pd.Series, page: pd.Series) -> pd.DataFrame:
    """Where the page's signature lies in the whole's, or nulls."""
    found = [align(w or "", p or "") or (None, None) for w, p in zip(whole, page, strict=True)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int32")


def target_present(target: Column, text: Column) -> Column:
    """Whether a translation's term is in a text: as a substring if it has ideographs, else as words regardless of case and marks."""
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), strip_marks(target), F.lit(r"\E(?!\w)"))
    return F.when(target.rlike(r"[\x{4E00}-\x{9FFF}]"), text.contains(target)).otherwise(F.regexp_like(strip_marks(text), quoted))
