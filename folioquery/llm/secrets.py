"""Secrets in texts: fixed patterns, and literals assigned to sensitive names.

The second part reads a text as source code or configuration (see ``lexer``) and
pairs each target with the literal it is given, follows names that are given
other names (so ``key = X`` with ``X = "..."`` counts, before or after), and
scores a literal by how sensitive the names are that it reaches and by how random
it looks.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.llm.common import arrow_rows, slices, table
from folioquery.llm.lexer import assignments

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$\-]*")
#: What every sensitive name has in it: a text without it isn't lexed.
_HINT = re.compile(r"pass|pwd|secret|token|key|credential|auth|signature|salt|bearer", re.IGNORECASE)
#: Parts of names that mark their value as secret, with how much.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8,
    "credentials": 0.8, "privatekey": 1.0, "accesskey": 1.0, "authkey": 0.9, "auth": 0.5, "key": 0.5, "signature": 0.5, "salt": 0.5, "bearer": 0.9,
}
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
LEAST_SCORE = 0.6
LEAST_LENGTH = 8


def name_score(name: str) -> float:
    """How sensitive a name is, 0 to 1: by its words, and by neighbours written as one."""
    words = [w.lower() for w in _SPLIT.split(name) if w]
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0.0) for w in words + joined), default=0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, 0 to 1: its length, kinds of characters and entropy."""
    if len(value) < LEAST_LENGTH or any(c.isspace() for c in value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, entropy / 4) * (0.5 if kinds == 1 else 1.0)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the three patterns that are long enough, leftmost and without overlap per kind: (start, kind's number, end)."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals that sensitive names are given, directly or through other names; each piece of a joined literal.

    A name stands for the literal last given to it before, or else for the one
    given to it next. Chains of names are followed to their end, and a cycle has
    no literal.
    """
    if not _HINT.search(text) or not any(c in text for c in "=:<"):
        return []
    found = list(assignments(text))
    bound: dict[str, int] = {}
    roots: list[int] = []  # the assignment that holds the literal of each, or the name that isn't defined before
    loose: set[int] = set()
    for k, x in enumerate(found):
        root, undefined = k, False
        if not x.quoted and _NAME.fullmatch(x.value):
            known = bound.get(x.value, bound.get(x.value.rpartition(".")[2]))
            if known is None:
                loose.add(k)
                undefined = name_score(x.value) > 0
            else:
                root = known
        roots.append(root)
        for name in x.names:
            if name[:1] != "<" and not (undefined and name in bound):
                bound[name] = root
    later: dict[str, int] = {}
    onward: dict[int, int] = {}
    for k in range(len(found) - 1 if loose else -1, -1, -1):
        value = found[k].value
        if k in loose and (follows := later.get(value, later.get(value.rpartition(".")[2]))) is not None:
            onward[k] = follows
        later.update((name, roots[k]) for name in found[k].names if name[:1] != "<")
    ends: dict[int, int | None] = {}

    def end_of(root: int) -> int | None:
        """Where a chain of later definitions ends, None for a cycle; each link is followed once."""
        path, at = [], root
        while at in onward and at not in ends:
            ends[at] = None
            path.append(at)
            at = onward[at]
        end = ends[at] if at in onward else at
        ends.update((k, end) for k in path)
        return end

    out: set[tuple[int, int]] = set()
    for x, root in zip(found, roots, strict=True):
        named = max(map(name_score, x.names))
        if not named:
            continue
        end = end_of(root)
        if end is None or end in loose and name_score(found[end].value) > 0:
            continue  # a cycle, or a reference to something sensitive that the text doesn't define
        score = literal_score(found[end].value)
        if score > 0 and named * 0.5 + score * 0.5 >= LEAST_SCORE:
            out.update(p for p in found[end].pieces if p[0] < p[1])
    return sorted(out)


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: a literal found by lexing counts once more only where no base span overlaps it."""
    text = text or ""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def apart(start: int, end: int) -> bool:
        before = bisect_left(starts, end)  # base spans that begin before the end
        return not before or reach[before - 1] <= start

    more = [(s, 3, e) for s, e in lexed_spans(text) if apart(s, e)]
    return base, sorted(base + more)


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: counts by kind, a digest of the base spans and all spans.

    Offsets count code points. Null texts are empty and have no spans; whole
    texts are scanned, a slice of rows at a time. Ids may be null or repeat.
    Further columns aren't read.
    """
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType)]
        + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
        + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_lexed", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [scan(text) for text in batch.column(1).to_pylist()]
            counts = [Counter(k for _, k, _ in spans) for _, spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
                + [pa.array([hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found]), pa.array([spans_text(s) for _, s in found])]
                + [pa.array([c[3] for c in counts], pa.int64())],
                names=schema.names,
            )

    return arrow_rows(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return find_secrets(table(spark, sf_dir, "documents"))
