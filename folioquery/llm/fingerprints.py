"""Homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed
to a vector, and the document's fingerprint is the sum of the vectors, each
element modulo a power of two. So equal multisets have equal fingerprints in any
order, and paragraphs can be added or taken away by adding or subtracting their
vectors. A paragraph's vector has two parts:

* four 60-bit words of its SHA-256: their sums modulo 2**60 tell equality;
* its number of sentences, and for each of 116 bits of MD5 the number of its
  sentences that have the bit, two counts to a word modulo 2**62. Twice a summed
  count less the number of sentences is a sum of random signs, and the squared
  length of a difference of such sums estimates how many sentences two documents
  don't share.

A count has 31 bits, and a text of less than 2**31 bytes can't have as many
sentences, so no count runs into the next one.

Everything is Spark SQL over arrays; nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquery.llm.common import table

#: Bits of a word of the sums.
BITS = 60
MASK = (1 << BITS) - 1
#: Bits of a count; two are a word.
FIELD = 31
FIELD_MASK = (1 << FIELD) - 1
COUNTS_MASK = (1 << 2 * FIELD) - 1
ONES = 1 | 1 << FIELD
#: Words of the sums, words read of an MD5, and pairs of bits that are counted in each of these.
N_SUMS, N_HALVES, N_SHIFTS = 4, 2, BITS - FIELD
N_SIGNS = N_HALVES * N_SHIFTS * 2
N_WORDS = N_SUMS + 1 + N_HALVES * N_SHIFTS
_HEX = 15
#: What ends a sentence inside a paragraph.
SENTENCE = r"[.!?;|][ \t\r]+"
#: Documents of adjacent ids that one task takes to find each one's successor.
BLOCK = 512
#: Ids are dealt by this number's square of quantiles first, so that ids in clusters make even ranges.
FAN = 32


def _sum(values: str, term: str, mask: int = MASK) -> str:
    """SQL of the sum of a term of x over an array, modulo a power of two."""
    return f"aggregate({values}, 0L, (total, x) -> (total + {term}) & {mask}L)"


def _words(digest: str, n: int) -> str:
    return "array(" + ", ".join(f"cast(conv(substring({digest}, {1 + _HEX * k}, {_HEX}), 16, 10) as bigint)" for k in range(n)) + ")"


def fingerprint(text: str) -> Column:
    """The fingerprint's words, of a column name or SQL expression: sums, number of sentences, bit counts.

    An empty or null text is one empty paragraph. The arrays of hashes are bound,
    so that each is computed once and not for every word.
    """
    lines = f"split(coalesce({text}, ''), '\\n', -1)"
    whole = f"transform({lines}, p -> {_words('sha2(p, 256)', N_SUMS)})"
    parts = f"transform(flatten(transform({lines}, p -> split(p, '{SENTENCE}', -1))), s -> {_words('md5(s)', N_HALVES)})"
    sums = [_sum("h.whole", f"x[{k}]") for k in range(N_SUMS)]
    counts = [_sum("h.parts", f"(shiftrightunsigned(x[{half}], {j}) & {ONES}L)", COUNTS_MASK) for half in range(N_HALVES) for j in range(N_SHIFTS)]
    vector = ", ".join([*sums, "cast(size(h.parts) as bigint)", *counts])
    return F.expr(f"transform(array(named_struct('whole', {whole}, 'parts', {parts})), h -> array({vector}))[0]")


def add(a: Column, b: Column) -> Column:
    """Fingerprint words of the union of two multisets."""
    return _each(a, b, lambda x, y, mask: (x + y).bitwiseAND(mask))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint words of a multiset without a part of it."""
    return _each(a, b, lambda x, y, mask: (x - y + mask + 1).bitwiseAND(mask))


def _each(a: Column, b: Column, change) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(pairs, lambda p, i: change(p["x"], p["y"], F.when(i < N_SUMS, F.lit(MASK)).otherwise(F.lit(COUNTS_MASK))))


def as_text(words: Column) -> Column:
    """16 hexadecimal digits a word."""
    return F.lower(F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def _signs(words: Column) -> Column:
    """The sums of random signs, from the bit counts."""
    counts = F.slice(words, N_SUMS + 2, N_HALVES * N_SHIFTS)
    fields = F.flatten(F.transform(counts, lambda w: F.array(w.bitwiseAND(F.lit(FIELD_MASK)), F.shiftrightunsigned(w, FIELD))))
    return F.transform(fields, lambda c: c * 2 - F.element_at(words, N_SUMS + 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of sentences that two documents have in common, from their fingerprints: 1 if equal, 0 to 1.

    It is 1 - |x - y|**2 / (n * (|a| + |b|)) with the sums of signs x, y over n
    bits and the numbers of sentences |a|, |b|.
    """
    n = N_SIGNS
    squares = F.aggregate(
        F.zip_with(_signs(a), _signs(b), lambda x, y: (x - y).cast("double") * (x - y).cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )
    total = (F.element_at(a, N_SUMS + 1) + F.element_at(b, N_SUMS + 1)).cast("double") * F.lit(float(n))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - squares / total))


def with_next(docs: DataFrame, value: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, text, value) with next_text and next_value, those of the next document by ascending id; after the last, the first's.

    Ids are dealt to ranges of about ``block`` documents; within a range a window
    gives the successor, and each range also gets the first document of the next
    range that has any. So every text is moved once, and about one in ``block``
    twice. ``FAN`` squared sampled quantiles of the ids are cut into even ranges
    each, so clusters of ids don't make ranges larger than a quantile. What is
    gathered over all documents is the quantiles with their (least, largest,
    count), and one row per range for the next range's first. Null ids come
    first; rows of one id go by their text; a sole document is its own successor;
    an empty table gives no rows. Null texts become empty.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    number = id_ranges(base, block)
    placed = base.withColumn("value", F.lit(None).cast("string") if value is None else value).withColumn("range", number)
    firsts = base.withColumn("range", number).groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("text"))).alias("first"))
    first = firsts.select("range", F.col("first.doc_id").alias("doc_id"), F.col("first.text").alias("text"))
    guests = first.withColumn("value", F.lit(None).cast("string") if value is None else value).join(_previous(first.select("range")), "range")
    guests = guests.select("doc_id", "text", "value", F.col("previous").alias("range"), F.lit(1).alias("guest"))
    both = placed.withColumn("guest", F.lit(0)).unionByName(guests)
    order = Window.partitionBy("range").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    following = both.withColumns({"next_text": F.lead("text").over(order), "next_value": F.lead("value").over(order)})
    return following.where(F.col("guest") == 0).select("doc_id", "text", "value", "next_text", "next_value")


def _numbers(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _at_or_below(values: list[int], x: Column) -> Column:
    """How many of the sorted values are at most x, looked up in two steps: the steps of FAN, then the values of one step."""
    steps = F.size(F.filter(_numbers(values[FAN - 1 :: FAN] or [values[-1]]), lambda v: v <= x)) if values else F.lit(0)
    return F.transform(F.array(steps), lambda k: k * FAN + F.size(F.filter(F.slice(_numbers(values), k * FAN + 1, F.lit(FAN)), lambda v: v <= x)))[0] if values else F.lit(0)


def id_ranges(docs: DataFrame, block: int = BLOCK) -> Column:
    """An expression for the number of each doc_id's range, ascending with the id: about ``block`` rows each, null ids in the range -1."""
    shares = ",".join(str(k / FAN**2) for k in range(1, FAN**2))
    found = docs.agg(F.expr(f"percentile_approx(cast(doc_id as bigint), cast(split('{shares}', ',') as array<double>), 20000)").alias("q")).first()["q"] or []
    cuts = sorted(set(found))
    segment = _at_or_below(cuts, F.col("doc_id"))
    counted = docs.where("doc_id is not null").groupBy(segment.alias("segment")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    rows = {r["segment"]: r for r in counted.collect()}
    low, width, first, at = [], [], [], 0
    for k in range(len(cuts) + 1):
        least, most, n = (rows[k]["low"], rows[k]["high"], rows[k]["n"]) if k in rows else (0, 0, 0)
        step = max(1, -(-(most - least + 1) // max(1, n // block)))
        low.append(least)
        width.append(min(step, 2**63 - 1))
        first.append(at)
        at += (most - least) // step + 1

    def place(k: Column) -> Column:
        # decimals: ids may span all of 64 bits
        inside = (F.col("doc_id").cast("decimal(20,0)") - F.get(_numbers(low), k).cast("decimal(20,0)")) / F.get(_numbers(width), k).cast("decimal(20,0)")
        return F.get(_numbers(first), k) + F.floor(inside).cast("long")

    return F.coalesce(F.transform(F.array(segment), place)[0], F.lit(-1).cast("long"))


def _previous(ranges: DataFrame, fan: int = 4096) -> DataFrame:
    """Each range with the one before it, the first with the last. Ranges are dealt to coarser ranges to find it."""
    coarse = F.floor(F.col("range") / F.lit(fan))
    inside = Window.partitionBy("coarse").orderBy("range")
    near = ranges.withColumn("coarse", coarse).withColumn("previous", F.lag("range").over(inside))
    heads = near.groupBy("coarse").agg(F.min("range").alias("low"), F.max("range").alias("high"))
    every = Window.orderBy("coarse")
    ends = heads.withColumn("before", F.coalesce(F.lag("high").over(every), F.max("high").over(Window.partitionBy()))).select("coarse", "before")
    return near.join(ends, "coarse").select("range", F.coalesce("previous", "before").alias("previous"))


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by the first as many of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def op5_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likenesses."""
    pairs = with_next(table(spark, sf_dir, "documents"), fingerprint("text"))
    edits = pairs.select("doc_id", "value", "next_value", F.length("text").cast("long").alias("n_chars"), edited_text(F.col("text"), F.col("next_text")).alias("edited"))
    done = edits.withColumn("edit", fingerprint("edited"))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("value")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("value"), F.col("edit")).alias("near_edited"),
        likeness(F.col("value"), F.col("next_value")).alias("near_next"),
    )


def _vector_sql(text: str) -> str:
    number = "('0x' || substr({}, {}, 15))::BIGINT"
    sums = ", ".join(f"(coalesce(list_sum(list_transform(p, lambda x: {number.format('x', 1 + 15 * k)})), 0) % {MASK + 1})::BIGINT" for k in range(N_SUMS))
    counts = ", ".join(
        f"(coalesce(list_sum(list_transform(s, lambda x: (({number.format('x', 1 + 15 * h)}) >> {j}) & {ONES})), 0) % {COUNTS_MASK + 1})::BIGINT"
        for h in range(N_HALVES)
        for j in range(N_SHIFTS)
    )
    return f"""(SELECT [{sums}, len(s)::BIGINT, {counts}] FROM (
      SELECT list_transform(string_split({text}, chr(10)), lambda x: sha256(x)) AS p,
             list_transform(flatten(list_transform(string_split({text}, chr(10)), lambda x: string_split_regex(x, '[.!?;|][ \t\r]+'))), lambda x: md5(x)) AS s))"""


def _likeness_sql(a: str, b: str) -> str:
    signs = "list_transform(flatten(list_transform({0}[6:], lambda w: [w & 2147483647, w >> 31])), lambda ones: 2 * ones - {0}[5])"
    squares = f"list_sum(list_transform(list_zip({signs.format(a)}, {signs.format(b)}), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE))"
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE greatest(0.0, 1.0 - {squares} / (({a}[5] + {b}[5])::DOUBLE * {float(N_SIGNS)}::DOUBLE)) END"


def _text_sql(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda w: lower(lpad(printf('%x', w), 16, '0'))), '')"


OP5_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
following AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM base WINDOW w AS (ORDER BY doc_id NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
edits AS (
  SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM following
),
hashed AS (SELECT doc_id, text, edited, {_vector_sql("text")} AS a, {_vector_sql("edited")} AS b, {_vector_sql("next_text")} AS c FROM edits)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_text_sql("a")} AS fingerprint, {_text_sql("b")} AS edited_fingerprint,
       {_likeness_sql("a", "b")} AS near_edited, {_likeness_sql("a", "c")} AS near_next
FROM hashed
"""
