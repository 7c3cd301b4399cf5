"""Mixing sources to target weights: repetition rates from word totals, seeded Bernoulli copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioquery.llm.common import durable, fresh, numbered, quoted, table

#: A word of the size: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = "mix"
#: Hexadecimal digits of the hash that become the draw; 52 bits are exact in a double.
_DIGITS = 13


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest(seed: str = SEED) -> Column:
    """What a document's draws depend on: the seed, its id, source and text; nulls count as empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws("\x1f", F.lit(seed), *parts))


def draw(key: Column, ordinal: Column) -> Column:
    """A number in [0, 1) for the ordinal-th row of one digest."""
    hexadecimal = F.md5(F.concat(key, F.lit(":"), ordinal.cast("string")))
    return F.conv(F.substring(hexadecimal, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Target words of each source, from a table of (source, source_size): one row a source.

    Sources take the weights in turn, by code point and null last, and share the
    sum of all sizes by weight. A target stops at ``most_times`` its source's
    size; the excess goes to the others by weight until none is above. In the
    order of size/weight the stopped sources come first, so running sums over
    the sources settle it without iterating. Sums are whole numbers: the result
    doesn't depend on the order of addition.
    """
    whole = 1
    for w in weights:
        whole *= w
    order = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long"))
    by_ratio = Window.orderBy((F.col("source_size") * (F.lit(whole) / F.col("weight")).cast("long")), F.asc_nulls_last("source"))
    everyone = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * most_times
    filled = (
        ranked.withColumn("place", F.row_number().over(by_ratio))
        .withColumn("left_words", F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(after))
        .withColumn("free", F.col("weight") * F.col("left_words") <= cap * F.col("left_weight"))
        .withColumn("first", F.min(F.when(F.col("free"), F.struct("place", "left_words", "left_weight"))).over(everyone))
    )
    share = (F.col("weight") * F.col("first.left_words")).cast("double") / F.col("first.left_weight").cast("double")
    return filled.select(
        "source", "source_size", F.when(F.col("place") >= F.col("first.place"), share).otherwise(cap.cast("double")).alias("target")
    )


def copies_of(rate: Column, key: Column, ordinal: Column) -> Column:
    """floor(rate), and one more with the fraction's probability."""
    whole = F.floor(rate)
    return F.coalesce(whole + F.when(draw(key, ordinal) < rate - whole, 1).otherwise(0), F.lit(0)).cast("long")


def mixing_plan(measured: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """A table (doc_id, source, size, digest, ordinal) with source_size, target, copies and taken: one row per row.

    Sizes are summed per source before any shuffle, so a source with most of the
    rows costs no more than another; the join is with one row per source, which
    Spark broadcasts only if its measured size allows, and otherwise splits a hot
    source. Null sources form one source. An empty table gives no rows; a source
    without words has target 0 and no copies.
    """
    totals = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, most_times).withColumnRenamed("source", "_source")
    joined = measured.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    return joined.withColumn("copies", copies_of(rate, F.col("digest"), F.col("ordinal"))).withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """The documents, each as many times as the plan takes it; the columns stay as they are.

    Whole texts are counted and copied; null texts have size 0 and follow their
    source's rate. Rows that are equal in id, source and text, null ids too, have
    a draw each; which of them has which is left open. Columns besides doc_id,
    text and source are carried along, whatever their names. An empty table
    gives no rows.
    """
    sizes = docs.select(F.col("source").alias("source"), word_count(F.col("text")).alias("size"))
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_times)
    source, rate, key, ordinal, copy = fresh(docs.columns, "rate_source", "rate", "digest", "ordinal", "copy")
    rates = targets.select(F.col("source").alias(source), (F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).alias(rate))
    rows = numbered(docs.withColumn(key, digest(seed)), key, ordinal)
    planned = rows.join(rates, F.col("source").eqNullSafe(F.col(source)), "left")
    copies = copies_of(F.col(rate), F.col(key), F.col(ordinal))
    taken = planned.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return taken.select(*quoted(docs.columns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    measured = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest().alias("digest")))
    return mixing_plan(numbered(measured, "digest", "ordinal")).select("doc_id", "size", "source_size", "target", "taken")


TARGETS_SQL = """
measured AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(source, '') || chr(31) || coalesce(text, '')) AS digest
  FROM {docs}
),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM measured GROUP BY source),
weighted AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM totals
),
ordered AS (
  SELECT *, row_number() OVER w AS place, sum(source_size) OVER ()
         - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighted WINDOW w AS (ORDER BY source_size * (10 // weight), source ASC NULLS LAST)
),
level AS (
  SELECT place AS first_place, left_words AS words, left_weight AS weights FROM ordered
  WHERE weight * left_words <= 3 * source_size * left_weight ORDER BY place LIMIT 1
),
targets AS (
  SELECT source, source_size,
         CASE WHEN place >= first_place THEN (weight * words)::DOUBLE / weights::DOUBLE ELSE (3 * source_size)::DOUBLE END AS target
  FROM ordered CROSS JOIN level
),
drawn AS (
  SELECT m.doc_id, m.source, m.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE END AS rate,
         ('0x' || substr(md5(m.digest || ':' || m.ordinal), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM (SELECT *, row_number() OVER (PARTITION BY digest) AS ordinal FROM measured) m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source
)
"""

OP6_SQL = (
    "WITH "
    + TARGETS_SQL.format(docs="documents")
    + """
SELECT doc_id, size, source_size, target,
       size * coalesce(floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT, 0) AS taken
FROM drawn
"""
)
