"""Glossary terms, their occurrences in texts, and retrieval of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.functions.text import strip_marks
from folioquery.operators.structure import CJK, json_escaped

#: Unicode word guard for terms that have a Latin letter or a digit.
WORDLIKE = "[A-Za-z0-9]"
#: Kinds of terms that are key items.
KEY_KINDS = ("proper-noun", "jargon", "acronym")
CONFIDENCE_RANK = {"high": 0, "medium": 1}


def literal_pattern(term: Column) -> Column:
    """A term as a regular expression for itself."""
    return F.regexp_replace(term, r"([^\p{L}\p{N}\s])", r"\\$1")


def occurrences(text: Column, term: Column) -> Column:
    """Array of (offset, line) of the leftmost non-overlapping matches of a term: code points before it, and its line from 1.

    A term with a Latin letter or a digit matches whole words only, regardless of
    case; any other matches as it is. The text is split at the matches; offsets
    and lines are running sums over the pieces.
    """
    quoted = literal_pattern(term)
    pattern = F.when(term.rlike(WORDLIKE), F.concat(F.lit(r"(?iuU)(?<!\w)"), quoted, F.lit(r"(?!\w)"))).otherwise(quoted)
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.expr("cast(array() as array<struct<offset:int,line:int>>)").alias("out"))
    in_term = F.length(term) - F.length(F.replace(term, F.lit("\n"), F.lit("")))

    def fold(s: Column, piece: Column) -> Column:
        end = s["at"] + F.length(piece)
        line = s["line"] + F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))
        return F.struct((end + F.length(term)).alias("at"), (line + in_term).alias("line"), F.array_append(s["out"], F.struct(end.alias("offset"), line.alias("line"))).alias("out"))

    return F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), start, fold, lambda s: s["out"])


def normalised_source(source: Column) -> Column:
    """A term in lower case, its white space single spaces."""
    return F.lower(F.regexp_replace(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def content_key(**parts: Column | str) -> Column:
    """24 hexadecimal digits of the SHA-256 of parts as a JSON object with sorted keys; numbers are cast to string by the caller."""
    pairs = [F.concat(F.lit(f'"{name}":'), F.lit(f'"{value}"') if isinstance(value, str) else value) for name, value in sorted(parts.items())]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}")), 256), 1, 24)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), json_escaped(text), F.lit('"'))


def term_key(source: Column, source_hash: Column, first_offset: Column) -> Column:
    """Id of a term in a text: by its normalised form, the text's hash and where it occurs first."""
    return content_key(kind="term", source=_quoted(normalised_source(source)), source_hash=_quoted(source_hash), first_offset=first_offset.cast("string"))


def occurrence_key(term: Column, source_hash: Column, offset: Column, length: Column) -> Column:
    return content_key(kind="occurrence", term_id=_quoted(term), source_hash=_quoted(source_hash), offset=offset.cast("string"), length=length.cast("string"))


def occurrence_ledger(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every term in every document, with ids by content.

    Columns: id, term_id (the glossary's), source, offset, length, line, term_key
    (the term's id in this text), occurrence_id, source_hash and key_item. Key
    items are terms of the kinds in KEY_KINDS, and those of several words that
    occur twice. ``terms`` (term_id, source, and kind if there is one) is a
    glossary, which the caller keeps small; it is joined to each document by a
    nested loop, so documents are not shuffled. Terms without text match nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = terms.select("term_id", F.regexp_replace("source", r"(?U)^\s+|\s+$", "").alias("source"), (F.col("kind") if "kind" in terms.columns else F.lit(None).cast("string")).alias("_kind"))
    pairs = docs.select(id_col, text.alias("_text"), F.sha2(text, 256).alias("source_hash")).crossJoin(known.where("source <> ''"))
    found = pairs.where(F.lower("_text").contains(F.lower("source"))).withColumn("_found", occurrences(F.col("_text"), F.col("source"))).drop("_text")
    several = F.col("source").contains(" ") & (F.size("_found") >= 2)
    known_keys = found.where(F.size("_found") > 0).select(
        id_col, "term_id", "source", "source_hash", "_found", term_key(F.col("source"), F.col("source_hash"), F.col("_found")[0]["offset"]).alias("term_key"),
        (F.coalesce(F.col("_kind").isin(*KEY_KINDS), F.lit(False)) | several).alias("key_item"),
    )
    hits = known_keys.withColumn("_hit", F.explode("_found"))
    length = F.length("source")
    return hits.select(
        id_col, "term_id", "source", F.col("_hit.offset").alias("offset"), length.alias("length"), F.col("_hit.line").alias("line"), "term_key",
        occurrence_key(F.col("term_key"), F.col("source_hash"), F.col("_hit.offset"), length).alias("occurrence_id"), "source_hash", "key_item",
    )


def with_chunk(ledger: DataFrame, chunk_table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ledger with the chunk whose lines hold each occurrence and its line there; the id is the equi-key of the range join."""
    spans = chunk_table.select(F.col(id_col).alias("_id"), "chunk", "start", "end")
    hit = (F.col(id_col) == F.col("_id")) & F.col("line").between(F.col("start"), F.col("end"))
    return ledger.join(spans, hit, "left").withColumn("chunk_line", F.col("line") - F.col("start") + 1).drop("_id", "start", "end")


def substring_count(text: Column, needle: Column) -> Column:
    """Occurrences that don't overlap."""
    gone = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.length(needle)).cast("int")).otherwise(0)


def passage_top_k(terms: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """The k best passages (passage_id, ref, title, text) of each term: first the best of each source, then by score.

    The score is the number of occurrences, and one more if the title has the
    term. Case and combining marks don't count, but for terms with ideographs. Ties go by passage id. A source can take k places at most, so its k
    best rows are kept before rows meet by term; both cuts are made before the
    shuffles by the limit that Spark puts under a window.
    """
    # texts are normalised once each, not for each term
    ready = passages.select("ref", "passage_id", "text", "title", strip_marks("text").alias("plain_text"), strip_marks("title").alias("plain_title"))
    wanted = terms.select("term_id", F.col("source").rlike(CJK).alias("exact"), F.when(F.col("source").rlike(CJK), F.col("source")).otherwise(strip_marks("source")).alias("needle"))
    text, title = (F.when(F.col("exact"), F.col(c)).otherwise(F.col(f"plain_{c}")) for c in ("text", "title"))
    needle = F.col("needle")
    scored = ready.crossJoin(wanted.where("needle <> ''")).where(text.contains(needle) | title.contains(needle))
    score = substring_count(text, needle) + title.contains(needle).cast("int")
    scored = scored.select("term_id", "ref", "passage_id", score.alias("score"))
    by_score = [F.desc("score"), F.asc("passage_id")]
    in_ref = scored.withColumn("in_ref", F.row_number().over(Window.partitionBy("term_id", "ref").orderBy(*by_score))).where(F.col("in_ref") <= k)
    order = Window.partitionBy("term_id").orderBy((F.col("in_ref") > 1).cast("int"), *by_score)
    return in_ref.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("term_id", "place", "passage_id", "ref", "score")


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(3)
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def glossary_slice(candidates: DataFrame, cap: int, group: str = "chunk_key") -> DataFrame:
    """At most ``cap`` terms of each group: by confidence, occurrences (more first), protected ones first, then source."""
    order = Window.partitionBy(group).orderBy(confidence_rank(F.col("confidence")), F.desc("occurrences"), F.desc("protected"), "source")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def batches(rows: DataFrame, size: int, order: list[Column], group: str) -> DataFrame:
    """Rows of each group numbered in order and dealt to batches of ``size``."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch", F.floor((place - 1) / size) + 1)


def adjacent(rows: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the next one of its group, ``next_`` before its columns; a group's last row is left out."""
    over = Window.partitionBy(*group).orderBy(*order)
    following = rows.withColumns({f"next_{c}": F.lead(c).over(over) for c in columns} | {"_more": F.lead(F.lit(1)).over(over)})
    return following.where(F.col("_more") == 1).drop("_more")


def set_difference(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with what is wrong with them: missing, unknown or duplicate."""
    left = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("wanted"))
    right = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    both = left.join(right, keys, "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("found") > 1, "duplicate").otherwise("ok")
    return both.select(*keys, state.alias("state"))
