"""Recognised text on pages, matching of texts to a body, and resolution of package paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SUBSTRING = 12


def clean_spans(texts: Column, scores: Column, boxes: Column, least: float) -> Column:
    """struct(spans, invalid, weak): recognised texts with score and box; boxes of other than four numbers are invalid, low scores weak."""
    zipped = F.transform(F.arrays_zip(texts.alias("t"), scores.alias("s"), boxes.alias("b")), lambda z: F.struct(z["t"].alias("text"), F.round(z["s"], 6).alias("score"), z["b"].alias("box")))

    def bad(z: Column) -> Column:
        return z["text"].isNull() | (F.trim(z["text"]) == "") | z["score"].isNull() | F.isnan(z["score"]) | (F.coalesce(F.size(z["box"]), F.lit(0)) != 4) | F.exists(z["box"], F.isnan)

    good = F.filter(zipped, lambda z: ~F.coalesce(bad(z), F.lit(True)))
    strong = F.filter(good, lambda z: z["score"] >= least)
    return F.struct(strong.alias("spans"), (F.size(zipped) - F.size(good)).alias("invalid"), (F.size(good) - F.size(strong)).alias("weak"))


def baseline_rows(items: DataFrame, page: list[str], gap: float = 0.3) -> DataFrame:
    """Adds ``line``: items of a page (x, y, height) in order of y, a new line where y grows by more than ``gap`` median heights."""
    median = items.groupBy(*page).agg(F.median("height").alias("_median"))
    order = Window.partitionBy(*page).orderBy("y", "x")
    stepped = items.join(median, page).withColumn("_new", (F.col("y") - F.lag("y").over(order) > F.col("_median") * gap).cast("int"))
    return stepped.withColumn("line", F.coalesce(F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) + 1).drop("_new", "_median")


def line_texts(items: DataFrame, page: list[str]) -> DataFrame:
    """Text, box and least score of each line, its items from left to right."""
    grouped = items.groupBy(*page, "line").agg(
        F.array_sort(F.collect_list(F.struct("x", "y", "text"))).alias("i"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("width")).alias("x1"), F.max(F.col("y") + F.col("height")).alias("y1")
    )
    return grouped.withColumn("text", F.array_join(F.transform("i", lambda v: v["text"]), " ")).drop("i")


def match_tokens(text: Column) -> Column:
    """Distinct words of three or more characters, lower-cased."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: F.length(w) >= 3))


def match_body(queries: DataFrame, body: DataFrame) -> DataFrame:
    """Body rows (node_id, text) that hold each query's text (query_id, text): equal, or as a part of 12 characters or more.

    A part may begin and end inside words of the body, so its first and last word
    tell nothing; it is looked up by the rarest of the words between, and the join
    is as small as that word's postings. Only parts without such a word are
    searched for in every body row.
    """
    asked = queries.select("query_id", F.col("text").alias("wanted"))
    equal = asked.join(body, F.col("text") == F.col("wanted")).select("query_id", "node_id", F.lit(True).alias("exact"))
    parts = asked.where(F.length("wanted") >= LEAST_SUBSTRING).withColumn("tokens", match_tokens(F.regexp_replace("wanted", r"^[\p{L}\p{N}]+|[\p{L}\p{N}]+$", "")))
    postings = body.select("node_id", F.explode(match_tokens(F.col("text"))).alias("token"))
    frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counted = parts.select("query_id", "wanted", F.explode("tokens").alias("token")).join(frequency, "token")
    rarest = counted.groupBy("query_id", "wanted").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    by_word = rarest.join(postings, "token").join(body, "node_id")
    by_text = parts.where(F.size("tokens") == 0).select("query_id", "wanted").join(body, F.col("text").contains(F.col("wanted")))
    held = F.col("text").contains(F.col("wanted")) & (F.col("text") != F.col("wanted"))
    columns = ["query_id", "node_id", F.lit(False).alias("exact")]
    return equal.unionByName(by_word.where(held).select(*columns)).unionByName(by_text.where(held).select(*columns))


def unique_matches(matches: DataFrame) -> DataFrame:
    """The node of each query that matches one node only."""
    return matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id")).where("n = 1").drop("n")


def resolve_path(base: Column, target: Column) -> Column:
    """A relative target against the folder of a part; null where it leaves the package."""
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), target))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("parts"), F.lit(False).alias("out"))

    def fold(s: Column, part: Column) -> Column:
        up = part == ".."
        empty = F.size(s["parts"]) == 0
        parts = (
            F.when(up & ~empty, F.slice(s["parts"], F.lit(1), F.greatest(F.size(s["parts"]) - 1, F.lit(0))))
            .when(up | (part == ".") | (part == ""), s["parts"])
            .otherwise(F.array_append(s["parts"], part))
        )
        return F.struct(parts.alias("parts"), (s["out"] | (up & empty)).alias("out"))

    return F.aggregate(F.split(joined, "/", -1), start, fold, lambda s: F.when(~s["out"], F.array_join(s["parts"], "/")))


def sample_offsets(length: Column, width: int, most: int = 64) -> Column:
    """At most ``most`` evenly spaced starts of windows of a width, rounded half to even, distinct; 0 alone for a text no longer than the window."""
    last = F.greatest(F.coalesce(length, F.lit(0)) - width, F.lit(0))
    n = F.least(F.lit(most), last + 1)
    spaced = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.bround(k * last / F.greatest(n - 1, F.lit(1))).cast("int"))
    return F.when(last > 0, F.array_distinct(spaced)).otherwise(F.array(F.lit(0)))


def insertion_points(pages: DataFrame, doc: str, page: str, signature: str) -> DataFrame:
    """Where each page's signature begins in the concatenation of its document's."""
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("position", F.coalesce(F.sum(F.length(signature)).over(before), F.lit(0)))


def replace_spans(text: Column, spans: Column) -> Column:
    """A text with struct(start, end, with) spans replaced, offsets from 0, ends exclusive; null if spans overlap or leave the text."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def fold(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, x["start"] - s["at"])
        return F.struct(F.concat(s["out"], gap, x["with"]).alias("out"), x["end"].alias("at"), (s["ok"] & (x["start"] >= s["at"]) & (x["end"] >= x["start"]) & (x["end"] <= F.length(text))).alias("ok"))

    return F.aggregate(ordered, start, fold, lambda s: F.when(s["ok"], F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text)))))


#: What stays as it is in a text that is rewritten: code, URLs, paths, long hashes, formulas, ids; in order of precedence.
PROTECTED = r"```[\s\S]*?```|`[^`\n]+`|https?://[^\s<>()]+|\$[^$\n]+\$|\b[0-9a-f]{32,64}\b|(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/])+[\w.-]+|\b[A-Z]{2,}-\d+\b"
MARK = ""


def protect(text: Column) -> Column:
    """struct(masked, kept): protected spans replaced by a mark, and the spans in order."""
    return F.struct(F.regexp_replace(text, PROTECTED, MARK).alias("masked"), F.regexp_extract_all(text, F.lit(PROTECTED), 0).alias("kept"))


def restore(masked: Column, kept: Column) -> Column:
    """The masked text with its spans back in place; null if their numbers differ."""
    gaps = F.split(masked, MARK, -1)
    joined = F.array_join(F.zip_with(gaps, kept, lambda g, k: F.concat(g, F.coalesce(k, F.lit("")))), "")
    return F.when(F.size(gaps) == F.size(kept) + 1, joined)
