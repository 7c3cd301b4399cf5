"""Alignment of sequences, islands of numbers, and boxes on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_runs(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, first, last, n) of the maximal runs of consecutive whole numbers in each group."""
    distinct = rows.select(*group, value).distinct()
    island = F.col(value) - F.row_number().over(Window.partitionBy(*group).orderBy(value))
    return distinct.withColumn("_island", island).groupBy(*group, "_island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("_island")


def range_text(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))


def neighbours(rows: DataFrame, group: str, order: str, value: Column) -> DataFrame:
    """Each row with the nearest value that isn't null before and after it."""
    base = Window.partitionBy(group).orderBy(order)
    before, after = base.rowsBetween(Window.unboundedPreceding, -1), base.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("_v", value).withColumns({"before": F.last("_v", True).over(before), "after": F.first("_v", True).over(after)}).drop("_v")


def pair_by_rank(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of the left with the k-th of the right for each key; left rows beyond the right have none."""
    a = left.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    b = right.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(right_order)))
    return a.join(b, [key, "k"], "left")


def unique_position(text: Column, needle: Column) -> Column:
    """Offset of a needle that occurs exactly once, overlaps counted; else null."""
    first = F.instr(text, needle)
    rest = F.substring(text, first + 1, F.length(text))
    return F.when((F.length(needle) > 0) & (first > 0) & (F.instr(rest, needle) == 0), first - 1)


def overlaps(boxes: DataFrame, page: str, cell: float, margin: float = 0.0) -> DataFrame:
    """Pairs (a, b) of boxes (id, page, x0, y0, x1, y1) of a page that overlap within a margin, a < b.

    Boxes are dealt to the grid cells that they touch and joined by cell; a pair
    is reported in the cell of its common lower corner alone, so no distinct is
    needed. The cells of a box are bounded by its size.
    """
    lo = {c: F.floor((F.col(f"{c}0") - margin) / cell).cast("int") for c in "xy"}
    hi = {c: F.floor((F.col(f"{c}1") + margin) / cell).cast("int") for c in "xy"}
    gridded = boxes.withColumn("gx", F.explode(F.sequence(lo["x"], hi["x"]))).withColumn("gy", F.explode(F.sequence(lo["y"], hi["y"])))
    a = gridded.select(page, "gx", "gy", *[F.col(c).alias(f"a_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
    b = gridded.select(page, "gx", "gy", *[F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
    meet = (
        (F.col("a_id") < F.col("b_id"))
        & (F.col("a_x0") <= F.col("b_x1") + margin) & (F.col("b_x0") <= F.col("a_x1") + margin)
        & (F.col("a_y0") <= F.col("b_y1") + margin) & (F.col("b_y0") <= F.col("a_y1") + margin)
    )
    own = [F.col(f"g{c}") == F.floor((F.greatest(f"a_{c}0", f"b_{c}0") - margin) / cell).cast("int") for c in "xy"]
    return a.join(b, [page, "gx", "gy"]).where(meet & own[0] & own[1]).select(page, F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def bounding_boxes(boxes: DataFrame, page: str) -> DataFrame:
    return boxes.groupBy(page).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("boxes"))
