"""The heaviest chain of matches that increases on both sides, page by page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heaviest_chain(left: list[int], right: list[int], weight: list[float]) -> list[int]:
    """Indices of the matches of the largest total weight that strictly increase in left and right; of equal ones the first found."""
    order = sorted(range(len(left)), key=lambda k: (left[k], right[k], k))
    rights = sorted(set(right))
    rank = {r: i + 1 for i, r in enumerate(rights)}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(rights) + 1)
    before = [-1] * len(left)
    best, at = (0.0, -1), 0
    while at < len(order):
        # matches of one left place see only those of earlier places
        end = at
        while end < len(order) and left[order[end]] == left[order[at]]:
            end += 1
        found = []
        for k in order[at:end]:
            total, i = (0.0, -1), rank[right[k]] - 1
            while i > 0:
                if tree[i][0] > total[0]:
                    total = tree[i]
                i -= i & -i
            before[k] = total[1]
            found.append((total[0] + weight[k], k))
        for total, k in found:
            if total > best[0]:
                best = (total, k)
            i = rank[right[k]]
            while i <= len(rights):
                if total > tree[i][0]:
                    tree[i] = (total, k)
                i += i & -i
        at = end
    out, k = [], best[1]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def page_chains(matches: DataFrame, page: list[str]) -> DataFrame:
    """Matches (page, left, right, weight) that are on their page's heaviest chain; a page is bounded by its lines and handled at once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group.iloc[heaviest_chain(group["left"].tolist(), group["right"].tolist(), group["weight"].tolist())]

    return matches.groupBy(*page).applyInPandas(run, matches.schema)


def coverage(matches: DataFrame, chained: DataFrame, page: list[str], least: float = 0.9) -> DataFrame:
    """Share of each page's weight that its chain holds, and whether that is enough."""
    total = matches.groupBy(*page).agg(F.sum("weight").alias("total"))
    held = chained.groupBy(*page).agg(F.sum("weight").alias("held"))
    joined = total.join(held, page, "left").withColumn("share", F.coalesce("held", F.lit(0)) / F.col("total"))
    return joined.select(*page, "total", F.coalesce("held", F.lit(0)).alias("held"), (F.col("share") >= least).alias("enough"))
