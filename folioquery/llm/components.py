"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioquery.llm.common import durable

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """The (durable) table, marked for broadcast if it has few enough rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b) edges; the component is its least node.

    Each round gives every node the least label among itself and its neighbours
    and contracts the edges to labels, until no edge is left. Nodes are hashes, so
    a constant share of them goes in each round and the number of rounds is
    logarithmic in the longest path. The rounds' maps are then applied in turn.
    Least labels are found before each shuffle, and how each join runs is left to
    adaptive execution; nothing is collected.
    """
    maps: list[DataFrame] = []
    rest = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
        maps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("label").alias("la")), step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = rest.join(left, "a").join(right, "b").where("la <> lb")
        rest = durable(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).where("node is not null").distinct()
    out = maps[0].select("node", F.col("label").alias("component"))
    for step in maps[1:]:
        nxt = step.select(F.col("node").alias("component"), F.col("label").alias("further"))
        out = out.join(nxt, "component", "left").select("node", F.coalesce("further", "component").alias("component"))
    # a component goes by its least node, which contraction may have merged away
    least = out.groupBy("component").agg(F.min("node").alias("least"))
    return durable(out.join(least, "component").select("node", F.col("least").alias("component")))
