"""Review runs: findings, groundings, dependency graphs, result events and reduction trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.operators.blocks import pack

SEVERITIES = ("high", "medium", "low")
ATTEMPTS = 3
#: Children of a reducer: a budget of 50 000 characters with 10 001 for each child's output.
ARITY, DEPTH = 4, 3


def severity_rank(severity: Column) -> Column:
    """Place of a severity; a missing one counts as medium."""
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(SEVERITIES) for x in (s, i)])
    return F.coalesce(F.element_at(ranks, severity), F.lit(1))


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """One finding for each (first_line, trimmed original, category) of a document.

    The best severity wins and the longest revision and reason, of equal ones the
    earliest by ``ordinal``; evidence is united. Sums per key before the shuffle.
    """

    def longest(name: str) -> Column:
        return F.max_by(name, F.struct(F.length(F.coalesce(name, F.lit(""))), -F.col("ordinal"))).alias(name)

    keyed = findings.withColumn("original", F.trim("original"))
    merged = keyed.groupBy("doc_id", "first_line", "original", "category").agg(
        F.min(severity_rank(F.col("severity"))).alias("rank"),
        longest("revised"),
        longest("reason"),
        F.array_sort(F.collect_set("evidence")).alias("evidence"),
        F.min("ordinal").alias("ordinal"),
        F.count(F.lit(1)).alias("merged"),
    )
    return merged.withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("rank") + 1)).drop("rank")


def report_order(findings: DataFrame) -> DataFrame:
    """Numbers findings of a document: by first line (none last), severity and first appearance."""
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("first_line"), severity_rank(F.col("severity")), "ordinal")
    return findings.withColumn("place", F.row_number().over(order))


def grounding(claims: DataFrame, passages: DataFrame, assessments: DataFrame) -> DataFrame:
    """Verdict on each claim from its assessments against every passage.

    A missing assessment leaves it unverified; else one contradiction decides;
    else no basis anywhere; else it is supported. The number of passages is
    counted instead of pairing every claim with every passage.
    """
    n = passages.agg(F.count(F.lit(1)).alias("passages"))
    known = assessments.join(passages.select("passage_id"), "passage_id", "left_semi").groupBy("claim_id").agg(
        F.countDistinct(F.when(F.col("status").isNotNull(), F.col("passage_id"))).alias("assessed"),
        F.count_if(F.col("status") == "contradicted").alias("against"),
        F.count_if(F.col("status") != "no-basis").alias("based"),
    )
    joined = claims.join(known, "claim_id", "left").crossJoin(F.broadcast(n)).fillna(0, ["assessed", "against", "based"])
    verdict = (
        F.when(F.col("assessed") < F.col("passages"), "unverified")
        .when(F.col("against") > 0, "contradicted")
        .when((F.col("based") == 0) & (F.col("passages") > 0), "no-basis")
        .otherwise("supported")
    )
    return joined.select("claim_id", "assessed", verdict.alias("verdict"))


def ready_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Pending cells (cell_id, status) all of whose dependencies (cell_id, needs) are accepted."""
    accepted = cells.where(F.col("status") == "accepted").select(F.col("cell_id").alias("needs"))
    unmet = edges.join(accepted, "needs", "left_anti").select("cell_id").distinct()
    return cells.where(F.col("status") == "pending").join(unmet, "cell_id", "left_anti")


def ingest(events: DataFrame) -> DataFrame:
    """Outcome of each result event (cell_id, seq, payload, valid, stale), in order of ``seq`` within a cell.

    Stale events count for nothing. The first valid one is accepted unless three
    invalid ones came before; the third invalid one fails the cell and closes it.
    After acceptance an equal payload is a repeat and another one a conflict.
    """
    before = Window.partitionBy("cell_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("cell_id")
    counted = events.withColumn("invalid_before", F.coalesce(F.count_if(~F.col("stale") & ~F.col("valid")).over(before), F.lit(0)))
    takes = ~F.col("stale") & F.col("valid") & (F.col("invalid_before") < ATTEMPTS)
    first = counted.withColumn("accepted", F.min(F.when(takes, F.struct("seq", "payload"))).over(whole))
    open_ = F.col("accepted").isNull() | (F.col("seq") < F.col("accepted.seq"))
    outcome = (
        F.when(F.col("stale"), "stale")
        .when(open_ & (F.col("invalid_before") >= ATTEMPTS), "closed")
        .when(open_ & (F.col("invalid_before") == ATTEMPTS - 1), "failed")
        .when(open_, "invalid")
        .when(F.col("seq") == F.col("accepted.seq"), "accepted")
        .when(F.col("payload") == F.col("accepted.payload"), "repeat")
        .otherwise("conflict")
    )
    return first.select("cell_id", "seq", outcome.alias("outcome"))


def reducer_tree(leaves: DataFrame) -> DataFrame:
    """(doc_id, layer, cells): layers of reducers over ``leaves`` results of each document, until one is left or the depth is used up."""
    sizes = F.aggregate(
        F.sequence(F.lit(1), F.lit(DEPTH)),
        F.array(F.col("leaves").cast("long")),
        lambda acc, _: F.when(F.element_at(acc, -1) > 1, F.array_append(acc, F.ceil(F.element_at(acc, -1) / ARITY).cast("long"))).otherwise(acc),
    )
    layers = leaves.select("doc_id", F.posexplode(sizes).alias("layer", "cells"))
    return layers.where("layer > 0")


def json_batches(groups: DataFrame, items: str, limit: int, id_col: str) -> DataFrame:
    """Packs each row's array of JSON texts into arrays of at most ``limit`` characters, brackets and commas counted."""
    starts = pack(F.transform(items, lambda x: F.length(x) + 1), limit - 1)
    each = groups.select(id_col, items, F.posexplode(starts).alias("batch", "first"), F.size(items).alias("n"), starts.alias("starts"))
    end = F.coalesce(F.get("starts", F.col("batch") + 1), F.col("n"))
    part = F.slice(items, F.col("first") + 1, end - F.col("first"))
    return each.select(id_col, (F.col("batch") + 1).alias("batch"), F.size(part).alias("items"), (F.length(F.array_join(part, ",")) + 2).alias("chars"))
