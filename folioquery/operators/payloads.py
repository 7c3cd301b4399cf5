"""Payloads of stages against what was planned: ledgers, translations, memories, findings, jobs and canonical documents, as rows of problems.

Every check joins or sums rows by run (or document) and id, so a payload of any
size is spread over tasks; only lists that a report cuts to a few ids are brought
together, after they are cut.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioquery.operators.blocks import let, pack
from folioquery.operators.review import ARITY, DEPTH
from folioquery.operators.validation import PAYLOAD_CHARS, problems

# States in which an occurrence may end, those that need a reason and those that leave it open.
ENDED = ["applied", "preserved", "transliterated", "user_confirmed", "not_applicable", "conflict", "unresolved"]
REASONED = ["not_applicable", "preserved", "transliterated", "user_confirmed", "conflict"]
OPEN = ["unresolved", "conflict"]
# What stands for an original that the text lacks.
MISSING_ORIGINALS = ["[Missing from source]", "[原文缺失]"]
# Types of nodes that make a document usable, states of its quality, places of an image.
USABLE = ["heading", "paragraph", "list_item", "code", "table", "image"]
QUALITIES = ["complete", "complete_with_warnings", "partial"]
# Fields of a runner's result and the interface it must name.
RESULT_FIELDS = ["abi", "status", "exit_code", "command", "data", "issues"]
ABI = "anti-entropy-core.runner/v1"
#: Characters of a job's claims and passages as JSON, ids that a report names, lines that continue a match.
JOB_CHARS, NAMED, TAIL_LINES = 50_000, 5, 32


def _absent(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def _id_faults(given: DataFrame, keys: list[str], faults: Column) -> DataFrame:
    """(keys, problem): the faults of each row, and a row for each key that is there more than once. A missing id is a fault and no repeat."""
    own = given.select(*keys, F.explode(faults).alias("problem"))
    repeats = given.where(~_absent(F.col(keys[-1]))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.unionByName(repeats.select(*keys, F.lit("duplicate_id").alias("problem")))


def ledger_problems(ledger: DataFrame) -> DataFrame:
    """(run_id, occurrence_id, problem) of a ledger (disposition, reason, key_item): ids that are missing or repeated, and how each occurrence ended."""
    ended = F.col("disposition")
    faults = problems(
        missing_id=~_absent(F.col("occurrence_id")),
        no_disposition=ended.isin(ENDED),
        no_reason=~F.coalesce(ended.isin(REASONED), F.lit(False)) | ~_absent(F.col("reason")),
        unresolved=~F.coalesce(ended.isin(OPEN), F.lit(False)),
        key_unresolved=~F.coalesce("key_item", F.lit(False)) | ended.isNotNull(),
    )
    return _id_faults(ledger, ["run_id", "occurrence_id"], faults)


def occurrence_gaps(expected: DataFrame, claimed: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """(keys, missing, unknown, repeated, and the first few ids of the first two): what a translation's list of occurrence ids leaves out or makes up.

    Groups without a fault have no row. Null ids of the ledger aren't expected.
    """
    key = [*keys, "occurrence_id"]
    wanted = expected.where(~_absent(F.col("occurrence_id"))).select(*key).distinct().withColumn("wanted", F.lit(True))
    found = claimed.groupBy(*key).agg(F.count(F.lit(1)).alias("found"))
    both = wanted.join(found, key, "full")
    state = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unknown")
    faulty = both.withColumn("state", state).where("state IS NOT NULL OR found > 1")
    counts = faulty.groupBy(*keys).agg(
        F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "unknown").alias("unknown"), F.count_if(F.col("found") > 1).alias("repeated"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "state").orderBy("occurrence_id"))
    first = faulty.where("state IS NOT NULL").withColumn("k", rank).where(F.col("k") <= NAMED)

    def named(which: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == which, F.col("occurrence_id")))), ", ").alias(f"{which}_ids")

    return counts.join(first.groupBy(*keys).agg(named("missing"), named("unknown")), list(keys), "left").fillna("", ["missing_ids", "unknown_ids"])


def planned_faults(planned: DataFrame, given: DataFrame, keys: list[str], faults: Column) -> DataFrame:
    """(keys, problem): the faults of each given row, repeated keys, planned keys that are missing and given ones that weren't planned."""
    ids = given.where(F.col(keys[-1]).isNotNull()).select(*keys).distinct()
    plan = planned.select(*keys).distinct()
    missing = plan.join(ids, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    unknown = ids.join(plan, keys, "left_anti").select(*keys, F.lit("unknown").alias("problem"))
    repeats = given.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("duplicate_id").alias("problem"))
    return given.select(*keys, F.explode(faults).alias("problem")).unionByName(repeats).unionByName(missing).unionByName(unknown)


def translation_problems(planned: DataFrame, given: DataFrame) -> DataFrame:
    """Faults of translated chunks (run_id, chunk, text, occurrence_ids) against the planned ones."""
    faults = problems(missing_id=F.col("chunk").isNotNull(), empty=F.regexp_replace("text", r"(?U)\s+", "") != "", no_occurrence_ids=F.col("occurrence_ids").isNotNull() & ~F.exists("occurrence_ids", lambda x: x.isNull()))
    return planned_faults(planned, given, ["run_id", "chunk"], faults)


def assembly_digests(given: DataFrame) -> DataFrame:
    """(run_id, sha256): hash of a run's chunks in order with a blank line between; null if one of them has no text or number."""
    grouped = given.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("c"), F.bool_or(F.col("chunk").isNull() | F.col("text").isNull()).alias("broken"))
    return grouped.select("run_id", F.when(~F.col("broken"), F.sha2(F.array_join(F.transform("c", lambda x: x["text"]), "\n\n"), 256)).alias("sha256"))


def memory_problems(planned: DataFrame, given: DataFrame) -> DataFrame:
    """Faults of read passages (run_id, passage_id, status) against the planned ones."""
    return planned_faults(planned, given, ["run_id", "passage_id"], problems(missing_id=~_absent(F.col("passage_id")), not_completed=F.col("status") == "completed"))


def retrieval_problems(passages: Column, status: Column, provider: Column, has_results: Column, reason: Column) -> Column:
    """What is wrong with a run's note on retrieval: with passages it must be completed, name its provider and list results; without any it must say why it doesn't apply."""
    done = problems(provenance=(status == "completed") & ~_absent(provider), results=has_results)
    without = problems(not_applicable=(status == "not_applicable") & ~_absent(reason))
    return F.when(passages > 0, done).otherwise(without)


def matching_problems(expected: DataFrame, given: DataFrame, fields: list[str]) -> DataFrame:
    """(run_id, occurrence_id, problem): occurrences that aren't those of the ledger, or are but differ in a field, lack evidence or a proof that they don't apply.

    ``given`` has the ledger's fields and origin, disposition, evidence (a number) and mismatch (a boolean).
    """
    keys = ["run_id", "occurrence_id"]
    faults = problems(
        missing_id=~_absent(F.col("occurrence_id")),
        no_evidence=~F.coalesce((F.col("origin") == "reference") & (F.col("disposition") == "applied"), F.lit(False)) | (F.coalesce("evidence", F.lit(0)) > 0),
        no_mismatch=~F.coalesce(F.col("disposition") == "not_applicable", F.lit(False)) | F.coalesce("mismatch", F.lit(False)),
    )
    own = planned_faults(expected, given, keys, faults)
    right = expected.select(*keys, *[F.col(f).alias(f"_expected_{f}") for f in fields])
    stale = problems(**{f"stale_{f}": F.col(f).eqNullSafe(F.col(f"_expected_{f}")) for f in fields})
    return own.unionByName(given.join(right, keys).select(*keys, F.explode(stale).alias("problem")))


def review_finding_problems(finding: dict[str, Column], lines: Column, core_first: Column, core_last: Column, categories: Column) -> Column:
    """Problems of a finding: its category, its texts, its locations, and for each of them (counted from 0) whether it is in the source, in the core, and verbatim.

    ``finding`` has category, original, revised, change, reason and locations
    (start_line, end_line). A null core has no bounds. A location outside the source
    isn't looked at further.
    """
    filled = F.lit(True)
    for name in ("original", "revised", "change", "reason"):
        filled = filled & (F.trim(finding[name]) != "")

    def at(place: Column, k: Column) -> Column:
        start, end = place["start_line"], place["end_line"]
        inside = F.coalesce((start >= 1) & (end >= start) & (end <= F.size(lines)), F.lit(False))
        shown = F.array_join(F.slice(lines, F.when(inside, start).otherwise(1), F.when(inside, end - start + 1).otherwise(0)), "\n")
        core = core_first.isNull() | ((start >= core_first) & (end <= core_last))
        verbatim = finding["original"].isin(MISSING_ORIGINALS) | shown.contains(F.coalesce(finding["original"], F.lit("")))
        names = F.when(~inside, F.array(F.lit("outside_source"))).otherwise(F.array_compact(F.array(F.when(~core, F.lit("outside_core")), F.when(~verbatim, F.lit("not_verbatim")))))
        return F.transform(names, lambda n: F.concat(F.lit("locations["), k.cast("string"), F.lit("]:"), n))

    places = F.coalesce(F.flatten(F.transform(finding["locations"], at)), F.array().cast("array<string>"))
    own = problems(category=F.array_contains(categories, finding["category"]), fields=filled, locations=F.size(finding["locations"]) > 0)
    return F.concat(own, places)


def semantic_jobs(claims: DataFrame, passages: DataFrame, most: int = JOB_CHARS) -> DataFrame:
    """(run_id, cell_id, dimension, origin, claims, passages, first, collects_facts): the claims of each origin against batches of the run's passages.

    ``claims`` has run_id, origin and chars (of the claim as JSON), ``passages``
    run_id, passage_id and chars. Batches are packed in order of the passages' ids so
    that claims and passages fit a job; those of the first origin collect facts, and a
    run without claims has jobs for facts only. A passage that doesn't fit makes a
    job of its own, whose ``fits`` is false. Runs without passages have no jobs.
    """
    wanted = passages.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("passage_id", "chars"))).alias("p"))
    groups = claims.groupBy("run_id", "origin").agg(F.count(F.lit(1)).alias("claims"), F.sum(F.col("chars") + 1).alias("_chars"))
    joined = wanted.join(groups, "run_id", "left").withColumns({"claims": F.coalesce("claims", F.lit(0)), "_room": F.lit(most) - len('{"claims":[],"passages":[]}') - F.coalesce(F.col("_chars") - 1, F.lit(0))})
    placed = joined.withColumn("group", F.row_number().over(Window.partitionBy("run_id").orderBy("origin")))
    starts = placed.withColumn("starts", pack(F.transform("p", lambda x: (x["chars"] + 1).cast("long")), F.col("_room") + 1))
    each = starts.select("*", F.posexplode("starts").alias("batch", "at"))
    until = F.coalesce(F.get("starts", F.col("batch") + 1), F.size("p"))
    part = F.slice("p", F.col("at") + 1, until - F.col("at"))
    size = F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x["chars"] + 1)
    number = F.row_number().over(Window.partitionBy("run_id").orderBy("group", "batch"))
    return each.select(
        "run_id", F.concat(F.lit("reference:semantic:"), F.lpad(number.cast("string"), F.greatest(F.lit(3), F.length(number.cast("string"))), F.lit("0"))).alias("cell_id"),
        F.when(F.col("claims") > 0, "semantic-routing").otherwise("facts-only").alias("dimension"), "origin", "claims", F.size(part).alias("passages"),
        F.get(part, F.lit(0))["passage_id"].alias("first"), (F.col("group") == 1).alias("collects_facts"), (size <= F.col("_room") + 1).alias("fits"),
    )


def final_cells(runs: DataFrame) -> DataFrame:
    """Last cells of a run (run_id, claims, facts, candidates): coverage always, adjudication where a claim is contradicted or has no basis."""
    coverage = F.struct(F.lit("reference:coverage").alias("cell_id"), F.lit("reference-coverage").alias("dimension"))
    judged = F.struct(F.lit("reference:adjudication").alias("cell_id"), F.lit("reference-adjudication").alias("dimension"))
    cells = F.when(F.col("candidates") > 0, F.array(coverage, judged)).otherwise(F.array(coverage))
    return runs.select("run_id", "claims", "facts", "candidates", F.explode(cells).alias("c")).select("run_id", "c.*", "claims", "facts", "candidates")


def reducer_cells(leaves: DataFrame) -> DataFrame:
    """(doc_id, depth, batch, output_id, first, last, budget): which results of the layer below, counted from 1, each reducer of a document takes.

    ``leaves`` has doc_id and leaves (their number). Layers end with one reducer, or
    at the greatest depth, whose cells then have a ``problem``.
    """
    sizes = F.aggregate(
        F.sequence(F.lit(1), F.lit(DEPTH)), F.array(F.col("leaves").cast("long")),
        lambda a, d: F.when((d == 1) & (F.element_at(a, -1) > 0) | (F.element_at(a, -1) > 1), F.array_append(a, F.ceil(F.element_at(a, -1) / ARITY).cast("long"))).otherwise(a),
    )
    layers = leaves.select("doc_id", sizes.alias("s")).select("doc_id", "s", F.posexplode("s").alias("depth", "cells")).where("depth > 0 AND cells > 0")
    each = layers.select("doc_id", "depth", F.get("s", F.col("depth") - 1).alias("below"), (F.element_at("s", -1) > 1).alias("open"), F.explode(F.sequence(F.lit(1).cast("long"), "cells")).alias("batch"))
    last = F.least(F.col("batch") * ARITY, "below")
    name = F.concat(F.lit("global:reduce:d"), F.col("depth").cast("string"), F.lit(":b"), F.lpad(F.col("batch").cast("string"), F.greatest(F.lit(3), F.length(F.col("batch").cast("string"))), F.lit("0")))
    first = (F.col("batch") - 1) * ARITY + 1
    return each.select(
        "doc_id", "depth", "batch", name.alias("output_id"), first.alias("first"), last.alias("last"), ((last - first + 1) * PAYLOAD_CHARS).alias("budget"),
        F.when(F.col("open") & (F.col("depth") == DEPTH), "not_converged").alias("problem"),
    )


def document_problems(docs: DataFrame, nodes: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, problem) of canonical documents (doc_id, document_id, source_sha256, status): state, usable content, id, and the state that the warnings ask for."""
    content = nodes.groupBy("doc_id").agg(F.count_if(F.col("type").isin(USABLE)).alias("usable"))
    noted = warnings.groupBy("doc_id").agg(F.bool_or("content_loss").alias("loss"))
    joined = docs.join(content, "doc_id", "left").join(noted, "doc_id", "left")
    state = F.when(F.col("loss"), "partial").when(F.col("loss").isNotNull(), "complete_with_warnings").otherwise("complete")
    faults = problems(
        status=F.col("status").isin(QUALITIES), no_content=F.coalesce("usable", F.lit(0)) > 0, document_id=F.col("document_id") == F.concat(F.lit("sha256:"), F.col("source_sha256")), warnings=F.col("status") == state,
    )
    return joined.select("doc_id", F.explode(faults).alias("problem"))


def node_problems(nodes: DataFrame, tables: DataFrame, assets: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, node_id, problem) of nodes (type, unit_id, table_id, asset_id) that refer to a unit, table or asset their document hasn't."""

    def known(rows: DataFrame, key: str) -> DataFrame:
        return rows.select("doc_id", key).distinct().withColumn(f"_{key}", F.lit(True))

    joined = nodes.join(known(units, "unit_id"), ["doc_id", "unit_id"], "left").join(known(tables, "table_id"), ["doc_id", "table_id"], "left").join(known(assets, "asset_id"), ["doc_id", "asset_id"], "left")
    faults = problems(
        unit=_absent(F.col("unit_id")) | F.col("_unit_id"), table=(F.col("type") != "table") | F.col("_table_id"), asset=(F.col("type") != "image") | F.col("_asset_id"),
    )
    return joined.select("doc_id", "node_id", F.explode(faults).alias("problem"))


def placement_problems(placed: DataFrame, nodes: DataFrame, assets: DataFrame, units: DataFrame) -> DataFrame:
    """(doc_id, unit_id, occurrence, problem) of image occurrences (asset_id, placement, node_id): what they refer to, their number, which is there once, and whether they have a node just if they are placed."""

    def known(rows: DataFrame, key: str) -> DataFrame:
        return rows.select("doc_id", key).distinct().withColumn(f"_{key}", F.lit(True))

    keys = ["doc_id", "unit_id", "occurrence"]
    joined = placed.join(known(units, "unit_id"), ["doc_id", "unit_id"], "left").join(known(assets, "asset_id"), ["doc_id", "asset_id"], "left").join(known(nodes, "node_id"), ["doc_id", "node_id"], "left")
    resolved, unresolved = F.col("placement") == "resolved", F.col("placement") == "unresolved"
    faults = problems(
        unit=F.col("_unit_id"), asset=F.col("_asset_id"), occurrence=F.col("occurrence") >= 1, placement=resolved | unresolved,
        node=F.when(resolved, F.coalesce("_node_id", F.lit(False))).when(unresolved, F.col("node_id").isNull()).otherwise(True),
    )
    repeats = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys, F.lit("repeated").alias("problem"))
    return joined.select(*keys, F.explode(faults).alias("problem")).unionByName(repeats)


def math_text(text: Column, block: Column) -> Column:
    """A formula between dollar signs, a block between lines of two; blank ones are empty."""
    inner = F.coalesce(text, F.lit(""))
    return F.when(F.regexp_replace(inner, r"(?U)\s+", "") == "", "").when(block, F.concat(F.lit("$$\n"), inner, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), inner, F.lit("$")))


def runner_problem(command: Column, output: Column) -> Column:
    """Why a runner's output isn't its one line of JSON with the result of the command, or null."""
    lines = F.filter(F.split(F.coalesce(output, F.lit("")), r"\r\n|\r|\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+", "") != "")

    def judge(line: Column, parsed: Column) -> Column:
        fields = F.map_keys(F.from_json(line, "map<string,string>"))
        lacking = F.array_join(F.filter(F.array(*map(F.lit, RESULT_FIELDS)), lambda f: ~F.array_contains(fields, f)), ",")

        def kind(name: str) -> Column:
            return F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant"))

        def text(name: str) -> Column:
            return F.when(kind(name) == "STRING", F.try_variant_get(parsed, f"$.{name}", "string"))

        good = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        return (
            F.when(parsed.isNull(), "not_json")
            .when(~good, "not_an_object")
            .when(lacking != "", F.concat(F.lit("missing:"), lacking))
            .when(~text("command").eqNullSafe(command), "command")
            .when(~text("abi").eqNullSafe(F.lit(ABI)), "abi")
            .when(kind("status") != "STRING", "status")
            .when(~kind("exit_code").isin("BIGINT"), "exit_code")
            .when(~kind("data").startswith("OBJECT"), "data")
            .when(~kind("issues").startswith("ARRAY"), "issues")
        )

    # the lines are split and the JSON is parsed once
    one = let(lines, lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))
    return let(one, lambda line: F.when(line.isNull(), "not_one_line").otherwise(let(F.try_parse_json(line), lambda parsed: judge(line, parsed))))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def adjacent_tail(value: pd.Series, members: pd.Series, lines: pd.Series) -> pd.Series:
    """Indices of the lines that continue a match to its end, or none.

    ``value`` is what must be matched and ``lines`` are a page's (key, x0, y0, x1, y1,
    baseline), texts as their comparison keys; ``members`` are the indices matched so
    far; lines that belong to another place are left out beforehand. The longest member of 16 characters or more with which the value begins is
    continued by the next line below it, of like height and left edge, whose key comes
    next in the value; of several on a baseline the longest. At most 32 lines are taken,
    a bound of the operation. Nulls are empty; the result is empty unless the whole value is covered.
    """

    def follow(wanted: str, own: list[int], page: list[dict]) -> list[int]:
        begun = [i for i in own if len(page[i]["key"] or "") >= 16 and wanted.startswith(page[i]["key"])]
        if not begun:
            return []
        first = last = page[max(begun, key=lambda i: len(page[i]["key"]))]
        height, at, taken = first["y1"] - first["y0"], len(first["key"]), []
        while at < len(wanted) and len(taken) < TAIL_LINES:
            near = [
                i for i, x in enumerate(page)
                if x["x0"] <= first["x1"] + height / 2 and x["x1"] >= first["x0"] - height / 2 and x["y1"] >= last["baseline"] - 2 * height and x["y0"] <= last["baseline"] - 0.3 * height
                and x["baseline"] < last["baseline"] - 0.4 * height
                and abs(x["y1"] - x["y0"] - height) <= 0.2 * height and abs(x["x0"] - first["x0"]) <= 2.5 * height
            ]
            top = max((page[i]["baseline"] for i in near), default=None)
            fits = [i for i in near if top - page[i]["baseline"] <= 0.2 * height and page[i]["key"] and wanted.startswith(page[i]["key"], at)]
            if not fits:
                return []
            best = max(fits, key=lambda i: len(page[i]["key"]))
            taken.append(best)
            last, at = page[best], at + len(page[best]["key"])
        return taken if at == len(wanted) else []

    return pd.Series([follow(v or "", list(m) if m is not None else [], list(p) if p is not None else []) for v, m, p in zip(value, members, lines, strict=True)])
