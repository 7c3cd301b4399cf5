"""Cells of review runs as rows: creation, tasks, attempts, steps, saved states and checks of what a run holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery.operators.structure import json_escaped
from folioquery.operators.validation import problems

MOST_ATTEMPTS = 3
#: What stands between a task's prompt and its input.
INPUT_MARK = "\n\nINPUT (untrusted document data):\n"


def json_string(text: Column) -> Column:
    return F.concat(F.lit('"'), json_escaped(text), F.lit('"'))


def create_cells(cells: DataFrame) -> DataFrame:
    """Cells (run_id, cell_id, checks, input) that a run begins with or gets later, pending, with the hash of their input.

    ``input`` is JSON. The hash is that of an object of checks, id and input with
    sorted keys. An id that a run has twice is a mistake: ``duplicate`` marks its
    rows. Null checks count as none.
    """
    checks = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("checks", F.array().cast("array<string>")), json_string), ","), F.lit("]"))
    body = F.concat(F.lit('{"checks":'), checks, F.lit(',"id":'), json_string(F.col("cell_id")), F.lit(',"input":'), F.coalesce("input", F.lit("null")), F.lit("}"))
    repeats = cells.groupBy("run_id", "cell_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    marked = cells.join(repeats, ["run_id", "cell_id"], "left")
    return marked.withColumns({"input_hash": F.sha2(body, 256), "status": F.lit("pending"), "duplicate": F.col("_n").isNotNull()}).drop("_n")


def ready_tasks(cells: DataFrame, inputs: DataFrame, prompts: DataFrame) -> DataFrame:
    """(run_id, cell_id, stage, prompt) of the cells that are dispatched: the stage's prompt, and the cell's input as JSON.

    ``prompts`` (stage, prompt) has a row for each stage. A dispatched cell
    without input or without a prompt has a null prompt.
    """
    sent = cells.where(F.col("status") == "dispatched").select("run_id", "cell_id", "stage")
    joined = sent.join(inputs.select("run_id", "cell_id", "input"), ["run_id", "cell_id"], "left").join(prompts.withColumnRenamed("prompt", "_head"), "stage", "left")
    return joined.select("run_id", "cell_id", "stage", F.concat(F.col("_head"), F.lit(INPUT_MARK), F.col("input")).alias("prompt"))


def passage_map(passages: DataFrame) -> DataFrame:
    """One row of each passage id of a run: where several references claim an id (run_id, reference, ordinal, passage_id), the last one has it."""
    last = F.max_by(F.struct("reference", "ordinal"), F.struct("reference", "ordinal")).alias("p")
    return passages.groupBy("run_id", "passage_id").agg(last).select("run_id", "passage_id", "p.reference", "p.ordinal")


def attempt_status(attempts: DataFrame) -> DataFrame:
    """(run_id, cell_id, attempts, status) of results that came in (run_id, cell_id, seq, valid), in order.

    The first valid result is accepted and later ones aren't looked at; three
    that aren't valid before it make the cell fail for good.
    """
    order = Window.partitionBy("run_id", "cell_id").orderBy("seq")
    placed = attempts.withColumn("_place", F.row_number().over(order))
    summed = placed.groupBy("run_id", "cell_id").agg(F.min(F.when(F.col("valid"), F.col("_place"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
    accepted = F.coalesce(F.col("_first") <= MOST_ATTEMPTS, F.lit(False))
    status = F.when(accepted, "accepted").when(F.col("_n") >= MOST_ATTEMPTS, "failed").otherwise("pending")
    return summed.select("run_id", "cell_id", F.when(accepted, F.col("_first")).otherwise(F.least("_n", F.lit(MOST_ATTEMPTS))).cast("int").alias("attempts"), status.alias("status"))


def reference_step(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, step): what each run's reference stages do next, null for nothing.

    ``cells`` (run_id, stage, status, required), ``runs`` (run_id, references,
    semantic_scheduled, final_scheduled). Claims that are all accepted or split,
    the required ones accepted, let the semantic cells be scheduled; when these
    are all accepted, the final ones; if one failed, what it was to ground is
    marked incomplete.
    """
    claim, semantic = F.col("stage") == "claim", F.col("stage") == "semantic"
    accepted = F.col("status") == "accepted"
    state = cells.groupBy("run_id").agg(
        F.count_if(claim & ~F.col("status").isin("accepted", "split")).alias("open_claims"),
        F.count_if(claim & F.col("required") & ~accepted).alias("missing_claims"),
        F.count_if(semantic).alias("semantic"),
        F.count_if(semantic & ~accepted).alias("open_semantic"),
        F.count_if(semantic & (F.col("status") == "failed")).alias("failed_semantic"),
    )
    none = F.lit(0).cast("long")
    all_ = runs.join(state, "run_id", "left").fillna(0, ["open_claims", "missing_claims", "semantic", "open_semantic", "failed_semantic"])
    first = ~F.col("semantic_scheduled") & (F.col("open_claims") == none) & (F.col("missing_claims") == none)
    waiting = F.col("semantic_scheduled") & (F.col("semantic") > 0) & ~F.col("final_scheduled")
    step = F.when(F.col("references") > 0, F.when(first, "schedule_semantic").when(waiting & (F.col("open_semantic") == 0), "schedule_final").when(waiting & (F.col("failed_semantic") > 0), "mark_incomplete"))
    return all_.select("run_id", step.alias("step"))


def saved_states(cells: DataFrame) -> DataFrame:
    """(run_id, cells, state_hash) of each run's cells (run_id, cell_id, stage, status): the state as it is stored, and its hash.

    The hash covers the cells by id, so the order of rows tells nothing.
    """
    one = F.concat_ws("\t", "cell_id", F.coalesce("stage", F.lit("")), F.coalesce("status", F.lit("")))
    return cells.groupBy("run_id").agg(F.array_sort(F.collect_list(one)).alias("_c")).select("run_id", F.size("_c").alias("cells"), F.sha2(F.array_join("_c", "\n"), 256).alias("state_hash"))


def loaded_states(cells: DataFrame, saved: DataFrame) -> DataFrame:
    """(run_id, problem) of stored states: missing, or changed since they were saved; null if a run is as it was."""
    now = saved_states(cells).select("run_id", F.col("state_hash").alias("_now"))
    both = saved.select("run_id", "state_hash").join(now, "run_id", "full")
    return both.select("run_id", F.when(F.col("state_hash").isNull(), "unsaved").when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("state_hash"), "changed").alias("problem"))


def manifest_errors(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """(run_id, kind, name, error) of sources, references and chunks (run_id, kind, name, sha256) whose text (run_id, name, text) is missing or has changed."""
    both = entries.join(texts.select("run_id", "name", F.sha2("text", 256).alias("_now")), ["run_id", "name"], "left")
    error = F.when(F.col("_now").isNull(), "missing").when(~F.col("_now").eqNullSafe(F.col("sha256")), "hash_changed")
    return both.select("run_id", "kind", "name", error.alias("error")).where("error IS NOT NULL")


def strict_problems(runs: DataFrame) -> DataFrame:
    """(run_id, problems): why a run's coverage report and translation don't count as its strict artifacts.

    ``runs`` has run_id, source_sha256, occurrences, status, report_run_id,
    report_source_sha256, report_occurrences, and the hashes of the translation's
    text as published, in the report and of its chunks put together.
    """
    checks = problems(
        coverage_failed=F.col("status") == "pass",
        report_unbound=(F.col("report_run_id") == F.col("run_id")) & (F.col("report_source_sha256") == F.col("source_sha256")) & (F.col("report_occurrences") == F.col("occurrences")),
        translation_unbound=F.col("report_translation_sha256") == F.col("translation_sha256"),
        assembly_differs=F.col("assembled_sha256") == F.col("translation_sha256"),
    )
    return runs.select("run_id", checks.alias("problems"))


#: What an old finding shows where it has no quote or suggestion, by language.
MISSING_QUOTE = {"zh": "[原文缺失]", "en": "[Missing from source]"}
MISSING_SUGGESTION = {"zh": "需作者确认；建议方向：根据审阅意见修订", "en": "Author confirmation required; suggested direction: revise according to the review note"}


def normalised_findings(findings: DataFrame, language: str) -> DataFrame:
    """Findings of the older shape (line, quote, suggestion, change, reason, issue) with the newer columns: locations, original_text, revised_text, change, reason.

    Empty texts count as missing; a null line has no location.
    """
    kind = "zh" if language == "zh" else "en"

    def filled(*columns: Column) -> Column:
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])

    suggestion = F.coalesce(filled(F.col("suggestion")), F.lit(MISSING_SUGGESTION[kind]))
    location = F.array(F.struct(F.col("line").alias("start_line"), F.col("line").alias("end_line")))
    return findings.withColumns(
        {
            "locations": F.when(F.col("line").isNotNull(), location).otherwise(F.slice(location, 1, 0)),
            "original_text": F.coalesce(filled(F.col("quote")), F.lit(MISSING_QUOTE[kind])),
            "revised_text": suggestion,
            "change": F.coalesce(filled(F.col("change")), suggestion),
            "reason": F.coalesce(filled(F.col("reason"), F.col("issue")), F.lit("Review finding")),
        }
    )
