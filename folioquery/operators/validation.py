"""Checks of results, settings and models: each gives an array of problems or a verdict as a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each focus checks, the dimension of each check and the finding categories it allows.
FOCUS_CHECKS = {
    "grammar": ["grammar"],
    "style": ["style"],
    "logic": ["logic"],
    "consistency": ["consistency"],
    "all": ["grammar", "style", "logic", "consistency"],
}
CHECK_DIMENSION = {"grammar": "grammar-style", "style": "grammar-style", "logic": "logic-consistency", "consistency": "logic-consistency"}
CHECK_CATEGORIES = {"grammar": ["spelling", "grammar"], "style": ["style"], "logic": ["logic"], "consistency": ["consistency"]}
DIMENSION_CATEGORIES = {"reference-coverage": ["omission"], "adjudication": ["fact", "contradiction", "unsupported"]}
OBSERVATION_KINDS = ["term", "entity", "number", "date", "format", "claim"]
SEVERITIES = ["high", "medium", "low"]

ISSUE_SEVERITIES = ["warning", "error"]
OCR_MODES = ["off", "auto", "force"]
QA_CHECKS = ["chunk_seams", "context_rules", "reference_expression", "register_style", "source_residual"]
SCHEMA_VERSION = "3.0"
MOJIBAKE = ["茂驴陆", "脙陇", "芒鈧", "脙漏", "脙篓", "脙鹿", "脙禄"]
# What each dimension is called in a report.
SCOPES_EN = {
    "grammar-style": "grammar and style review",
    "logic-consistency": "logic and consistency review",
    "document-global": "document-wide consistency review",
    "observation-reduce": "cross-chunk observation reduction",
    "claim-extraction": "source claim extraction",
    "passage-index": "reference passage indexing",
    "semantic-routing": "semantic reference routing",
    "grounding": "claim grounding",
    "reference-coverage": "reference coverage and omissions",
    "adjudication": "contradiction and unsupported-claim adjudication",
}
SCOPES_ZH = {
    "grammar-style": "语法与风格",
    "logic-consistency": "逻辑与一致性",
    "document-global": "全文一致性",
    "observation-reduce": "跨段归并",
    "claim-extraction": "主张提取",
    "passage-index": "参考材料索引",
    "semantic-routing": "语义检索",
    "grounding": "主张核验",
    "reference-coverage": "参考材料覆盖与遗漏",
    "adjudication": "矛盾与无依据内容复核",
}

#: Cells of a stage and characters of a payload, at most.
STAGE_CELLS, PAYLOAD_CHARS = 60, 10_000
#: Bytes at the beginning of image files.
MAGIC = {
    "image/png": ["89504E470D0A1A0A"], "image/jpeg": ["FFD8FF"], "image/gif": ["474946383761", "474946383961"], "image/bmp": ["424D"], "image/tiff": ["49492A00", "4D4D002A"],
}
ASSET_BYTES, ALL_ASSET_BYTES = 100 << 20, 512 << 20


def _lookup(values: dict[str, list[str]], key: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    return F.element_at(F.create_map(*pairs), key)


def problems(**checks: Column) -> Column:
    """Array of the names of the checks that fail; a null check fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))


def focus_checks(focus: Column) -> Column:
    """Checks of a focus regardless of case, all for none; null for an unknown one."""
    return _lookup(FOCUS_CHECKS, F.lower(F.coalesce(focus, F.lit("all"))))


def dimensions(checks: Column, has_references: Column | None = None) -> Column:
    """Distinct dimensions of the checks, in their fixed order, and the one of references where there are some."""
    names = F.create_map(*[F.lit(x) for kv in CHECK_DIMENSION.items() for x in kv])
    own = F.array_sort(F.array_compact(F.array_distinct(F.transform(checks, lambda c: F.element_at(names, c)))))
    return own if has_references is None else F.when(has_references, F.array_append(own, F.lit("fact-check"))).otherwise(own)


def allowed_categories(stage: Column, dimension: Column, checks: Column) -> Column:
    """Finding categories that a cell may report: of its checks, or of a reference dimension."""
    by_check = F.array_distinct(F.flatten(F.array_compact(F.transform(checks, lambda c: _lookup(CHECK_CATEGORIES, c)))))
    empty = F.array().cast("array<string>")
    by_dimension = F.coalesce(_lookup(DIMENSION_CATEGORIES, dimension), empty)
    return F.when(stage.isin("local", "global"), F.coalesce(by_check, empty)).when(stage == "reference", by_dimension).otherwise(empty)


def location_problems(start: Column, end: Column) -> Column:
    return problems(start=start >= 1, end=end >= start)


def finding_problems(finding: dict[str, Column], lines: Column, first: Column, last: Column, categories: Column) -> Column:
    """Problems of a finding: bounds, place in its cell's lines, words of the text, category and severity.

    ``finding`` has start, end, original, category, severity. The original must
    be in the lines from start to end, joined by newlines.
    """
    start, end = finding["start"], finding["end"]
    shown = F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")
    return problems(
        bounds=(start >= 1) & (end >= start) & (end <= F.size(lines)),
        outside=(start >= first) & (end <= last),
        verbatim=(F.trim(finding["original"]) != "") & shown.contains(finding["original"]),
        category=F.array_contains(categories, finding["category"]),
        severity=finding["severity"].isNull() | finding["severity"].isin(SEVERITIES),
    )


def binding_problems(expected: dict[str, Column], actual: dict[str, Column]) -> Column:
    """Fields of a result that differ from its task's, nulls equal to nulls."""
    return problems(**{k: v.eqNullSafe(actual[k]) for k, v in expected.items()})


def observation_problems(kinds: Column) -> Column:
    """A message for each observation whose kind isn't a supported one; a missing list is a problem of its own."""
    faults = F.filter(F.transform(kinds, lambda k, i: F.when(~F.coalesce(k.isin(OBSERVATION_KINDS), F.lit(False)), F.concat(F.lit("observations["), i, F.lit("] is not a supported observation")))), lambda m: m.isNotNull())
    return F.coalesce(faults, F.array(F.lit("observations must be a list")))


def partial_problems(same_task: Column, version: Column, attempt: Column, status: Column, required: Column, checks: Column, severities: Column, retries: int = 2) -> Column:
    """What keeps a partial result from being taken: other fields than its task's, version, attempts, status, checks (a map) and issues.

    Checks and issues count only for a task with required checks. Null checks or
    severities are missing ones; a check category that is no required one counts
    like a missing one.
    """
    plain = F.size(required) == 0
    known = F.array_sort(F.map_keys(checks)) == F.array_sort(required)
    passed = F.forall(F.map_values(checks), lambda v: F.coalesce(v == "pass", F.lit(False)))
    rated = F.forall(severities, lambda s: F.coalesce(s.isin(ISSUE_SEVERITIES), F.lit(False)))
    return problems(
        task=same_task,
        schema_version=version == SCHEMA_VERSION,
        attempt=attempt.between(1, retries + 1),
        status=status == "completed",
        check_categories=plain | known,
        check_failed=plain | ~F.coalesce(known, F.lit(False)) | passed,
        issues=plain | severities.isNotNull(),
        issue_severity=plain | severities.isNull() | rated,
        error_reported=plain | severities.isNull() | ~rated | ~F.array_contains(severities, "error"),
    )


def semantic_problems(translation: Column, severities: Column, checks: Column) -> Column:
    """What is wrong with a report on meaning: the hash it is about, its issues, and each of the fixed checks that didn't pass, in order of names."""
    named = [F.when(~F.coalesce(F.element_at(checks, name) == "pass", F.lit(False)), F.lit(f"check:{name}")) for name in QA_CHECKS]
    of_checks = F.when(checks.isNull(), F.array(F.lit("checks"))).otherwise(F.array_compact(F.array(*named)))
    each = F.transform(severities, lambda s: F.when(~F.coalesce(s.isin(ISSUE_SEVERITIES), F.lit(False)), "issue_severity").when(s == "error", "error_reported"))
    of_issues = F.coalesce(F.array_compact(each), F.array(F.lit("issues")))
    return F.concat(problems(translation_sha256=translation.isNotNull()), of_issues, of_checks)


def translator_problems(markdown: Column, audited: Column, audit_chunk: Column, expected_chunk: Column) -> Column:
    """Whether a translator's result has text, an audit (``audited``) and, where the audit names a chunk, the expected one."""
    return problems(
        translated_markdown=F.regexp_replace(markdown, r"(?U)\s+", "") != "",
        self_audit=audited,
        chunk=~F.coalesce(audited, F.lit(False)) | audit_chunk.isNull() | (audit_chunk == expected_chunk),
    )


def passes(checks: Column, severities: Column, required: list[str]) -> Column:
    """Whether all required checks (a map) passed and no issue is an error."""
    good = F.lit(True)
    for name in required:
        good = good & (F.element_at(checks, name) == "pass")
    return F.coalesce(good, F.lit(False)) & ~F.exists(F.coalesce(severities, F.array().cast("array<string>")), lambda s: s == "error")


def exactly_once(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the actual rows are the expected keys, each once: one row of (missing, unknown, duplicate, ok)."""
    from folioquery.operators.terms import set_difference

    states = set_difference(expected, actual, keys)
    counted = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("missing", "unknown", "duplicate")])
    return counted.withColumn("ok", (F.col("missing") == 0) & (F.col("unknown") == 0) & (F.col("duplicate") == 0))


def stage_room(cells: DataFrame, adding: int = 0, keys: tuple[str, ...] = ("stage",)) -> DataFrame:
    """Cells by stage, and whether they are within the limit after ``adding`` more."""
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells")).withColumn("within", F.col("cells") + adding <= STAGE_CELLS)


def within_payload(payload: Column) -> Column:
    return F.length(payload) <= PAYLOAD_CHARS


def collect_results(plan: DataFrame, results: DataFrame, attempts: DataFrame, require_accepted: bool = False) -> DataFrame:
    """Status and errors of each planned cell.

    ``results`` has cell_id, result_hash, findings (their number) and problems (an
    array), ``attempts`` the ledger's cell_id, ledger_status and accepted_hash; both
    have a cell at most once. A cell without result, with problems, or whose
    ledger entry failed or accepted another result, is FAILED; a sound one that the
    ledger hasn't accepted is valid_unaccepted (FAILED if acceptance is required);
    an accepted one is empty or accepted, by whether it has findings.
    """
    joined = plan.select("cell_id").join(results.select("cell_id", "result_hash", "findings", "problems"), "cell_id", "left")
    joined = joined.join(attempts.select("cell_id", "ledger_status", "accepted_hash"), "cell_id", "left")
    known = F.coalesce(F.col("ledger_status"), F.lit(""))
    ledger = (
        F.when(known == "FAILED", "failed_in_ledger")
        .when((known == "accepted") & ~F.col("accepted_hash").eqNullSafe(F.col("result_hash")), "result_changed")
        .when(F.lit(require_accepted) & (known != "accepted"), "not_accepted")
    )
    found = F.coalesce(F.col("problems"), F.array().cast("array<string>"))
    errors = F.when(F.col("result_hash").isNull(), F.array(F.lit("no_result"))).when(F.size(found) > 0, found).otherwise(F.array_compact(F.array(ledger)))
    judged = joined.withColumn("errors", errors)
    status = F.when(F.size("errors") > 0, "FAILED").when(known != "accepted", "valid_unaccepted").when(F.coalesce("findings", F.lit(0)) == 0, "empty").otherwise("accepted")
    return judged.select("cell_id", status.alias("status"), "errors")


def uncovered(cells: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What a run leaves open: required cells that aren't accepted, and claims without a verdict."""
    open_ = cells.where(F.col("required") & (F.col("status") != "accepted")).select(F.lit("cell").alias("kind"), F.col("cell_id").cast("string").alias("id"))
    return open_.unionByName(verdicts.where("verdict = 'unverified'").select(F.lit("claim").alias("kind"), F.col("claim_id").cast("string").alias("id")))


def scope_label(dimension: Column, lines: Column, language: str = "en") -> Column:
    """What a cell was to cover, in a reader's words; unknown dimensions stay as they are, missing ones are a review."""
    names = SCOPES_ZH if language == "zh" else SCOPES_EN
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), dimension), dimension, F.lit("review"))
    before, after = ("（第 ", " 行）") if language == "zh" else (" (lines ", ")")
    return F.when(F.coalesce(lines, F.lit("")) == "", known).otherwise(F.concat(known, F.lit(before), lines, F.lit(after)))


def uncovered_scopes(cells: DataFrame, run: str, order: str, language: str = "en") -> DataFrame:
    """(run, scope): the distinct labels of a run's open cells (dimension, lines), in order of their first one.

    Labels are made distinct before a run's are brought together: a run has as
    many as it has dimensions and line ranges.
    """
    label = scope_label(F.col("dimension"), F.col("lines"), language)
    first = cells.groupBy(run, label.alias("label")).agg(F.min(order).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "label")))
    return first.groupBy(run).agg(F.array_join(F.transform(ordered, lambda x: x["label"]), "、" if language == "zh" else "; ").alias("scope"))


def split_cell(cells: DataFrame, items: str) -> DataFrame:
    """(cell_id, items, parent, problem): each cell as two halves of its items, ``.a`` the shorter and ``.b``.

    A cell of less than two items can't be split: it stays, without parent, with a problem.
    """
    half = F.floor(F.size(items) / 2).cast("int")
    parent = F.col("cell_id").alias("parent")
    none = F.lit(None).cast("string")
    both = F.array(
        F.struct(F.concat("cell_id", F.lit(".a")).alias("cell_id"), F.slice(items, F.lit(1), half).alias(items), parent, none.alias("problem")),
        F.struct(F.concat("cell_id", F.lit(".b")).alias("cell_id"), F.slice(items, half + 1, F.size(items) - half).alias(items), parent, none.alias("problem")),
    )
    one = F.array(F.struct(F.col("cell_id"), F.col(items), none.alias("parent"), F.lit("indivisible").alias("problem")))
    return cells.select(F.explode(F.when(F.coalesce(F.size(items), F.lit(0)) > 1, both).otherwise(one)).alias("c")).select("c.*")


def dependency_hash(own: Column, dependencies: Column) -> Column:
    """Hash of a cell's input hash and of its dependencies (an array of (id, hash)) in order of their ids, as JSON with sorted keys."""
    from folioquery.operators.structure import json_escaped

    def quoted(text: Column) -> Column:
        return F.coalesce(F.concat(F.lit('"'), json_escaped(text), F.lit('"')), F.lit("null"))

    each = F.transform(F.array_sort(dependencies), lambda d: F.concat(F.lit("["), quoted(d["id"]), F.lit(","), quoted(d["hash"]), F.lit("]")))
    return F.sha2(F.concat(F.lit('{"dependencies":['), F.array_join(each, ","), F.lit('],"input_hash":'), quoted(own), F.lit("}")), 256)


def magic_matches(media_type: Column, content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    webp = (F.hex(F.substring(content, 1, 4)) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    out = F.when(media_type == "image/webp", webp)
    for name, magics in MAGIC.items():
        fits = head.startswith(magics[0])
        for magic in magics[1:]:
            fits = fits | head.startswith(magic)
        out = out.when(F.lower(media_type) == name, fits)
    return out.otherwise(F.lit(False))


def asset_problem(media_type: Column, content: Column) -> Column:
    """Why an asset isn't exported, or null."""
    return (
        F.when(~media_type.startswith("image/"), "not_an_image")
        .when(~media_type.isin(*MAGIC, "image/webp"), "unsupported")
        .when(F.length(content) > ASSET_BYTES, "too_large")
        .when(~magic_matches(media_type, content), "magic_mismatch")
    )


def target_action(target: Column, source: Column, exists: Column, overwrite: Column, rename: Column, bundle: Column | None = None) -> Column:
    """What to do with a target path: refuse the source itself and, for a bundle, a folder that holds it; else write, rename, overwrite or report a collision.

    A source with a scheme is no local path and never refused.
    """
    local = ~source.rlike("^[A-Za-z][A-Za-z0-9+.-]*://")
    holds = F.coalesce(bundle, F.lit(False)) & is_within(source, target) if bundle is not None else F.lit(False)
    return F.when(local & ((target == source) | holds), "refuse").when(~exists, "write").when(rename, "rename").when(overwrite, "overwrite").otherwise("collision")


def is_within(child: Column, parent: Column) -> Column:
    """Whether a normalised path is a folder or lies in it."""
    base = F.regexp_replace(parent, "/+$", "")
    return (F.regexp_replace(child, "/+$", "") == base) | child.startswith(F.concat(base, F.lit("/")))


def readable(text: Column, signature: Column, reason: Column) -> Column:
    """Whether repaired text of a page that was suspected to be garbled is usable.

    ``signature`` is its visible signature, of 32 characters or more; replacement,
    control and private-use characters and signs of a wrong decoding rule it out.
    """
    wrong = F.lit(False)
    for mark in MOJIBAKE:
        wrong = wrong | text.contains(mark)
    clean = ~text.rlike(r"[\x{FFFD}\x{FFFE}\x{E000}-\x{F8FF}\x00-\x08\x0B\x0C\x0E-\x1F]")
    return F.coalesce((F.trim(reason) == "suspected_garbled_text") & ~wrong & (F.length(signature) >= 32) & clean, F.lit(False))


def result_file(cell_id: Column) -> Column:
    return F.concat(F.regexp_replace(cell_id, "[^A-Za-z0-9._-]+", "__"), F.lit(".json"))


def safe_stem(name: Column) -> Column:
    """A name without its extension (leading dots begin none), as letters, digits, dots, dashes and underscores."""
    stem = F.regexp_replace(name, r"(?s)(?<=[^.])\.[^.]*$", "")
    cleaned = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("reference"))


def relationship_part(part: Column) -> Column:
    return F.regexp_replace(part, "^(.*/)?([^/]+)$", "$1_rels/$2.rels")


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def render_scale(dpi: Column, most_edge: Column, width: Column, height: Column) -> Column:
    """Pixels a point of a page of that size, the longer edge within ``most_edge``; null for a page without a size."""
    scale = F.least(dpi / 72.0, most_edge / F.greatest(width, height))
    return F.when(_finite(width) & _finite(height) & (width > 0) & (height > 0), scale)


def page_polygon(points: Column, scale: Column) -> Column:
    """Four points (x, y) in whole pixels as page coordinates, to three places; null for anything else."""
    pixels = F.transform(points, lambda p: F.transform(p, lambda v: F.bround(v, 0)))
    moved = F.transform(pixels, lambda p: F.transform(p, lambda v: F.round(v / scale, 3)))
    sound = (F.size(points) == 4) & F.forall(points, lambda p: (F.size(p) == 2) & F.forall(p, _finite))
    return F.when(F.coalesce(sound, F.lit(False)), moved)


def text_fields(raw: Column, text: Column, converted: Column | None = None) -> Column:
    """raw, cleaned and normalised text: the cleaned one is the raw one where there is none, the normalised one the cleaned one unless it was converted."""
    cleaned = F.coalesce(text, raw)
    return F.struct(raw.alias("raw_text"), cleaned.alias("text"), (cleaned if converted is None else F.coalesce(converted, cleaned)).alias("normalized_text"))


def drop_nulls(values: Column) -> Column:
    return F.map_filter(values, lambda _, v: v.isNotNull())


def usable_settings(mode: Column, engine: Column, language: Column, dpi: Column, most_edge: Column, confidence: Column) -> Column:
    """Names of the settings of a recognition run that are out of bounds; the edge must be a whole number."""
    return problems(
        mode=F.lower(F.trim(mode)).isin(OCR_MODES),
        engine=F.trim(engine) != "",
        language=F.trim(language) != "",
        dpi=_finite(dpi) & dpi.between(1, 1200),
        edge=(most_edge == F.floor(most_edge)) & most_edge.between(1, 65535),
        confidence=_finite(confidence) & confidence.between(0.0, 1.0),
    )


def enrich_images(nodes: DataFrame, recognised: DataFrame, most_assets: int = 100) -> DataFrame:
    """Nodes (doc_id, ordinal, type, asset_id, text) with a paragraph of recognised text after each image.

    Only the first ``most_assets`` distinct assets of a document are enriched, in
    reading order; that limit is part of the operation. Ordinals are dealt anew.
    """
    from pyspark.sql import Window

    seen = nodes.where("type = 'image'").groupBy("doc_id", "asset_id").agg(F.min("ordinal").alias("_at"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at"))
    texts = seen.withColumn("_k", rank).where(F.col("_k") <= most_assets).join(recognised, "asset_id").select("doc_id", "asset_id", F.col("text").alias("_found"))
    joined = nodes.join(texts, ["doc_id", "asset_id"], "left")
    own = F.struct(F.col("type"), F.col("asset_id"), F.col("text"))
    extra = F.struct(F.lit("paragraph").alias("type"), F.col("asset_id"), F.col("_found").alias("text"))
    both = F.when(F.col("type").eqNullSafe("image") & F.col("_found").isNotNull(), F.array(own, extra)).otherwise(F.array(own))
    each = joined.select("doc_id", F.col("ordinal").alias("_from"), F.posexplode(both).alias("_part", "n"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("_from", "_part")) - 1
    return each.select("doc_id", place.alias("ordinal"), "n.*")


def merge_shards(assets: DataFrame, warnings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets (shard, part, sha256) once for each part and content with a new number, and warnings (shard, code, message) once."""
    from pyspark.sql import Window

    first = assets.groupBy("doc_id", "part", "sha256").agg(F.min("shard").alias("shard"))
    numbered = first.withColumn("asset", F.row_number().over(Window.partitionBy("doc_id").orderBy("shard", "part", "sha256")))
    return numbered, warnings.groupBy("doc_id", "code", "message").agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("times"))
