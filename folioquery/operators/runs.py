"""Stage state of runs, content-addressed caches and artifact checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def invalidate_downstream(stages: DataFrame, changed: DataFrame) -> DataFrame:
    """Stages (run_id, stage, ord, state) after a change: of each run, the changed stage (run_id, ord) and all later ones are pending."""
    first = changed.groupBy("run_id").agg(F.min("ord").alias("_from"))
    joined = stages.join(first, "run_id", "left")
    return joined.withColumn("state", F.when(F.col("ord") >= F.col("_from"), "pending").otherwise(F.col("state"))).drop("_from")


def resume_points(stages: DataFrame) -> DataFrame:
    """The first stage of each run that isn't completed; runs that are done have none."""
    open_ = stages.where(F.col("state") != "completed")
    return open_.groupBy("run_id").agg(F.min_by("stage", "ord").alias("stage"), F.min("ord").alias("ord"))


def strictly_ready(stages: DataFrame, required: list[str], artifacts: DataFrame) -> DataFrame:
    """Runs all of whose required stages are completed with every artifact verified (run_id, stage, expected, actual)."""
    done = stages.where(F.col("stage").isin(required)).groupBy("run_id").agg(
        F.countDistinct(F.when(F.col("state") == "completed", F.col("stage"))).alias("done")
    )
    bad = artifacts.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("run_id").distinct()
    return done.where(F.col("done") == len(required)).join(bad, "run_id", "left_anti").select("run_id")


def input_hashes(artifacts: DataFrame) -> DataFrame:
    """Hash of all artifacts (run_id, ord, name, sha256) of the stages before each stage of a run."""
    stage = artifacts.groupBy("run_id", "ord").agg(F.array_sort(F.collect_list(F.concat_ws("=", "name", "sha256"))).alias("own"))
    before = Window.partitionBy("run_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    upstream = F.flatten(F.collect_list("own").over(before))
    return stage.select("run_id", "ord", F.sha2(F.array_join(upstream, ";"), 256).alias("input_hash"))


def publish(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries (key, seq, value) that go into a content-addressed cache: those without a cached key, of equal keys the first."""
    fresh = entries.join(cache.select("key"), "key", "left_anti")
    return fresh.groupBy("key").agg(F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value"))


def free_name(stems: DataFrame, taken: DataFrame) -> DataFrame:
    """The first of ``stem``, ``stem_1``, ... up to 9999 that isn't taken (name)."""
    used = taken.select(F.regexp_replace("name", r"_\d+$", "").alias("stem"), "name").unionByName(taken.select(F.col("name").alias("stem"), "name")).distinct()
    counts = used.groupBy("stem").agg(F.collect_set("name").alias("used"))
    # a stem with u used names has a free one among its first u + 1
    each = stems.select("stem").distinct().join(counts, "stem", "left").withColumn("used", F.coalesce("used", F.array().cast("array<string>")))
    candidates = F.transform(
        F.sequence(F.lit(0), F.least(F.size("used"), F.lit(9999))), lambda k: F.when(k == 0, F.col("stem")).otherwise(F.concat(F.col("stem"), F.lit("_"), k))
    )
    return each.select("stem", F.get(F.filter(candidates, lambda c: ~F.array_contains(F.col("used"), c)), F.lit(0)).alias("name"))
