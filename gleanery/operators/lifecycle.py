"""Life cycle of state rows: what to run, where to resume, and how a run changes them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import filled
from gleanery.operators.attempts import backoff_until, failure_reason
from gleanery.operators.registry import last_per_key
from gleanery.policy import FAILED_STATUSES, TERMINAL_STATUSES, Policy

# Step, status while it runs, last completed stage after it.
STEPS = (
    ("download", "downloading", "downloaded"),
    ("capture", "downloading", "transcribed"),
    ("transcribe", "transcribing", "transcribed"),
    ("enrich", "enriching", "enriched"),
    ("write_note", "writing_note", "note_written"),
)


@dataclass(frozen=True)
class Failures:
    """Updated state rows of failed items and their attention lines."""

    rows: DataFrame
    attention: DataFrame


def _at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp")


def actionable_items(state: DataFrame, as_of: datetime) -> DataFrame:
    """Rows a run should pick up: not terminal, and not waiting out a backoff."""
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= _at(as_of))
    return state.filter(~F.col("status").isin(*TERMINAL_STATUSES) & due)


def plan_resume(
    items: DataFrame, captures: DataFrame, enrichments: DataFrame, media: DataFrame
) -> DataFrame:
    """Add ``resume_at``: the first step whose result is not both recorded and present.

    The three tables only have to hold a ``content_id`` per artifact that is really there.
    """
    plan = items
    for name, table in (("_captured", captures), ("_enriched", enrichments), ("_media", media)):
        present = table.select("content_id").distinct().withColumn(name, F.lit(True))
        plan = plan.join(present, "content_id", "left")
    stage = F.coalesce("last_completed_stage", F.lit(""))
    captured, enriched = F.col("_captured").isNotNull(), F.col("_enriched").isNotNull()
    step = (
        F.when((stage == "enriched") & captured & enriched, "write_note")
        .when(stage.isin("transcribed", "enriched") & captured, "enrich")
        .when(F.col("content_kind") == "text", "capture")
        .when(
            stage.isin("downloaded", "transcribed", "enriched") & F.col("_media").isNotNull(),
            "transcribe",
        )
        .otherwise("download")
    )
    return plan.withColumn("resume_at", step).drop("_captured", "_enriched", "_media")


def advance_stage(state: DataFrame, steps: DataFrame, as_of: datetime) -> DataFrame:
    """Changed rows for ``steps`` (content_id, step, finished).

    A started step sets the working status; a finished one also the durable stage.
    """
    step, status, stage = F.col("step"), F.col("status"), F.col("last_completed_stage")
    for name, running, finished in STEPS:
        status = F.when(step == name, running).otherwise(status)
        stage = F.when((step == name) & F.col("finished"), finished).otherwise(stage)
    done = (step == "write_note") & F.col("finished")
    changed = state.join(steps, "content_id")
    return changed.withColumns(
        {
            "status": F.when(done, "done").otherwise(status),
            "last_completed_stage": stage,
            "updated_at": _at(as_of),
        }
    ).select(*state.columns)


def apply_failures(
    state: DataFrame, failures: DataFrame, policy: Policy, as_of: datetime
) -> Failures:
    """Changed rows and attention lines for ``failures`` (content_id, message, error_repr).

    ``error_repr`` names the error type; it stands in when the message is blank. Several
    failures of one item in a run are one attempt, told by the last of them in text order.
    """
    attempts = (F.col("attempt_count") + 1).cast("int")
    permanent = attempts >= policy.max_attempts
    error = F.coalesce(F.nullif("message", F.lit("")), F.col("error_repr"), F.lit("Exception()"))
    single = last_per_key(failures.select("content_id", "message", "error_repr"))
    failed = state.join(single, "content_id").withColumns(
        {
            "_before": F.col("error"),
            "error": error,
            "attempt_count": attempts,
            "status": F.when(permanent, "failed_permanent").otherwise("failed"),
            "next_retry_at": F.when(~permanent, backoff_until(_at(as_of), attempts, policy)),
            "updated_at": _at(as_of),
        }
    )
    told = (F.col("status") == "failed_permanent") | ~F.col("error").eqNullSafe(F.col("_before"))
    reason = failure_reason(F.col("status"), F.col("attempt_count"), F.col("error"))
    attention = failed.filter(told).select(_at(as_of).alias("ts"), "url", reason.alias("reason"))
    return Failures(failed.select(*state.columns), attention)


def apply_success(
    state: DataFrame, notes: DataFrame, skills: DataFrame, as_of: datetime
) -> DataFrame:
    """Changed rows of items whose note is written.

    ``notes`` is (content_id, note_path); ``skills`` is (content_id, skill_path, skill_error),
    where a failed skill leaves the item done.
    """
    outcome = notes.select("content_id", F.col("note_path").alias("_note")).join(
        skills.select(
            "content_id", F.col("skill_path").alias("_skill"), F.col("skill_error").alias("_error")
        ),
        "content_id",
        "left",
    )
    nothing = F.lit(None).cast("string")
    failed_skill = F.col("_error").isNotNull()
    return (
        state.join(outcome, "content_id")
        .withColumns(
            {
                "status": F.lit("done"),
                "note_path": F.col("_note"),
                "skill_path": F.when(~failed_skill, F.col("_skill")),
                "skill_error": F.col("_error"),
                "error": nothing,
                "attempt_count": F.lit(0),
                "next_retry_at": F.lit(None).cast("timestamp"),
                "last_completed_stage": F.lit("note_written"),
                "updated_at": _at(as_of),
            }
        )
        .select(*state.columns)
    )


def reset_for_retry(state: DataFrame, ids: DataFrame | None, as_of: datetime) -> DataFrame:
    """Changed rows of a manual retry: permanently failed items only, all of them or ``ids``."""
    targets = state.filter(F.col("status") == "failed_permanent")
    if ids is not None:
        targets = targets.join(ids.select("content_id").distinct(), "content_id", "left_semi")
    return targets.withColumns(
        {
            "status": F.lit("pending"),
            "attempt_count": F.lit(0),
            "next_retry_at": F.lit(None).cast("timestamp"),
            "error": F.lit(None).cast("string"),
            "updated_at": _at(as_of),
        }
    )


def stale_outputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (note) and folders (skill) of an earlier run that the later state no longer names."""
    old = before.select(
        "content_id", F.col("note_path").alias("_note"), F.col("skill_path").alias("_skill")
    )
    new = after.select("content_id", "note_path", "skill_path")
    both = old.join(new, "content_id")
    note_gone = filled(F.col("_note")) & ~F.col("_note").eqNullSafe(F.col("note_path"))
    skill_gone = filled(F.col("_skill")) & ~F.col("_skill").eqNullSafe(F.col("skill_path"))
    folder = F.regexp_replace("_skill", r"/[^/]*\z", "")
    plans = F.array_compact(
        F.array(
            F.when(note_gone, F.struct(F.lit("note").alias("kind"), F.col("_note").alias("path"))),
            F.when(skill_gone, F.struct(F.lit("skill").alias("kind"), folder.alias("path"))),
        )
    )
    return both.select("content_id", F.explode(plans).alias("p")).select("content_id", "p.*")


def orphan_artifacts(
    artifacts: DataFrame, as_of: datetime, days: int, state: DataFrame | None = None
) -> DataFrame:
    """Artifacts (content_id, path, modified_at) past retention, whatever their item's status."""
    if days <= 0:
        return artifacts.filter(F.lit(False))
    old = artifacts.filter(F.col("modified_at") < _at(as_of - timedelta(days=days)))
    if state is None:
        return old
    return old.join(state.select("content_id", "status"), "content_id", "left")


def prune_attention(attention: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Attention rows within retention; rows without a readable time are kept."""
    if days <= 0:
        return attention
    cutoff = _at(as_of - timedelta(days=days))
    return attention.filter(F.col("ts").isNull() | (F.col("ts") >= cutoff))


def pruned_count(attention: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """How many rows ``prune_attention`` takes away."""
    if days <= 0:
        return attention.agg(F.lit(0).cast("long").alias("removed"))
    cutoff = _at(as_of - timedelta(days=days))
    return attention.agg(F.count_if(F.col("ts") < cutoff).alias("removed"))


def state_health(state: DataFrame) -> DataFrame:
    """One row: backlog, failures and the last success."""
    status = F.col("status")
    return state.agg(
        F.lit("ok").alias("status"),
        F.count_if(~status.isin(*TERMINAL_STATUSES)).alias("queue_depth"),
        F.count_if(status.isin(*FAILED_STATUSES)).alias("failed_count"),
        F.max(F.when(status == "done", F.col("updated_at"))).alias("last_success_at"),
    )


def status_changes(before: DataFrame, changed: DataFrame) -> DataFrame:
    """Feed rows (content_id, old_status, new_status, changed_at) of changed state rows; a key that
    was not there has no old status."""
    old = before.select("content_id", F.col("status").alias("old_status"))
    return changed.join(old, "content_id", "left").select(
        "content_id", "old_status", F.col("status").alias("new_status"), F.col("updated_at").alias("changed_at")
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row of counters over the rows a run processed."""
    done = F.col("status") == "done"
    return results.agg(
        F.count("*").alias("processed"),
        F.count_if(done).alias("done"),
        F.count_if(~done).alias("failed"),
        F.count_if(done & filled(F.col("note_path"))).alias("notes"),
        F.count_if(done & filled(F.col("skill_path"))).alias("skills"),
        F.count_if(~done & filled(F.col("error"))).alias("errors"),
    )


def run_outputs(results: DataFrame) -> DataFrame:
    """The lists of a run as rows (content_id, kind, value): notes, skills and errors.

    A list per run would be one row holding the whole run; rows stay spread out.
    """
    done = F.col("status") == "done"
    error = F.concat(F.col("content_id"), F.lit(": "), F.col("error"))

    def entry(kind: str, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), value.alias("value")))

    entries = F.array_compact(
        F.array(
            entry("note", done & filled(F.col("note_path")), F.col("note_path")),
            entry("skill", done & filled(F.col("skill_path")), F.col("skill_path")),
            entry("error", ~done & filled(F.col("error")), error),
        )
    )
    return results.select("content_id", F.explode(entries).alias("e")).select("content_id", "e.*")


def state_size_check(state: DataFrame, threshold: int) -> DataFrame:
    """One row: item count and whether it has reached the warning threshold."""
    large = F.lit(False) if threshold <= 0 else F.count("*") >= threshold
    return state.agg(
        F.count("*").alias("item_count"),
        F.lit(threshold).alias("threshold"),
        large.alias("warn"),
    )
