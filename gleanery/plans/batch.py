"""The whole batch: register, capture, enrich, publish, and bring the state up to date."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.answers import (
    BatchFunction,
    apply_model,
    parse_enrichments,
    render_prompts,
    render_skill_prompts,
)
from gleanery.operators.blocks import flatten_block_trees, parse_block_map
from gleanery.operators.captures import (
    classify_fetch_outcome,
    decode_documents,
    dispatch_sources,
    extract_main_text,
    gate_captures,
    merge_captures,
    route_captures,
)
from gleanery.operators.lifecycle import (
    actionable_items,
    advance_stage,
    apply_failures,
    apply_success,
    orphan_artifacts,
    plan_resume,
    prune_attention,
    run_outputs,
    run_summary,
    stale_outputs,
)
from gleanery.operators.media import combine_clips
from gleanery.operators.publish import assign_note_names, render_notes, skill_candidates
from gleanery.operators.registry import register_urls, upsert_state
from gleanery.operators.repos import assemble_repo_captures
from gleanery.operators.urls import extract_source_refs
from gleanery.plans.media import capture_media
from gleanery.policy import Policy


@dataclass(frozen=True)
class Models:
    """Factories of the user's batch functions: prompt rows in, a ``text`` column out.

    ``describe`` gets picture posts and ``transcribe`` files with sound, see ``capture_media``.
    """

    enrich: Callable[[], BatchFunction]
    skill: Callable[[], BatchFunction] | None = None
    describe: Callable[[], BatchFunction] | None = None
    transcribe: Callable[[], BatchFunction] | None = None


@dataclass(frozen=True)
class Fetched:
    """What fetchers brought beside plain pages, each keyed by content_id; any may be absent.

    ``rendered`` (html) holds pages run in a browser, ``repo_meta`` and ``repo_contents``
    (payload) the two answers about a repository, ``blocks`` (payload) block maps, ``files``
    (body) downloads, ``clips`` (clip_no, text, language, backend, duration_seconds) the
    transcripts of an item's clips, ``outcomes`` (source_type, status, headers) how each
    fetch went, ``media`` (path, has_audio, frame_path) files of items without a transcript. Items
    of a source without a table are read as plain pages.
    """

    rendered: DataFrame | None = None
    repo_meta: DataFrame | None = None
    repo_contents: DataFrame | None = None
    blocks: DataFrame | None = None
    files: DataFrame | None = None
    clips: DataFrame | None = None
    outcomes: DataFrame | None = None
    media: DataFrame | None = None


@dataclass(frozen=True)
class BatchResult:
    state: DataFrame
    notes: DataFrame
    skills: DataFrame
    attention: DataFrame
    outputs: DataFrame
    summary: DataFrame


def run_batch(
    submissions: DataFrame,
    state: DataFrame,
    responses: DataFrame,
    transcripts: DataFrame,
    notes_on_disk: DataFrame,
    models: Models,
    prompts: dict[str, str],
    policy: Policy,
    as_of: datetime,
    folder: str,
    earlier_captures: DataFrame | None = None,
    earlier_enrichments: DataFrame | None = None,
    fetched: Fetched | None = None,
    on_stage: Callable[[DataFrame], object] | None = None,
) -> BatchResult:
    """One pass over everything due.

    ``responses`` is (content_id, html) for text items, ``transcripts`` is (content_id, text)
    for media items, and ``fetched`` holds what other sources gave; a due item without any of
    these fails and is retried later. Of several rows for an item the largest text counts. Captures
    (content_id, text) and enrichments (content_id and the record's fields) of an earlier
    run are used again where the state says that step was completed. Every stage is a
    table under ``folder``: a stage is computed once, and a lost executor costs only the
    stage it was in. ``on_stage`` is given the state rows that a finished stage changes, e.g. to
    write them with ``write_state_changes``; a run that is lost later is then resumed behind it.
    """
    spark = state.sparkSession

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    registered = register_urls(submissions, state, policy, as_of)
    added = stage(registered.rows, "registered")
    known = state.unionByName(added)
    refused = added.filter("status = 'blocked'").select(
        F.col("added_at").alias("ts"), "url", F.coalesce("error", F.lit("validation failed")).alias("reason")
    )
    nothing = transcripts.select("content_id", "text").limit(0)
    old_captures = nothing if earlier_captures is None else earlier_captures
    old_records = nothing if earlier_enrichments is None else earlier_enrichments
    given = fetched or Fetched()
    there = transcripts.select("content_id")
    if given.media is not None:
        there = there.unionByName(given.media.select("content_id"))
    due = stage(plan_resume(actionable_items(known, as_of), old_captures, old_records, there), "due")

    def mark(done: DataFrame, step: str) -> None:
        if on_stage is not None:
            rows = due.select(*state.columns).join(done.select("content_id").distinct(), "content_id", "left_semi")
            finished = rows.select("content_id", F.lit(step).alias("step"), F.lit(True).alias("finished"))
            on_stage(advance_stage(rows, finished, as_of))

    todo = due.select("content_id", "url", "content_kind", "resume_at")
    no_error = F.lit(None).cast("string").alias("error")

    texts = stage(_captured_texts(todo.filter("resume_at = 'capture'"), responses, given, policy), "page_text")
    spoken = transcripts.select("content_id", "text")
    if given.clips is not None:
        spoken = spoken.unionByName(_whole(combine_clips(given.clips), "content_id", "\n\n"))
    media = todo.filter("resume_at IN ('download', 'transcribe')")
    clips = media.join(_single(spoken, "text"), "content_id").select(*todo.columns, "text", no_error)
    if given.media is not None:
        waiting = media.join(spoken.select("content_id"), "content_id", "left_anti")
        seen = stage(_media_texts(waiting, given.media, models, prompts), "media_text")
        clips = clips.unionByName(waiting.join(seen, "content_id").select(*clips.columns))
    reused = todo.filter("resume_at IN ('enrich', 'write_note')").join(
        old_captures.select("content_id", "text"), "content_id"
    )
    captures = stage(
        todo.join(texts, "content_id")
        .select(*todo.columns, "text", "error")
        .unionByName(clips)
        .unionByName(reused.select(*todo.columns, "text", no_error)),
        "captures",
    )
    mark(captures.filter("error IS NULL AND resume_at NOT IN ('enrich', 'write_note')"), "transcribe")

    ready = render_prompts(
        captures.filter("error IS NULL AND resume_at <> 'write_note'"),
        prompts,
        {"source_url": F.col("url"), "transcript": F.col("text")},
    )
    asked = ready.select("content_id", "static_prefix", "prompt")
    answers = stage(apply_model(asked, models.enrich, "text STRING"), "answers")
    parsed = (
        parse_enrichments(answers.withColumnRenamed("error", "_model_error"))
        .withColumn("error", F.coalesce("_model_error", "error"))
        .drop("_model_error", "text")
    )
    if earlier_enrichments is not None:
        written = todo.filter("resume_at = 'write_note'").select("content_id")
        records = earlier_enrichments.join(written, "content_id", "left_semi")
        parsed = parsed.unionByName(records.withColumn("error", no_error).select(*parsed.columns))
    enriched = stage(parsed, "enrichments")

    good = enriched.filter("error IS NULL").drop("error")
    mark(good, "enrich")
    items = (
        good.join(captures.select("content_id", F.col("url").alias("source_url"), "text"), "content_id")
        .join(due.select("content_id", "added_at"), "content_id")
        .withColumn("created_at", F.lit(as_of).cast("timestamp"))
    )
    names = assign_note_names(
        items.select("content_id", "title", "added_at", F.lit("").alias("folder")), notes_on_disk
    )
    named = items.join(names.select("content_id", F.col("note_name").alias("note_path")), "content_id")
    notes = stage(render_notes(named), "notes")
    mark(notes, "write_note")
    skills = stage(_skills(notes, models, prompts, policy), "skills")

    problems = (
        due.select("content_id")
        .join(
            captures.select(
                "content_id", F.col("error").alias("_capture"), F.lit(True).alias("_got")
            ),
            "content_id",
            "left",
        )
        .join(enriched.select("content_id", F.col("error").alias("_enrich")), "content_id", "left")
        .withColumn(
            "message",
            F.when(F.col("_got").isNull(), "nothing was fetched for this item").otherwise(
                F.coalesce("_capture", "_enrich")
            ),
        )
        .filter("message IS NOT NULL")
        .select(
            "content_id",
            "message",
            F.lit("CaptureError()").alias("error_repr"),
            (F.col("_got").isNotNull() & F.col("_capture").isNull()).alias("captured"),
        )
    )
    missed = stage(problems, "problems")
    failures = apply_failures(
        _keep_captured(known, missed), missed.drop("captured"), policy, as_of
    )
    successes = apply_success(known, notes.select("content_id", "note_path"), skills, as_of)
    changed = stage(failures.rows.unionByName(successes), "changed")
    attention = stage(refused.unionByName(failures.attention), "attention")
    final = stage(upsert_state(known, changed, as_of), "state")
    return BatchResult(final, notes, skills, attention, run_outputs(changed), run_summary(changed))


def _single(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy("content_id").agg(F.max(column).alias(column))


def _whole(parts: DataFrame, key: str, sep: str) -> DataFrame:
    """(key, text): the numbered parts of each text joined again."""
    ordered = F.array_sort(F.collect_list(F.struct("part_no", "text")))
    text = F.array_join(F.transform(ordered, lambda p: p["text"]), sep)
    return parts.groupBy(key).agg(text.alias("text"))


def _media_texts(todo: DataFrame, files: DataFrame, models: Models, prompts: dict[str, str]) -> DataFrame:
    """(content_id, text, error) of media items by their files; the URL may name one of a carousel."""
    refs = extract_source_refs(todo.select("content_id", "url")).select("content_id", "img_index")
    own = files.join(todo.select("content_id"), "content_id", "left_semi")
    found = capture_media(own, models.describe, models.transcribe, prompts.get("image", ""), refs)
    errors = found.filter("error IS NOT NULL").select("content_id", F.lit(None).cast("string").alias("text"), "error")
    texts = _whole(found.filter("error IS NULL"), "content_id", "\n\n")
    return texts.withColumn("error", F.lit(None).cast("string")).unionByName(errors)


def _captured_texts(todo: DataFrame, responses: DataFrame, given: Fetched, policy: Policy) -> DataFrame:
    """(content_id, text, error) of the text items something was fetched for, each by its source."""
    items = extract_source_refs(dispatch_sources(todo.select("content_id", "url", "content_kind")))
    legs = []
    if given.outcomes is not None:
        told = classify_fetch_outcome(items.select("content_id", "url").join(given.outcomes, "content_id"))
        lost = told.filter("error IS NOT NULL").groupBy("content_id").agg(F.max("error").alias("error"))
        legs.append(lost.select("content_id", F.lit(None).cast("string").alias("text"), "error"))
        items = items.join(lost.select("content_id"), "content_id", "left_anti")
    own = {"repo": given.repo_meta, "blocks": given.blocks, "file": given.files}
    served = [name for name, rows in own.items() if rows is not None]
    plain = items.filter(~F.col("route").isin(*served)) if served else items

    def of(name: str, rows: DataFrame, column: str) -> DataFrame:
        return items.filter(F.col("route") == name).join(_single(rows, column), "content_id")

    if given.repo_meta is not None and given.repo_contents is not None:
        repos = assemble_repo_captures(of("repo", given.repo_meta, "payload"), _single(given.repo_contents, "payload"))
        legs.append(repos.select("content_id", "text", "error"))
    if given.blocks is not None:
        asked = of("blocks", given.blocks, "payload").select("content_id", "page_id", "payload")
        rows = parse_block_map(_single(asked.select(F.col("page_id").alias("content_id"), "payload"), "payload").withColumnRenamed("content_id", "page_id"))
        found = rows.filter("parent_id IS NULL").select("page_id").distinct()
        read = _whole(flatten_block_trees(rows.join(found, "page_id", "left_semi")), "page_id", "\n")
        missing = F.when(F.col("text").isNull(), "page was not found or is not public")
        legs.append(asked.join(read, "page_id", "left").select("content_id", "text", missing.alias("error")))
    if given.files is not None:
        legs.append(decode_documents(of("file", given.files, "body")).select("content_id", "text", "error"))
    pages = plain.join(_single(responses, "html"), "content_id")
    read = route_captures(gate_captures(extract_main_text(pages).drop("html")), policy)
    shown = read.select("content_id", "url", "text", "route", "error")
    if given.rendered is not None:
        again = shown.filter("route = 'needs_render'").select("content_id", "url")
        again = extract_main_text(again.join(_single(given.rendered, "html"), "content_id")).drop("html")
        again = route_captures(gate_captures(again), policy, rendered=True)
        shown = merge_captures(shown, again.select("content_id", "text", "route", "error"))
    problem = F.when(F.col("route") == "needs_render", "page needs rendering").otherwise(F.col("error"))
    kept = F.when(F.col("route") == "captured", F.col("text"))
    legs.append(shown.select("content_id", kept.alias("text"), problem.alias("error")))
    return reduce(DataFrame.unionByName, legs)


@dataclass(frozen=True)
class Housekeeping:
    """Plans of what a run leaves to tidy up: rows to delete, and the attention rows to keep."""

    stale: DataFrame
    orphans: DataFrame
    attention: DataFrame


def plan_housekeeping(
    before: DataFrame, after: DataFrame, artifacts: DataFrame, attention: DataFrame, as_of: datetime, days: int
) -> Housekeeping:
    """What a finished run makes superfluous; ``days`` is the retention of artifacts and log."""
    return Housekeeping(
        stale_outputs(before, after),
        orphan_artifacts(artifacts, as_of, days, after),
        prune_attention(attention, as_of, days),
    )


def _keep_captured(state: DataFrame, missed: DataFrame) -> DataFrame:
    """Rows of the failed items, marked as transcribed where this run got that far."""
    later = F.col("captured") & ~F.coalesce(F.col("last_completed_stage") == "enriched", F.lit(False))
    stage = F.when(later, "transcribed").otherwise(F.col("last_completed_stage"))
    failed = state.join(missed.select("content_id", "captured"), "content_id")
    return failed.withColumn("last_completed_stage", stage).select(*state.columns)


def _skills(notes: DataFrame, models: Models, prompts: dict[str, str], policy: Policy) -> DataFrame:
    """(content_id, skill_path, skill_error, content) of the items worth a skill."""
    wanted = skill_candidates(notes, policy)
    if models.skill is None or "skill" not in prompts:
        return wanted.limit(0).select(
            "content_id", "skill_path", F.lit(None).cast("string").alias("skill_error"), F.lit("").alias("content")
        )
    asked = render_skill_prompts(wanted, prompts["skill"])
    written = apply_model(
        asked.select("content_id", "static_prefix", "prompt"), models.skill, "text STRING"
    )
    return written.join(wanted.select("content_id", "skill_path"), "content_id").select(
        "content_id",
        F.when(F.col("error").isNull(), F.col("skill_path")).alias("skill_path"),
        F.col("error").alias("skill_error"),
        F.col("text").alias("content"),
    )
