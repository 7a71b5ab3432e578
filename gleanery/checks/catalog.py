"""One query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.checks import inputs as I
from gleanery.checks.inputs import AS_OF, POLICY, shown, table, text, words
from gleanery.durable import durable, shared_dir
from gleanery.operators import answers, attempts, blocks, captures, lifecycle, media, publish
from gleanery.operators import registry, repos, urls
from gleanery.plans.batch import Models, run_batch
from gleanery.plans.media import capture_media
from gleanery.policy import Policy
from gleanery.schemas import ENRICHMENT
from gleanery.sources import files, storage
from gleanery.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STATE_SHOWN = (
    "content_id",
    "url",
    "normalized_url",
    "source",
    "status",
    "content_kind",
    "added_at",
    "updated_at",
    "error",
    "note_path",
    "skill_path",
    "attempt_count",
    "next_retry_at",
    "last_completed_stage",
    "skill_error",
)
TIMES = ("added_at", "updated_at", "next_retry_at")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def shown_state(rows: DataFrame) -> DataFrame:
    return rows.select(
        *(shown(c).alias(c) if c in TIMES else F.col(c).alias(c) for c in STATE_SHOWN)
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder every executor can see."""
    return f"{shared_dir(spark)}/gleanery/{name}-{uuid.uuid4().hex}"


def lines(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


# --- URLs ---------------------------------------------------------------------------------


@query
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.canonicalize_urls(I.submissions(spark, sf_dir)).select("seq", "normalized_url")


@query
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    canonical = urls.canonicalize_urls(I.submissions(spark, sf_dir))
    return urls.assign_content_ids(canonical).select("seq", "content_id")


@query
def hosts_and_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.extract_hosts(I.submissions(spark, sf_dir)).select("seq", "host", "domain")


@query
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.validate_urls(I.submissions(spark, sf_dir), POLICY).select(
        "seq", "ok", "normalized_url", "content_id", "reason", "blocked"
    )


@query
def url_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.classify_urls(I.submissions(spark, sf_dir), POLICY).select("seq", "kind")


@query
def listed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts matched against a table of domains taken from the pages themselves."""
    hosts = urls.extract_hosts(I.submissions(spark, sf_dir))
    some = urls.extract_hosts(table(spark, sf_dir, "pages").filter("page_id % 5 = 0"))
    listed = some.select(F.regexp_replace("host", r"\A(m|blog)\.", "").alias("domain"))
    return urls.match_domains(hosts, listed).select("seq", "host", "listed")


@query
def private_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses built from the page numbers, over all of the IPv4 space."""
    n = F.col("page_id")
    address = text(
        "http://",
        words(n * 7 % 256),
        ".",
        words(F.when(n % 3 == 0, 168).when(n % 3 == 1, 16 + n % 20).otherwise(n % 256)),
        ".",
        words(n % 3),
        ".",
        F.when(n % 11 == 0, "007").otherwise(words(n % 300)),
        ":80/x",
    )
    hosts = urls.extract_hosts(table(spark, sf_dir, "pages").withColumn("url", address))
    return urls.flag_private_hosts(hosts).select("page_id", "host", "is_private")


@query
def probed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = urls.classify_urls(I.submissions(spark, sf_dir), POLICY, I.probes(spark, sf_dir))
    return kinds.select("seq", "kind")


@query
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.extract_source_refs(I.submissions(spark, sf_dir)).select(
        "seq", "owner", "repo", "ref", "file_path", "page_id", "file_id", "img_index"
    )


@query
def actionable_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_state(lifecycle.actionable_items(I.state(spark, sf_dir), AS_OF))


# --- Registration and state ---------------------------------------------------------------


@query
def first_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = urls.assign_content_ids(urls.canonicalize_urls(I.submissions(spark, sf_dir)))
    first = registry.first_submission(keyed)
    return first.select("content_id", "seq", "url", "source", shown("submitted_at").alias("submitted_at"))


def _registration(spark: SparkSession, sf_dir: str) -> registry.Registration:
    return registry.register_urls(
        I.submissions(spark, sf_dir), I.state(spark, sf_dir), POLICY, AS_OF, I.probes(spark, sf_dir)
    )


@query
def registered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_state(_registration(spark, sf_dir).rows)


@query
def registration_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registration(spark, sf_dir).attention.select(shown("ts").alias("ts"), "url", "reason")


@query
def newly_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = I.state(spark, sf_dir)
    after = before.unionByName(_registration(spark, sf_dir).rows)
    return registry.newly_registered(before, after).select("content_id", "status", "url")


@query
def resolved_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = registry.resolve_submissions(
        I.submissions(spark, sf_dir), I.state(spark, sf_dir), POLICY
    )
    return resolved.select("seq", "submitted_url", "content_id", "status", "url")


@query
def submission_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs, known = I.submissions(spark, sf_dir), I.state(spark, sf_dir)
    after = known.unionByName(registry.register_urls(subs, known, POLICY, AS_OF).rows)
    return registry.submission_responses(
        registry.resolve_submissions(subs, after, POLICY), AS_OF
    )


def _changes(state: DataFrame) -> DataFrame:
    """Every third row pending again, and a new row beside every fifth."""
    n = I.id_number()
    again = state.filter(n % 3 == 0).withColumn("status", F.lit("pending"))
    beside = state.filter(n % 5 == 0).withColumn("content_id", text("new-", F.col("content_id")))
    return again.unionByName(beside)


@query
def upserted_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = I.state(spark, sf_dir)
    return shown_state(registry.upsert_state(state, _changes(state), AS_OF))


@query
def updated_state_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = I.state(spark, sf_dir)
    stuck = F.col("status").isin("downloading", "transcribing") & (F.col("attempt_count") > 1)
    assign = {"status": F.lit("failed"), "error": text("stuck after ", words(F.col("attempt_count")))}
    return shown_state(registry.update_state_where(state, stuck, assign, AS_OF))


@query
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts exist for some of the ids only."""
    state, n = I.state(spark, sf_dir), I.id_number()
    plan = lifecycle.plan_resume(
        state, state.filter(n % 2 == 0), state.filter(n % 3 == 0), state.filter(n % 5 < 3)
    )
    return plan.select("content_id", "content_kind", "last_completed_stage", "resume_at")


# --- Life cycle ---------------------------------------------------------------------------


@query
def applied_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_state(_failures(spark, sf_dir).rows)


@query
def failure_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir).attention.select(shown("ts").alias("ts"), "url", "reason")


def _failures(spark: SparkSession, sf_dir: str) -> lifecycle.Failures:
    state, n = I.state(spark, sf_dir), I.id_number()
    failed = lifecycle.actionable_items(state, AS_OF).select(
        "content_id",
        F.when(n % 4 == 0, "").otherwise(text("e", words(n % 3))).alias("message"),
        F.lit("TimeoutError()").alias("error_repr"),
    )
    return lifecycle.apply_failures(state, failed, Policy(), AS_OF)


@query
def applied_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, n = I.state(spark, sf_dir), I.id_number()
    due = lifecycle.actionable_items(state, AS_OF)
    notes = due.select("content_id", text("vault/", F.col("content_id"), ".md").alias("note_path"))
    skills = due.filter(n % 3 < 2).select(
        "content_id",
        F.when(n % 3 == 0, text("skills/", F.col("content_id"), "/SKILL.md")).alias("skill_path"),
        F.when(n % 3 == 1, "model was away").alias("skill_error"),
    )
    return shown_state(lifecycle.apply_success(state, notes, skills, AS_OF))


@query
def retry_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = I.state(spark, sf_dir)
    wanted = state.filter(I.id_number() % 2 == 0).select("content_id")
    return shown_state(lifecycle.reset_for_retry(state, wanted, AS_OF))


@query
def retry_resets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown_state(lifecycle.reset_for_retry(I.state(spark, sf_dir), None, AS_OF))


@query
def advanced_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, n = I.state(spark, sf_dir), I.id_number()
    names = F.array(*(F.lit(s[0]) for s in lifecycle.STEPS))
    steps = state.select(
        "content_id", F.get(names, (n % 5).cast("int")).alias("step"), (n % 2 == 0).alias("finished")
    )
    return shown_state(lifecycle.advance_stage(state, steps, AS_OF))


@query
def attempt_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed = attempts.replay_attempts(I.attempts(spark, sf_dir), POLICY)
    return replayed.select(
        "content_id",
        "attempt_id",
        "kind",
        "status",
        "attempt_count",
        shown("next_retry_at").alias("next_retry_at"),
    )


@query
def attention_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = attempts.attention_events(attempts.replay_attempts(I.attempts(spark, sf_dir), POLICY))
    return events.select("content_id", "attempt_id", shown("ts").alias("ts"), "reason")


@query
def call_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = attempts.throttle_schedule(I.calls(spark, sf_dir), POLICY)
    return planned.select("call_id", "provider", "wait_us", shown("starts_at").alias("starts_at"))


def _attention_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log lines; some without a readable time."""
    ts = shown(F.col("ts").cast("timestamp"))
    stamp = F.when(F.col("event_id") % 50 == 0, "yesterday").otherwise(ts)
    line = F.concat_ws("\t", stamp, text("https://e/", words(F.col("event_id"))), F.col("event_type"))
    return table(spark, sf_dir, "events").select(line.alias("value"))


@query
def attention_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = files.parse_attention(_attention_log(spark, sf_dir))
    return parsed.select(shown("ts").alias("ts"), "url", "reason", "line")


MID_JANUARY = AS_OF.replace(year=2024, month=2, day=14)


@query
def pruned_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = files.parse_attention(_attention_log(spark, sf_dir))
    return lifecycle.prune_attention(parsed, MID_JANUARY, 30).select("url", "line")


@query
def pruned_attention_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = files.parse_attention(_attention_log(spark, sf_dir))
    return lifecycle.pruned_count(parsed, MID_JANUARY, 30)


@query
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = lifecycle.state_health(I.state(spark, sf_dir))
    return measured.withColumn("last_success_at", shown("last_success_at"))


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.run_summary(I.state(spark, sf_dir))


@query
def run_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.run_outputs(I.state(spark, sf_dir))


@query
def state_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.state_size_check(I.state(spark, sf_dir), 100)


@query
def stale_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run renamed every third note and lost every other skill."""
    before, n = I.state(spark, sf_dir), I.id_number()
    after = before.withColumns(
        {
            "note_path": F.when(n % 3 == 0, text("new/", F.col("note_path"))).otherwise(F.col("note_path")),
            "skill_path": F.when(n % 2 == 0, F.col("skill_path")),
        }
    )
    return lifecycle.stale_outputs(before, after)


@query
def orphan_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One artifact per submission; many belong to ids the state has never seen."""
    keyed = urls.assign_content_ids(urls.canonicalize_urls(I.submissions(spark, sf_dir)))
    made = keyed.select(
        "content_id",
        text("tmp/", words(F.col("seq"))).alias("path"),
        I.start_plus(F.col("seq") * 97 % 2000000).alias("modified_at"),
    )
    old = lifecycle.orphan_artifacts(made, AS_OF, 20, I.state(spark, sf_dir))
    return old.select("content_id", "path", shown("modified_at").alias("modified_at"), "status")


# --- Media --------------------------------------------------------------------------------


@query
def silent_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.split_silent_video(I.media_files(spark, sf_dir)).select("content_id", "path")


@query
def media_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.group_media(I.media_files(spark, sf_dir))


@query
def images_and_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.media_files(spark, sf_dir)
    images = found.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png|webp)\z"))
    return media.append_frames(images, media.split_silent_video(found))


@query
def carousel_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.media_files(spark, sf_dir)
    conv = F.col("content_id").cast("long")
    refs = found.select("content_id").distinct().withColumn(
        "img_index", F.when(conv % 3 > 0, (conv % 3).cast("int"))
    )
    return media.select_carousel_item(found, refs).select("content_id", "item_no", "path")


@query
def combined_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.combine_clips(I.clips(spark, sf_dir))


@query
def joined_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.join_segments(I.segments(spark, sf_dir))


# --- Text captures ------------------------------------------------------------------------


@query
def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored responses, written and read back."""
    made = table(spark, sf_dir, "pages").select(
        words(F.col("page_id")).alias("content_id"),
        "url",
        F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"),
        F.encode("html", "UTF-8").alias("body"),
    )
    path = scratch(spark, "responses")
    files.write_artifacts(made, path)
    read = files.read_responses(spark, path)
    return read.select(
        "content_id",
        "url",
        "status",
        F.element_at("headers", "content-type").alias("content_type"),
        F.md5("body").alias("body_md5"),
    )


@query
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "text")


@query
def gated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = captures.extract_main_text(I.gated_pages(spark, sf_dir))
    return captures.gate_captures(read).select("page_id", "gate")


def _plain_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = captures.extract_main_text(I.gated_pages(spark, sf_dir)).drop("html")
    return captures.route_captures(captures.gate_captures(read), POLICY)


@query
def routed_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_pass(spark, sf_dir).select("page_id", "gate", "route", "error")


@query
def merged_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The original pages serve as the rendered form of the shells among them."""
    plain = _plain_pass(spark, sf_dir)
    waiting = plain.filter("route = 'needs_render'").select("content_id")
    original = table(spark, sf_dir, "pages").select(
        words(F.col("page_id")).alias("content_id"), "url", "html"
    )
    rendered = captures.extract_main_text(original.join(waiting, "content_id", "left_semi"))
    settled = captures.route_captures(captures.gate_captures(rendered), POLICY, rendered=True)
    merged = captures.merge_captures(plain, settled)
    return merged.select("page_id", "route", "backend", "error", F.md5("text").alias("text_md5"))


@query
def page_text_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered pages per host, with how many were captured and how much text they gave."""
    read = captures.gate_captures(captures.extract_main_text(table(spark, sf_dir, "pages")))
    # Only a few numbers per page go on to the shuffle, not its HTML or text.
    narrow = read.select(
        F.col("page_id").alias("seq"),
        "url",
        F.lit(None).cast("timestamp").alias("submitted_at"),
        "gate",
        F.length("text").alias("chars"),
    )
    keyed = urls.assign_content_ids(urls.canonicalize_urls(narrow))
    hosted = urls.extract_hosts(registry.first_submission(keyed))
    return hosted.groupBy("host").agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("gate") == "ok").alias("captured"),
        F.sum("chars").alias("chars"),
    )


@query
def repo_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as repository files behind two API answers."""
    doc_id, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    topics = F.array(F.col("lang"), F.col("source"))
    answer = F.to_json(
        F.struct(
            F.when(doc_id % 3 > 0, text("About ", words(doc_id))).alias("description"),
            (doc_id * 3).alias("stargazers_count"),
            F.when(doc_id % 4 > 0, F.col("lang")).alias("language"),
            F.when(doc_id % 5 > 0, topics).alias("topics"),
            F.when(doc_id % 2 == 0, "dev").alias("default_branch"),
        )
    )
    meta = docs.select(
        words(doc_id).alias("content_id"),
        text("own", words(doc_id % 7)).alias("owner"),
        text("repo", words(doc_id)).alias("repo"),
        F.when(doc_id % 2 == 1, text("docs/", words(doc_id), ".md")).alias("file_path"),
        answer.alias("payload"),
    )
    body = text("[guide](./docs/g.md) ", F.col("text"))
    wrapped = F.regexp_replace(F.base64(F.encode(body, "UTF-8")), "(.{60})", "$1\n")
    contents = docs.select(
        words(doc_id).alias("content_id"),
        F.to_json(F.struct(F.lit("base64").alias("encoding"), wrapped.alias("content"))).alias("payload"),
    )
    return repos.assemble_repo_captures(meta, contents).select("content_id", "text", "backend")


@query
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one link of each kind before their text."""
    doc_id = F.col("doc_id")
    n = words(doc_id)
    links = text(
        "[a](./docs/", n, '.md "T") ![b](/img/', n, ".png) [c](https://x.org/", n, ") [d](#s) ",
        "[e](mailto:a@b.c) [![f](badge.svg)](ci/", n, ") [g](", n, ") ",
    )
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        text("own", words(doc_id % 7)).alias("owner"),
        text("repo", n).alias("repo"),
        F.when(doc_id % 2 == 0, "dev").alias("default_branch"),
        text(links, F.col("text")).alias("text"),
    )
    return repos.absolutize_links(docs).select("doc_id", "text")


@query
def block_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.flatten_block_trees(I.blocks(spark, sf_dir))


@query
def block_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn as a page answer with one linked block and one missing one."""
    key = text("t", words(F.col("conv_id")), "-", words(F.col("turn")))
    child = text(key, "-c")
    runs = F.array(
        F.array(F.substring(F.col("text"), 1, 5)),
        F.array(F.lit("‣")),
        F.array(F.substring(F.col("text"), F.lit(6), F.length("text"))),
    )
    def block(name: Column, kind: str, title: Column, children: Column) -> Column:
        return F.struct(
            name.alias("id"),
            F.lit(kind).alias("type"),
            F.struct(title.alias("title")).alias("properties"),
            children.alias("content"),
        )

    page = block(key, "page", F.array(F.array(F.col("role"))), F.array(text(key, "-gone"), child))
    leaf = block(child, "text", runs, F.array().cast("array<string>"))
    once = F.to_json(F.struct(page.alias("value")))
    twice = F.to_json(F.struct(F.struct(leaf.alias("value")).alias("value")))
    payload = text(
        '{"recordMap": {"block": {"', key, '": ', once, ', "', child, '": ', twice, ', "odd": {"value": {"x": 1}}}}}'
    )
    made = table(spark, sf_dir, "conversations").select(key.alias("page_id"), payload.alias("payload"))
    return blocks.parse_block_map(made)


@query
def decoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as downloaded files; some bytes are no text at all."""
    doc_id, pid = F.col("doc_id"), F.col("page_id")
    plain = F.encode(text("\n ", F.col("text"), "  \n"), "UTF-8")
    bad = F.concat(F.unhex(F.lit("FFFE00")), plain)
    docs = table(spark, sf_dir, "documents").select(
        text("d", words(doc_id)).alias("content_id"),
        text("https://drive.google.com/file/d/", words(doc_id)).alias("url"),
        F.when(doc_id % 13 == 0, bad).otherwise(plain).alias("body"),
    )
    shell = F.lit("<html><body><script>x()</script></body></html>")
    pages = table(spark, sf_dir, "pages").select(
        text("p", words(pid)).alias("content_id"),
        "url",
        F.encode(F.when(pid % 9 == 0, shell).otherwise(F.col("html")), "UTF-8").alias("body"),
    )
    return captures.decode_documents(docs.unionByName(pages)).select("content_id", "text", "error")


@query
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    status = F.get(F.array(*(F.lit(s) for s in (200, 403, 404, 500, 302))), (n % 5).cast("int"))
    left = F.when(n % 2 == 0, "0").otherwise("17")
    source = F.get(F.array(*(F.lit(s) for s in ("repo", "blocks", "file", "html"))), (n % 4).cast("int"))
    quota = F.create_map(F.lit("x-ratelimit-remaining"), left, F.lit("x-ratelimit-reset"), words(n))
    no_headers = F.create_map().cast("map<string,string>")
    made = table(spark, sf_dir, "events").select(
        "event_id",
        text("https://h/", words(n)).alias("url"),
        status.alias("status"),
        F.when(n % 3 > 0, quota).otherwise(no_headers).alias("headers"),
        source.alias("source_type"),
    )
    return captures.classify_fetch_outcome(made).select("event_id", "outcome", "error")


@query
def source_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = urls.classify_urls(I.submissions(spark, sf_dir), POLICY).filter("kind IS NOT NULL")
    return captures.dispatch_sources(kinds, kind="kind").select("seq", "kind", "route", "backend")


# --- Model answers ------------------------------------------------------------------------

PROMPTS = {
    "text": f"Summarise.\n{answers.CACHE_BOUNDARY}\nFrom {{{{source_url}}}}:\n{{{{transcript}}}}\n",
    "media": "Clip {{source_url}} says {{transcript}}",
    "skill": f" Write a skill. {answers.CACHE_BOUNDARY} {{{{title}}}}: {{{{skill_candidate_reason}}}}\n"
    "{{key_takeaways}}\n{{summary}}\n{{transcript}} ",
}
PROVIDERS = ("anthropic", "ollama", "groq", "gemini", "cerebras")


def _provider(n: Column) -> Column:
    return F.get(F.array(*(F.lit(p) for p in PROVIDERS)), (n % 5).cast("int"))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id")
    made = table(spark, sf_dir, "documents").select(
        "doc_id",
        text("https://e/", words(doc_id)).alias("url"),
        F.when(doc_id % 2 == 0, "text").otherwise("media").alias("content_kind"),
        "text",
    )
    return answers.render_prompts(
        made, PROMPTS, {"source_url": F.col("url"), "transcript": F.col("text")}
    )


@query
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("doc_id", "static_prefix", "prompt")


@query
def skill_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = answers.render_skill_prompts(I.items(spark, sf_dir), PROMPTS["skill"])
    return made.select("content_id", "static_prefix", "prompt")


@query
def image_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = media.group_media(I.media_files(spark, sf_dir))
    template = f"Describe.{answers.CACHE_BOUNDARY}{{{{image_count}}}} image(s)"
    return answers.render_image_prompts(grouped, template).select("content_id", "static_prefix", "prompt")


@query
def model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _prompts(spark, sf_dir).withColumn("provider", _provider(F.col("doc_id")))
    made = answers.build_model_requests(asked, "model-x", 4096, json_mode=True)
    return made.select("doc_id", "provider", "request")


@query
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers in the shape of each provider; some are empty."""
    doc_id = F.col("doc_id")
    said = F.when(doc_id % 12 == 0, "").when(doc_id % 12 == 1, text("<think>x</think> ", F.col("text"))).otherwise(F.col("text"))
    made = table(spark, sf_dir, "documents").select("doc_id", _provider(doc_id).alias("provider"), said.alias("said"))
    part = F.struct(F.col("said").alias("text"))
    block = F.struct(F.when(doc_id % 12 == 0, "tool").otherwise("text").alias("type"), F.col("said").alias("text"))
    chat = F.struct(F.array(F.struct(F.struct(F.col("said").alias("content")).alias("message"))).alias("choices"))
    why = F.when(doc_id % 24 == 0, "MAX_TOKENS").otherwise("STOP")
    candidate = F.struct(F.struct(F.array(part, part).alias("parts")).alias("content"), why.alias("finishReason"))
    payload = (
        F.when(F.col("provider") == "anthropic", F.to_json(F.struct(F.array(block, block).alias("content"))))
        .when(F.col("provider") == "ollama", F.to_json(F.struct(F.col("said").alias("response"))))
        .when(F.col("provider") == "gemini", F.to_json(F.struct(F.array(candidate).alias("candidates"))))
        .otherwise(F.to_json(chat))
    )
    read = answers.read_model_responses(made.withColumn("payload", payload))
    return read.select("doc_id", "provider", "text", "error")


@query
def reasoning_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.strip_reasoning(I.model_texts(spark, sf_dir)).select("doc_id", "text")


@query
def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = answers.parse_enrichments(answers.strip_reasoning(I.model_texts(spark, sf_dir)))
    return read.select(
        "doc_id",
        "title",
        "summary",
        lines("tags"),
        lines("tools_mentioned"),
        lines("key_takeaways"),
        "high_signal",
        "skill_candidate_reason",
        "error",
    )


REFUSAL_OPENINGS = (
    "It seems I can't open those pictures; ",
    "As a text model I’m not able to interpret your screenshot. ",
    "Could you please upload the photos again? ",
    "A sign reads: no dogs may access the beach. ",
    "The caption asks friends to send more pictures. ",
    "Here I cannot look at either of these images. ",
    "",
)


@query
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id = F.col("doc_id")
    opening = F.get(F.array(*(F.lit(o) for o in REFUSAL_OPENINGS)), (doc_id % 7).cast("int"))
    said = table(spark, sf_dir, "documents").select("doc_id", text(opening, F.col("text")).alias("text"))
    return answers.flag_refusals(said).select("doc_id", "refused", "error")


@query
def rate_limit_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    told = F.get(
        F.array(words(F.col("event_id") % 90), F.lit("Wed, 21 Oct 2026 07:28:00 GMT"), F.lit("-3"), F.lit("7.5")),
        (n % 5).cast("int"),
    )
    no_headers = F.create_map().cast("map<string,string>")
    made = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(n % 3 == 0, 200).otherwise(429).alias("status"),
        F.when(n % 5 < 4, F.create_map(F.lit("retry-after"), told)).otherwise(no_headers).alias("headers"),
        (n % 4).cast("int").alias("attempt"),
    )
    return answers.rate_limit_waits(made).select("event_id", "wait_seconds", "action")


@query
def model_plug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in model that counts words and fails on some rows."""

    def make_model():
        def model(rows: pd.DataFrame) -> pd.DataFrame:
            if (rows["doc_id"] % 97 == 3).any():
                raise ValueError(f"cannot read document {rows['doc_id'].iloc[0]}")
            return pd.DataFrame({"words": rows["text"].str.split(" ").str.len().astype("int64")})

        return model

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = answers.apply_model(docs, make_model, "words LONG", key="doc_id")
    return done.withColumn("error", F.when(F.col("error").isNotNull(), text("cannot read document ", words(F.col("doc_id")))))


# --- Publishing ---------------------------------------------------------------------------


@query
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = table(spark, sf_dir, "documents").select("doc_id", I.title_of(F.col("text")).alias("title"))
    return publish.slugify_titles(titled)


@query
def note_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, present = I.naming(spark, sf_dir)
    return publish.assign_note_names(named, present).select("content_id", "folder", "note_name")


@query
def rendered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.render_notes(I.items(spark, sf_dir)).select("content_id", "content")


@query
def note_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = publish.render_notes(I.items(spark, sf_dir)).select("content_id", "content")
    cut = F.when(F.col("content_id").cast("long") % 10 == 0, F.substring("content", 5, F.length("content")))
    broken = notes.withColumn("content", F.coalesce(cut, "content"))
    return files.parse_notes(broken).select("content_id", "owner", "title")


@query
def skill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.skill_candidates(I.items(spark, sf_dir), POLICY).select("content_id", "skill_path")


@query
def last_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many documents share a first word, so many skills share a path."""
    path = text(publish.slug(F.substring_index("title", " ", 1)), "/SKILL.md")
    written = I.items(spark, sf_dir).select(
        "content_id",
        path.alias("skill_path"),
        F.col("created_at").alias("written_at"),
        text("  ", F.col("summary"), "\n\n").alias("content"),
    )
    return publish.last_skill_per_path(written).select("skill_path", "content_id", "content")


def _vault(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The state's notes on disk; some belong to someone else, some to nobody, some are gone."""
    state = I.state(spark, sf_dir)
    n = I.id_number()
    owner = F.when(n % 7 == 0, "someone-else").when(n % 7 > 1, F.col("content_id"))
    title = F.when(n % 5 > 0, text("Title ", F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3).cast("int"))))
    notes = state.filter("note_path IS NOT NULL").filter(n % 11 > 0)
    return state, notes.select("note_path", owner.alias("owner"), title.alias("title"))


@query
def note_owner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, notes = _vault(spark, sf_dir)
    return publish.note_owner_check(state, notes).select(
        "content_id", "note_path", "owner", "file_title", "owner_ok"
    )


@query
def organized_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.organize_notes(*_vault(spark, sf_dir))


# --- Sources, sinks, streams --------------------------------------------------------------


@query
def inbox_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions written as inbox lines with comments and blanks, and read again."""
    n = F.col("seq")
    lines_of = F.array_compact(
        F.array(
            F.when(n % 6 == 0, text("# note ", words(n))),
            F.when(n % 7 == 0, "   "),
            text("  ", F.col("url"), " "),
        )
    )
    path = scratch(spark, "inbox")
    I.submissions(spark, sf_dir).select(F.explode(lines_of).alias("value")).write.text(path)
    return files.read_submissions(spark, path).select("url", "source")


@query
def state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots written; the later one is read."""
    path, state = scratch(spark, "state"), I.state(spark, sf_dir)
    storage.write_state(state, path)
    storage.write_state(registry.upsert_state(state, _changes(state), AS_OF), path)
    return shown_state(storage.read_state(spark, path))


@query
def state_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows as one JSON document per line, as an older version wrote them."""
    record = F.to_json(
        F.struct("content_id", "url", "normalized_url", "source", "status", "added_at", "updated_at")
    )
    path = scratch(spark, "documents")
    document = text('{"items": {"', F.col("content_id"), '": ', record, "}}")
    I.state(spark, sf_dir).select(document.alias("value")).write.text(path)
    return shown_state(storage.read_state_json(spark, path, one_document=False))


@query
def stage_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment records kept as JSON text; the unreadable ones count as missing."""
    read = files.parse_artifacts(
        I.model_texts(spark, sf_dir).select("content_id", F.col("text").alias("value")), ENRICHMENT
    )
    return read.select("content_id", "title", "summary")


@query
def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small file per conversation role, listed without reading it."""
    path = scratch(spark, "media")
    made = table(spark, sf_dir, "conversations").select(F.col("role").alias("content_id"), F.col("text"))
    made.groupBy("content_id").agg(F.count("*").alias("n")).write.partitionBy("content_id").mode("overwrite").json(path)
    listed = files.list_media(spark, path).filter("suffix = '.json'")
    return listed.groupBy("content_id", "suffix").agg((F.count("*") > 0).alias("present"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    no_context = F.create_map().cast("map<string,string>")
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        text("worker.", F.col("event_type")).alias("logger"),
        text('event "', words(n), '"').alias("message"),
        F.when(n % 2 == 0, F.create_map(F.lit("user"), words(F.col("user_id")))).otherwise(no_context).alias("context"),
        F.when(F.col("event_type") == "error", text("Traceback\n  ", words(n))).alias("exc_info"),
    )


@query
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.render_logs(_logs(spark, sf_dir))


@query
def parsed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = files.parse_logs(files.render_logs(_logs(spark, sf_dir)))
    user = F.try_element_at("context", F.lit("user")).alias("user")
    return read.select(shown("timestamp").alias("timestamp"), "level", "logger", "message", user, "exc_info")


def _drained(spark: SparkSession, parts: list[DataFrame], folder: str, start) -> None:
    """Write the parts one after the other and run a query, stopped and started again, over each."""
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
        jobs.drain(start(stream).option("checkpointLocation", f"{folder}/ck"), spark)


def _in_time(rows: DataFrame, time: str, parts: int) -> list[DataFrame]:
    """Rows cut into parts of about equal size, each later than the one before."""
    at = F.col(time).cast("double")
    cuts = rows.select(at.alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    edges = [float("-inf"), *cuts, float("inf")]
    return [rows.filter((at > lo) & (at <= hi)) for lo, hi in zip(edges, edges[1:], strict=False)]


@query
def streamed_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submissions as a stream in three parts, each registered until it is drained."""
    root = scratch(spark, "stream")
    storage.write_state(I.state(spark, sf_dir), f"{root}/state")
    given = I.submissions(spark, sf_dir).select("seq", "url", "submitted_at", F.lit("webhook").alias("source"))

    def start(stream: DataFrame):
        return jobs.stream_register(stream, f"{root}/state", f"{root}/added", f"{root}/attention", POLICY, AS_OF)

    _drained(spark, _in_time(given, "submitted_at", 3), root, start)
    return shown_state(storage.read_state(spark, f"{root}/added"))


@query
def streamed_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempt log as a stream in four parts; the clock then runs on to the end."""
    root = scratch(spark, "retries")
    log = I.attempts(spark, sf_dir)
    tick = log.agg(F.lit(AS_OF).cast("timestamp").alias("attempt_ts"), F.lit("clock").alias("kind"))
    tick = tick.select(*(F.col(c) if c in tick.columns else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns))
    _drained(spark, [*_in_time(log, "attempt_ts", 4), tick], root, lambda stream: jobs.stream_retries(stream, POLICY, f"{root}/retries"))
    out = storage.read_batches(spark, f"{root}/retries/events")
    return out.select("content_id", "event", "attempt_count", shown("at").alias("at"), "error")


@query
def streamed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health after three batches of changes: all rows, an upsert, and some successes."""
    root, state = scratch(spark, "health"), I.state(spark, sf_dir)
    storage.write_state(state, f"{root}/state")
    none = state.limit(0)
    feeds = [lifecycle.status_changes(none, state)]
    for batch, change in enumerate((_changes(state), _finished(state))):
        before = storage.read_state(spark, f"{root}/state")
        stamped = change.withColumn("updated_at", F.lit(AS_OF).cast("timestamp"))
        feeds.append(lifecycle.status_changes(before, stamped))
        feeds[-1] = durable(feeds[-1])
        storage.write_state_changes(change, f"{root}/state", AS_OF, run="health", batch=batch)
    _drained(spark, feeds, root, lambda stream: jobs.stream_health(stream, f"{root}/out"))
    read = storage.read_batches(spark, f"{root}/out")
    last = read.groupBy("run").agg(F.max_by(F.struct("status", "queue_depth", "failed_count", "last_success_at"), "batch").alias("h"))
    return last.select("h.*").withColumn("last_success_at", shown("last_success_at"))


def _finished(state: DataFrame) -> DataFrame:
    """Every seventh row done."""
    return state.filter(I.id_number() % 7 == 0).withColumn("status", F.lit("done"))


@query
def state_changes_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two small upserts into a stored state, folded together, read bucket by bucket."""
    path, state = scratch(spark, "log"), I.state(spark, sf_dir)
    storage.write_state(state, path)
    storage.write_state_changes(_changes(state), path, AS_OF, run="one")
    storage.write_state_changes(_finished(state), path, AS_OF, run="two")
    log = storage.state_log(spark, path)
    log.compact(always=True)
    halves = [log.read(buckets=[b for b in range(log.buckets) if b % 2 == half]) for half in (0, 1)]
    return shown_state(halves[0].unionByName(halves[1]))


@query
def notes_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes table after a second batch replaces every third note."""
    path = scratch(spark, "notes")
    number = words(F.col("doc_id"))
    docs = table(spark, sf_dir, "documents").withColumns(
        {"content_id": text("d", number), "note_path": text("n", number, ".md"), "content": F.coalesce("text", F.lit(""))}
    )
    files.write_notes(docs, path)
    files.write_notes(docs.filter("doc_id % 3 = 0").withColumn("content", text("# again\n", F.col("content"))), path)
    return files.read_notes_table(spark, path).select("content_id", "note_path", F.md5("content").alias("content_md5"))


# --- The whole batch ----------------------------------------------------------------------


@query
def media_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloaded files to texts: what sounds is heard, pictures and frames are described."""

    def describe():
        """A stand-in that names the pictures it got, and refuses posts of four, eight, ..."""

        def model(rows: pd.DataFrame) -> pd.DataFrame:
            said = [
                "Sorry, I cannot view the images." if (p.count("\n") + 1) % 4 == 0 else f" {q}: " + p.replace("\n", ", ")
                for p, q in zip(rows["paths"], rows["prompt"], strict=True)
            ]
            return pd.DataFrame({"text": said})

        return model

    def transcribe():
        """A stand-in that repeats the path, and fails on one kind of file."""

        def model(rows: pd.DataFrame) -> pd.DataFrame:
            for path in rows["path"]:
                if path.endswith(".webm"):
                    raise RuntimeError("cannot decode " + path)
            return pd.DataFrame({"text": "heard " + rows["path"], "language": "en", "duration_seconds": 1.0})

        return model

    template = f"Look.{answers.CACHE_BOUNDARY}{{{{image_count}}}} pictures"
    found = capture_media(I.media_files(spark, sf_dir), describe, transcribe, template)
    return found.select("content_id", "part_no", "text", "error")


@query
def full_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register all submissions, capture the pages, enrich, publish, and return the state."""

    def echo():
        """A deterministic stand-in model: everything follows from the prompt's length."""

        def model(rows: pd.DataFrame) -> pd.DataFrame:
            size = rows["prompt"].str.len()
            signal = (size % 4 == 0).map({True: "true", False: "false"})
            size = size.astype(str)
            head = '{"title": "Page ' + size + '", "summary": "' + size + ' chars", "high_signal": '
            return pd.DataFrame({"text": head + signal + ', "skill_candidate_reason": "r"}'})

        return model

    subs = I.submissions(spark, sf_dir)
    pages = table(spark, sf_dir, "pages")
    keyed = urls.assign_content_ids(urls.canonicalize_urls(pages))
    responses = keyed.groupBy("content_id").agg(F.min_by("html", "page_id").alias("html"))
    nothing = responses.select("content_id", F.col("html").alias("text")).limit(0)
    on_disk = spark.createDataFrame([], "folder STRING, note_name STRING, owner STRING")
    result = run_batch(
        subs,
        I.state(spark, sf_dir),
        responses,
        nothing,
        on_disk,
        Models(enrich=echo),
        PROMPTS,
        POLICY,
        AS_OF + timedelta(hours=1),
        scratch(spark, "batch"),
    )
    return shown_state(result.state)
