"""The whole batch and the streams."""

import json
import random
import sys
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleanery.operators.urls import assign_content_ids, canonicalize_urls
from gleanery.plans.batch import Fetched, Models, plan_housekeeping, run_batch
from gleanery.policy import Policy
from gleanery.schemas import STATE, SUBMISSIONS, parse
from gleanery.sources import storage
from gleanery.streaming import jobs

# Workers cannot import test modules, so their functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE = "<html><body><article><p>" + "useful words " * 20 + "</p></article></body></html>"
PROMPTS = {"text": "{{transcript}}", "media": "{{transcript}}", "skill": "{{title}}", "image": "{{image_count}} pictures"}


def enrich():
    def model(rows):
        if rows["prompt"].str.contains("explode").any():
            raise RuntimeError("model away")
        return pd.DataFrame({"text": ['{"title": "Same", "summary": "s", "high_signal": true, "skill_candidate_reason": "r"}'] * len(rows)})

    return model


def skill():
    def model(rows):
        return pd.DataFrame({"text": ["skill of " + p for p in rows["prompt"]]})

    return model


def run(spark, urls, state, pages, clips, now, folder, models=None, notes=(), **earlier):
    subs = spark.createDataFrame([(i, u, "webhook", None) for i, u in enumerate(urls)], SUBMISSIONS)

    def keyed(pairs, name):
        df = spark.createDataFrame(pairs, f"url STRING, {name} STRING")
        return assign_content_ids(canonicalize_urls(df)).select("content_id", name)

    disk = spark.createDataFrame(list(notes), "folder STRING, note_name STRING, owner STRING")
    return run_batch(
        subs, state, keyed(pages, "html"), keyed(clips, "text"), disk, models or Models(enrich, skill), PROMPTS, Policy(), now, folder, **earlier
    )


def test_batch_end_to_end_and_again(spark, now, tmp_path):
    urls = ["https://a.org/1", "https://a.org/2", "https://a.org/shell", "https://a.org/gone", "https://youtu.be/v", "bad url", "https://a.org/x"]
    pages = [(urls[0], PAGE), (urls[1], PAGE), (urls[2], "<body></body>"), (urls[6], PAGE.replace("useful", "explode"))]
    empty = spark.createDataFrame([], parse(STATE))
    first = run(spark, urls, empty, pages, [(urls[4], "spoken")], now, str(tmp_path / "one"))
    state = {r.url: r for r in first.state.collect()}
    assert {u: r.status for u, r in state.items()} == {
        urls[0]: "done", urls[1]: "done", urls[2]: "failed", urls[3]: "failed", urls[4]: "done", urls[5]: "blocked", urls[6]: "failed",
    }
    assert sorted(r.note_path for r in first.notes.collect()) == ["same-2.md", "same-3.md", "same.md"]
    assert state[urls[6]].last_completed_stage == "transcribed" and state[urls[2]].last_completed_stage is None
    assert state[urls[6]].error == "model away" and state[urls[2]].error == "page needs rendering"
    assert tuple(first.summary.first())[:3] == (6, 3, 3)
    assert first.skills.filter("skill_path = 'same/SKILL.md'").count() == 3
    assert first.attention.count() == 4
    assert first.outputs.filter("kind = 'error'").count() == 3
    second = run(spark, urls, first.state, pages, [(urls[4], "spoken")], now, str(tmp_path / "two"))
    assert second.summary.first().processed == 0
    assert sorted(map(tuple, second.state.collect()), key=str) == sorted(map(tuple, first.state.collect()), key=str)
    third = run(spark, [], first.state, [(urls[3], PAGE)], [], now + timedelta(minutes=2), str(tmp_path / "three"))
    assert {r.url: r.status for r in third.state.collect()}[urls[3]] == "done"

    # The capture of the first run is used again; nothing is fetched this time.
    def calm():
        return lambda rows: pd.DataFrame({"text": ['{"title": "Calm", "summary": "s"}'] * len(rows)})

    kept = spark.read.parquet(str(tmp_path / "one" / "captures")).filter("error IS NULL").select("content_id", "text")
    later = now + timedelta(minutes=2)
    fourth = run(spark, [], first.state, [], [], later, str(tmp_path / "four"), Models(calm), earlier_captures=kept)
    again = {r.url: r for r in fourth.state.collect()}
    assert again[urls[6]].status == "done" and again[urls[6]].note_path == "calm.md"
    assert again[urls[3]].status == "failed" and again[urls[3]].attempt_count == 2


def test_each_source_is_captured_in_its_own_way(spark, now, tmp_path):
    page = "11111111222233334444555555555555"
    dashed = "11111111-2222-3333-4444-555555555555"
    urls = {
        "repo": "https://github.com/o/r", "blocks": f"https://team.notion.site/T-{page}", "file": "https://drive.google.com/file/d/f1/view",
        "shell": "https://a.org/shell", "away": "https://a.org/away", "clips": "https://youtu.be/v",
    }
    ids = {r.name: r.content_id for r in assign_content_ids(canonicalize_urls(spark.createDataFrame(list(urls.items()), "name STRING, url STRING"))).collect()}

    def rows(column, **values):
        return spark.createDataFrame([(ids[k], v) for k, v in values.items()], f"content_id STRING, {column}")

    block = {"value": {"id": dashed, "type": "page", "properties": {"title": [["Block title"]]}, "content": []}}
    for _ in range(12):
        block = {"value": block}
    given = Fetched(
        rendered=rows("html STRING", shell=PAGE),
        repo_meta=rows("payload STRING", repo=json.dumps({"stargazers_count": 3, "description": "about"})),
        repo_contents=rows("payload STRING", repo=json.dumps({"content": "readme text"})),
        blocks=rows("payload STRING", blocks=json.dumps({"recordMap": {"block": {dashed: block}}})),
        files=rows("body BINARY", file=b"plain file text"),
        clips=spark.createDataFrame([(ids["clips"], i, f"clip {i}", "en", "b", 1.0) for i in (2, 1)], "content_id STRING, clip_no INT, text STRING, language STRING, backend STRING, duration_seconds DOUBLE"),
        outcomes=spark.createDataFrame([(ids["away"], "html", 500, {"a": "b"})], "content_id STRING, source_type STRING, status INT, headers MAP<STRING, STRING>"),
    )
    empty = spark.createDataFrame([], parse(STATE))
    pages = [(urls["shell"], "<body></body>"), (urls["away"], PAGE), (urls["shell"], "")]
    out = run(spark, list(urls.values()), empty, pages, [], now, str(tmp_path / "b"), fetched=given)
    state = {r.url: r for r in out.state.collect()}
    assert {k: state[u].status for k, u in urls.items()} == {k: "failed" if k == "away" else "done" for k in urls}
    assert "500" in state[urls["away"]].error
    text = {r.content_id: r.text for r in spark.read.parquet(str(tmp_path / "b" / "captures")).collect()}
    assert "readme text" in text[ids["repo"]] and "Block title" in text[ids["blocks"]] and text[ids["file"]] == "plain file text"
    assert "useful words" in text[ids["shell"]] and text[ids["clips"]] == "[Clip 1/2] clip 1\n\n[Clip 2/2] clip 2"
    moved = out.state.withColumn("note_path", F.concat(F.lit("new-"), "note_path"))
    files = spark.createDataFrame([(ids["repo"], "old.json", now - timedelta(days=40))], "content_id STRING, path STRING, modified_at TIMESTAMP")
    plan = plan_housekeeping(out.state, moved, files, out.attention, now, 30)
    assert plan.stale.filter("kind = 'note'").count() == 5 and plan.orphans.count() == 1
    assert plan.attention.count() == out.attention.count()


def test_media_items_are_heard_or_described(spark, now, tmp_path):
    """Carousel, clips, a silent video's frame, a refusal, no usable file; stages are marked on the way."""
    root = str(tmp_path)
    urls = {
        "photo": "https://www.instagram.com/p/a/?img_index=1", "film": "https://youtu.be/f", "silent": "https://youtu.be/s",
        "refused": "https://www.instagram.com/p/b/", "none": "https://youtu.be/n", "told": "https://youtu.be/t",
    }
    ids = {r.name: r.content_id for r in assign_content_ids(canonicalize_urls(spark.createDataFrame(list(urls.items()), "name STRING, url STRING"))).collect()}
    files = [
        ("photo", "t/1.jpg", None, None), ("photo", "t/2.jpg", None, None), ("film", "t/b.mp3", None, None), ("film", "t/a.mp3", None, None),
        ("silent", "t/c.mp4", False, "t/c.frame.jpg"), ("refused", "t/r.png", None, None), ("none", "t/x.txt", None, None), ("told", "t/u.mp3", None, None),
    ]
    given = Fetched(media=spark.createDataFrame([(ids[n], *rest) for n, *rest in files], "content_id STRING, path STRING, has_audio BOOLEAN, frame_path STRING"))

    def describe():
        def model(rows):
            return pd.DataFrame({"text": ["Sorry, I cannot view the images" if "r.png" in p else f"{q}: {p} " for p, q in zip(rows["paths"], rows["prompt"], strict=True)]})

        return model

    def transcribe():
        return lambda rows: pd.DataFrame({"text": "heard " + rows["path"], "language": "en", "duration_seconds": 1.0})

    def mark(rows):
        return storage.write_state_changes(rows, f"{root}/state", now, run="marks")

    empty = spark.createDataFrame([], parse(STATE))
    out = run(
        spark, list(urls.values()), empty, [], [(urls["told"], "given")], now, f"{root}/b", Models(enrich, describe=describe, transcribe=transcribe), fetched=given, on_stage=mark
    )
    state = {r.url: r for r in out.state.collect()}
    assert {n for n, u in urls.items() if state[u].status == "done"} == {"photo", "film", "silent", "told"}
    assert state[urls["refused"]].error.startswith("the vision model refused") and state[urls["none"]].error == "no video or image files"
    text = {r.content_id: r.text for r in spark.read.parquet(f"{root}/b/captures").collect()}
    assert {n: text[ids[n]] for n in ("photo", "film", "silent", "told")} == {
        "photo": "1 pictures: t/2.jpg", "film": "[Clip 1/2] heard t/a.mp3\n\n[Clip 2/2] heard t/b.mp3", "silent": "1 pictures: t/c.frame.jpg", "told": "given",
    }
    marked = {r.content_id: r.last_completed_stage for r in storage.read_state(spark, f"{root}/state").collect()}
    assert marked == {ids[n]: "note_written" for n in ("photo", "film", "silent", "told")}


def test_a_failed_skill_leaves_the_note_done(spark, now, tmp_path):
    def away():
        def model(rows):
            raise ValueError("no skill today")

        return model

    empty = spark.createDataFrame([], parse(STATE))
    out = run(spark, ["https://a.org/1"], empty, [("https://a.org/1", PAGE)], [], now, str(tmp_path / "b"), Models(enrich, away))
    row = out.state.first()
    assert (row.status, row.skill_path, row.skill_error) == ("done", None, "no skill today")


def test_stream_registers_each_key_once_even_when_redelivered(spark, now, tmp_path):
    root = str(tmp_path)
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"seq": 1, "url": "https://a.org/1"}\n{"seq": 2, "url": "nope"}\n')
    stream = spark.readStream.schema("seq LONG, url STRING, submitted_at TIMESTAMP").json(str(inbox)).withColumn("source", F.lit("webhook"))

    def go(checkpoint):
        writer = jobs.stream_register(stream, f"{root}/state", f"{root}/added", f"{root}/attention", Policy(), now)
        jobs.drain(writer.option("checkpointLocation", f"{root}/{checkpoint}"), spark)
        return storage.read_state(spark, f"{root}/added"), storage.read_batches(spark, f"{root}/attention")

    added, attention = go("ck")
    assert added.count() == 2 and attention.count() == 1
    (inbox / "2.json").write_text('{"seq": 3, "url": "https://www.a.org/1/"}\n{"seq": 4, "url": "https://a.org/2"}\n')
    added, _ = go("ck")
    assert added.count() == 3
    added, _ = go("fresh-ck")  # everything delivered again as batch 0
    assert added.select("content_id").distinct().count() == 3


def test_a_new_checkpoint_overwrites_nothing(spark, now, tmp_path):
    root = str(tmp_path)
    for n in (1, 2):
        (tmp_path / f"in{n}").mkdir()
        (tmp_path / f"in{n}" / "1.json").write_text(f'{{"seq": {n}, "url": "https://a.org/{n}"}}\n')
        stream = spark.readStream.schema("seq LONG, url STRING, submitted_at TIMESTAMP").json(f"{root}/in{n}").withColumn("source", F.lit("webhook"))
        writer = jobs.stream_register(stream, f"{root}/state", f"{root}/added", f"{root}/attention", Policy(), now)
        jobs.drain(writer.option("checkpointLocation", f"{root}/ck{n}"), spark)
    assert {r.url for r in storage.read_state(spark, f"{root}/added").collect()} == {"https://a.org/1", "https://a.org/2"}


ATTEMPTS = "content_id STRING, attempt_id LONG, attempt_ts TIMESTAMP, kind STRING, ok BOOLEAN, error STRING"
BEGIN = datetime(2026, 1, 1)


def attempt_log(seed):
    """Items of few and one of very many attempts, successes, resets; a third of the rows is one item's."""
    rng = random.Random(seed)
    rows = []
    for i in range(240):
        item = "hot" if i % 3 == 0 else f"i{rng.randrange(12)}"
        kind = "reset" if rng.random() < 0.06 else "attempt"
        ok = rng.random() < 0.15
        rows.append((item, i, BEGIN + timedelta(seconds=40 * i + rng.randrange(40)), kind, ok, None if ok else f"e{i % 5}"))
    return rows + [(None, None, BEGIN + timedelta(hours=40), "clock", None, None)]


def plain_events(rows, policy):
    """One item after the other, row after row."""
    events, until = [], max(r[2] for r in rows)
    for item in {r[0] for r in rows if r[3] != "clock"}:
        count, due, error, dead = 0, None, None, False
        for _, _, at, kind, ok, said in sorted((r for r in rows if r[0] == item), key=lambda r: (r[2], r[1])):
            if dead and kind != "reset":
                continue
            if due is not None and due <= at:
                events.append((item, "retry", count, due, error))
            due = None
            if kind == "reset" or ok:
                count, dead = 0, False
                continue
            count, error = count + 1, said
            if count >= policy.max_attempts:
                dead = True
                events.append((item, "gave_up", count, at, error))
            else:
                due = at + timedelta(minutes=policy.backoff_minutes[min(count, len(policy.backoff_minutes)) - 1])
        if due is not None and due <= until:
            events.append((item, "retry", count, due, error))
    return sorted(events)


def retry_events(spark, root, rows, cuts, policy, hot_rows):
    """The log given in so many parts, each run until it is drained."""
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        spark.createDataFrame(rows[lo:hi][::-1], ATTEMPTS).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(ATTEMPTS).parquet(f"{root}/in")
        writer = jobs.stream_retries(stream, policy, f"{root}/retries", hot_rows)
        jobs.drain(writer.option("checkpointLocation", f"{root}/ck"), spark)
    found = storage.read_batches(spark, f"{root}/retries/events")
    return sorted((r.content_id, r.event, r.attempt_count, r.at, r.error) for r in found.collect())


@pytest.mark.parametrize(("cuts", "hot_rows"), [((), 10_000), ((), 20), ((50, 51, 200), 10_000), ((120, 240), 30)])
def test_retries_are_the_same_in_one_batch_or_many(spark, tmp_path, cuts, hot_rows):
    policy = Policy(max_attempts=4, backoff_minutes=(1, 3, 10))
    rows = attempt_log(5)
    want = plain_events(rows, policy)
    assert {e[1] for e in want} == {"retry", "gave_up"} and len(want) > 40
    assert retry_events(spark, str(tmp_path), rows, cuts, policy, hot_rows) == want


def test_a_retry_batch_delivered_again_changes_nothing(spark, tmp_path):
    policy = Policy(max_attempts=4, backoff_minutes=(1, 3, 10))
    rows, root = attempt_log(6), str(tmp_path)
    first = retry_events(spark, root, rows, (100,), policy, 10_000)
    # The second batch's commit is lost, so it comes again.
    (tmp_path / "ck" / "commits" / "1").unlink()
    (tmp_path / "ck" / "commits" / ".1.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(ATTEMPTS).parquet(f"{root}/in")
    jobs.drain(jobs.stream_retries(stream, policy, f"{root}/retries").option("checkpointLocation", f"{root}/ck"), spark)
    found = storage.read_batches(spark, f"{root}/retries/events").collect()
    assert sorted((r.content_id, r.event, r.attempt_count, r.at, r.error) for r in found) == first == plain_events(rows, policy)


def test_registration_costs_the_same_over_many_batches(spark, now, tmp_path):
    """Eleven batches: few folders stay live, a batch opens its own buckets only, nothing is lost."""
    root = str(tmp_path)
    for n in range(11):
        rows = [(2 * n + i, f"https://a.org/{max(0, 2 * n + i - 1)}") for i in range(2)]
        spark.createDataFrame(rows, "seq LONG, url STRING").coalesce(1).write.mode("append").json(f"{root}/in")
    writer = jobs.stream_register(stream_of_files(spark, f"{root}/in"), f"{root}/state", f"{root}/added", f"{root}/attention", Policy(), now)
    jobs.drain(writer.option("checkpointLocation", f"{root}/ck"), spark)
    log = storage.state_log(spark, f"{root}/added")
    entries = log.manifest()[1]
    assert len([e for e in entries if e.kind != "gone"]) <= log.most_changes + 3
    got = [r.url for r in log.read().collect()]
    assert sorted(got) == sorted({f"https://a.org/{i}" for i in range(21)})
    (bucket,) = log.touched(log.read().limit(1))
    plan = log.read(buckets=[bucket])._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("PartitionFilters: [bucket" in line or "PartitionFilters: [isnotnull(bucket" in line for line in scans)


def stream_of_files(spark, folder):
    reader = spark.readStream.schema("seq LONG, url STRING, submitted_at TIMESTAMP").option("maxFilesPerTrigger", 1)
    return reader.json(folder).withColumn("source", F.lit("webhook"))


def test_health_follows_a_change_feed(spark, now, tmp_path):
    root = str(tmp_path)
    feed = "content_id STRING, old_status STRING, new_status STRING, changed_at TIMESTAMP"
    day = timedelta(days=1)
    batches = [
        [("a", None, "pending", now), ("b", None, "failed", now), ("c", None, "done", now), ("d", None, "blocked", now)],
        [("a", "pending", "done", now + day), ("b", "failed", "failed_permanent", now + day)],
        [("b", "failed_permanent", "pending", now + 2 * day), ("a", "done", "pending", now + 2 * day), ("e", None, None, now)],
    ]
    want = [(2, 1, now), (0, 1, now + day), (2, 0, now + day)]
    for rows, (depth, failed, success) in zip(batches, want, strict=True):
        spark.createDataFrame(rows, feed).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(feed).parquet(f"{root}/in")
        jobs.drain(jobs.stream_health(stream, f"{root}/out").option("checkpointLocation", f"{root}/ck"), spark)
        last = max(storage.read_batches(spark, f"{root}/out").collect(), key=lambda r: r.batch)
        assert (last.status, last.queue_depth, last.failed_count, last.last_success_at) == ("ok", depth, failed, success.replace(tzinfo=None))
