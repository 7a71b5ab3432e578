"""Registration, life cycle and the tables on disk."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from gleanery.operators import lifecycle, registry
from gleanery.policy import Policy
from gleanery.schemas import STATE, SUBMISSIONS, conform_state, parse
from gleanery.sources import files, storage
from gleanery.sources.keyed_log import KeyedLog

POLICY = Policy(allowed_domains=("youtube.com",), blocked_domains=("bad.com",))


def subs(spark, *urls):
    return spark.createDataFrame([(i, u, "webhook", None) for i, u in enumerate(urls)], SUBMISSIONS)


def empty(spark):
    return spark.createDataFrame([], parse(STATE))


def states(spark, *rows):
    """Rows (content_id, status, and any other columns)."""
    base = {f.name: None for f in parse(STATE)} | {"url": "u", "content_kind": "media", "attempt_count": 0}
    return spark.createDataFrame(
        [tuple((base | {"content_id": c, "status": s} | more)[f.name] for f in parse(STATE)) for c, s, more in rows], parse(STATE)
    )


def test_registration_and_its_repetition(spark, now):
    batch = subs(
        spark,
        "https://www.youtube.com/watch?v=1&si=x",
        "https://youtube.com/watch?v=1",
        "https://example.org/page",
        "https://bad.com/x",
        "not a url",
        "http://192.168.0.1/",
        "https://bad.com/x/",
    )
    first = registry.register_urls(batch, empty(spark), POLICY, now)
    rows = {r.url: r for r in first.rows.collect()}
    assert {(u, r.status, r.content_kind) for u, r in rows.items()} == {
        ("https://www.youtube.com/watch?v=1&si=x", "pending", "media"),
        ("https://example.org/page", "pending", "text"),
        ("https://bad.com/x", "blocked", "media"),
        ("not a url", "blocked", "media"),
        ("http://192.168.0.1/", "blocked", "media"),
    }
    assert rows["not a url"].content_id == "not a url" and rows["not a url"].normalized_url == ""
    assert first.attention.count() == 3
    again = registry.register_urls(batch, first.rows, POLICY, now)
    assert again.rows.count() == 0 and again.attention.count() == 0


def test_no_allow_list_lets_a_local_address_through_as_media(spark, now):
    row = registry.register_urls(subs(spark, "http://127.0.0.1/"), empty(spark), Policy(allowed_domains=()), now).rows.first()
    assert (row.status, row.content_kind) == ("pending", "media")


def test_failures_count_up_and_end(spark, now):
    state = states(
        spark,
        ("a", "pending", {}),
        ("b", "failed", {"attempt_count": 3, "error": "same"}),
        ("c", "failed", {"attempt_count": 4, "error": "same"}),
        ("d", "pending", {}),
    )
    failures = spark.createDataFrame([("a", "boom", "X()"), ("b", "same", "X()"), ("c", "same", "X()"), ("d", "", "Timeout()")], "content_id STRING, message STRING, error_repr STRING")
    out = lifecycle.apply_failures(state, failures, Policy(), now)
    got = {r.content_id: r for r in out.rows.collect()}
    wait = {c: (r.next_retry_at and r.next_retry_at - now.replace(tzinfo=None)) for c, r in got.items()}
    assert wait == {"a": timedelta(minutes=1), "b": timedelta(minutes=120), "c": None, "d": timedelta(minutes=1)}
    assert got["c"].status == "failed_permanent" and got["d"].error == "Timeout()"
    told = {r.reason for r in out.attention.collect()}
    assert told == {
        "processing failed: boom",
        "giving up after 5 attempts (permanent failure): same",
        "processing failed: Timeout()",
    }


def test_success_reset_and_upsert(spark, now):
    state = states(
        spark,
        ("a", "enriching", {"attempt_count": 2, "error": "x", "skill_path": "old"}),
        ("b", "failed_permanent", {"attempt_count": 5, "error": "x", "last_completed_stage": "transcribed"}),
        ("c", "done", {}),
    )
    notes = spark.createDataFrame([("a", "n.md")], "content_id STRING, note_path STRING")
    skills = spark.createDataFrame([("a", "s", "away")], "content_id STRING, skill_path STRING, skill_error STRING")
    won = lifecycle.apply_success(state, notes, skills, now)
    a = won.first()
    assert (a.status, a.note_path, a.skill_path, a.skill_error, a.error, a.attempt_count) == ("done", "n.md", None, "away", None, 0)
    back = lifecycle.reset_for_retry(state, None, now).collect()
    assert [(r.content_id, r.status, r.attempt_count, r.error, r.last_completed_stage) for r in back] == [("b", "pending", 0, None, "transcribed")]
    after = {r.content_id: r.status for r in registry.upsert_state(state, won, now).collect()}
    assert after == {"a": "done", "b": "failed_permanent", "c": "done"}


def test_due_answers_and_health(spark, now):
    later, earlier = now + timedelta(minutes=5), now - timedelta(minutes=5)
    state = states(
        spark,
        ("p", "pending", {}),
        ("w", "failed", {"next_retry_at": later, "error": "e"}),
        ("r", "failed", {"next_retry_at": earlier, "error": "e"}),
        ("x", "failed_permanent", {"error": "dead"}),
        ("d", "done", {"updated_at": earlier}),
        ("b", "blocked", {"error": "no"}),
    )
    assert {r.content_id for r in lifecycle.actionable_items(state, now).collect()} == {"p", "r"}
    answers = {r.content_id: r for r in registry.submission_responses(state.withColumn("seq", F.lit(1)), now).collect()}
    assert [c for c, r in answers.items() if r.should_run] == ["p", "r"]
    assert [c for c, r in answers.items() if not r.accepted] == ["x", "b"]
    assert answers["w"].reason == "still waiting on retry backoff until 2026-03-01T12:05:00+00:00 (last error: e)"
    health = lifecycle.state_health(state).first()
    assert (health.queue_depth, health.failed_count) == (3, 3)
    assert lifecycle.state_health(empty(spark)).first().last_success_at is None


def test_resume_falls_back_when_an_artifact_is_gone(spark):
    def stage(s, kind="media"):
        return {"last_completed_stage": s, "content_kind": kind}

    state = states(
        spark,
        ("e1", "failed", stage("enriched")),
        ("e2", "failed", stage("enriched")),
        ("t1", "failed", stage("transcribed")),
        ("t2", "failed", stage("transcribed")),
        ("t3", "failed", stage("transcribed", "text")),
        ("n", "pending", stage(None)),
        ("w", "done", stage("note_written")),
    )
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "content_id STRING")
    plan = lifecycle.plan_resume(state, ids("e1", "e2", "t1", "n"), ids("e1"), ids("t2", "n", "w"))
    assert {r.content_id: r.resume_at for r in plan.collect()} == {
        "e1": "write_note", "e2": "enrich", "t1": "enrich", "t2": "transcribe", "t3": "capture", "n": "download", "w": "download",
    }


def test_snapshots(spark, now, tmp_path):
    path = str(tmp_path / "state")
    assert storage.read_state(spark, path).count() == 0
    one = states(spark, ("a", "pending", {}))
    assert storage.write_state(one, path) == 1
    assert storage.write_state(registry.upsert_state(one, states(spark, ("b", "done", {})), now), path) == 2
    (tmp_path / "state" / "data" / "folder=base-3").mkdir()  # a writer that was lost
    assert {r.content_id for r in storage.read_state(spark, path).collect()} == {"a", "b"}
    storage.export_state_json(one, str(tmp_path / "doc"))
    back = storage.read_state_json(spark, str(tmp_path / "doc")).collect()
    assert [(r.content_id, r.status) for r in back] == [("a", "pending")]


def test_changes_write_only_what_changes(spark, now, tmp_path):
    """An upsert of 1 % adds about 1 % of the rows; reading gives what an upsert of the table gives."""
    path, table = str(tmp_path / "state"), states(spark, *((f"k{i}", "pending", {}) for i in range(2000)))
    storage.write_state(table, path)
    changes = states(spark, *((f"k{i * 100}", "done", {}) for i in range(20)), ("new", "failed", {}), ("new", "blocked", {"updated_at": now}))
    log = storage.state_log(spark, path)
    for again in range(2):  # the same batch delivered twice
        storage.write_state_changes(changes, path, now, run="r", batch=0)
        assert [(e.kind, e.rows) for e in log.manifest()[1] if e.kind != "gone"] == [("base", 2000), ("change", 21)]
    want = registry.upsert_state(table, changes, now)
    assert sorted(map(tuple, storage.read_state(spark, path).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_keyed_log_is_the_last_row_per_key(spark, tmp_path):
    """Random writes, replays, folds and lost manifests against a dictionary."""
    rng = random.Random(2)
    log = KeyedLog(spark, str(tmp_path / "log"), "k STRING, v INT", "k", buckets=3, most_changes=2, share=0.5)
    plain, runs, before = {}, {"a": 0, "b": 0}, {}
    assert log.read().collect() == []
    for step in range(9):
        run = rng.choice("ab")
        rows = [(f"k{i}", step * 100 + i) for i in rng.sample(range(9), rng.randrange(0, 5))]
        if step == 5:
            log.replace(spark.createDataFrame([(k, v) for k, v in plain.items()], log.schema))
        log.add(spark.createDataFrame(rows, log.schema), run, runs[run])
        before = dict(plain)
        plain.update(rows)
        assert {r.k: r.v for r in log.read(skip=(run, runs[run])).collect()} == before
        if step % 4 == 0:
            log.add(spark.createDataFrame(rows, log.schema), run, runs[run])
        runs[run] += 1
        log.compact(always=step == 7)
        got = [tuple(r) for r in log.read().collect()]
        assert dict(got) == plain and len(got) == len(plain)
        parts = [tuple(r) for b in range(3) for r in log.read(buckets=[b]).collect()]
        assert sorted(parts) == sorted(got)
    version = log.manifest()[0]
    slot = str(tmp_path / "log" / "manifest" / f"slot={version % 2}")
    spark.createDataFrame([], "version LONG").write.mode("overwrite").parquet(slot)  # a writer lost while it publishes
    assert log.manifest()[0] == version - 1 and log.read().count() > 0


def test_notes_are_added_by_path(spark, tmp_path):
    path = str(tmp_path / "notes")
    schema = "content_id STRING, note_path STRING, content STRING"
    assert files.read_notes_table(spark, path) is None
    files.write_notes(spark.createDataFrame([("a", "a.md", "1"), ("b", "b.md", "2"), ("b", "b.md", "3")], schema), path)
    files.write_notes(spark.createDataFrame([("c", "a.md", "4")], schema), path)
    assert {tuple(r) for r in files.read_notes_table(spark, path).collect()} == {("c", "a.md", "4"), ("b", "b.md", "3")}


def test_old_rows_get_defaults(spark, tmp_path):
    (tmp_path / "state.json").write_text(
        '{"items": {\n "k": {"content_id": "k", "url": "u", "normalized_url": "n", "source": "webhook", "status": "failed",\n'
        ' "added_at": "2026-01-01T00:00:00+00:00", "updated_at": "2026-01-01T00:00:00.5+00:00"}}}'
    )
    row = storage.read_state_json(spark, str(tmp_path / "state.json")).first()
    assert (row.content_kind, row.attempt_count, row.next_retry_at) == ("media", 0, None)
    assert storage.read_state_json(spark, str(tmp_path / "none.json")).count() == 0
    assert conform_state(spark.createDataFrame([("a",)], "content_id STRING")).first().content_kind == "media"


def test_inbox_keeps_file_order(spark, tmp_path):
    lines = [f"https://e.com/{i}" for i in range(50)]
    (tmp_path / "q.txt").write_text("# c\n\n" + "\n".join(lines) + "\n  \n")
    rows = files.read_submissions(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.url for r in rows] == lines
    assert files.remaining_inbox(spark, str(tmp_path)).count() == 3


def test_attention_retention(spark, now, tmp_path):
    rows = spark.createDataFrame([(now - timedelta(days=45), "u1", "r"), (now - timedelta(days=1), "u2", "r\tx")], "ts TIMESTAMP, url STRING, reason STRING")
    files.append_attention(rows, str(tmp_path / "log"))
    spark.createDataFrame([("broken line",)], "value STRING").write.mode("append").text(str(tmp_path / "log"))
    log = files.read_attention(spark, str(tmp_path / "log"))
    kept = lifecycle.prune_attention(log, now, 30)
    assert {r.line.split("\t")[-1] for r in kept.collect()} == {"x", "broken line"}
    assert lifecycle.pruned_count(log, now, 30).first().removed == 1
    assert lifecycle.prune_attention(log, now, 0).count() == 3


def test_media_listing_and_notes(spark, tmp_path):
    (tmp_path / "tmp" / "id1" / "deep").mkdir(parents=True)
    (tmp_path / "tmp" / "id1" / "deep" / "a.MP4").write_bytes(b"x")
    (tmp_path / "tmp" / "id2").mkdir()
    (tmp_path / "tmp" / "id2" / "b.jpg").write_bytes(b"y")
    got = {(r.content_id, r.suffix) for r in files.list_media(spark, str(tmp_path / "tmp")).collect()}
    assert got == {("id1", ".mp4"), ("id2", ".jpg")}
    (tmp_path / "vault").mkdir()
    (tmp_path / "vault" / "n.md").write_text('---\ntitle: "A"\ncontent_id: "id1"\n---\n\n# A')
    row = files.read_notes(spark, str(tmp_path / "vault")).first()
    assert (row.owner, row.title, row.note_path) == ("id1", "A", str(tmp_path / "vault" / "n.md"))


def test_unreadable_artifacts_are_missing(spark):
    rows = spark.createDataFrame([("a", '{"text": "x", "backend": "b"}'), ("b", "{cut"), ("c", "")], "content_id STRING, value STRING")
    assert [r.content_id for r in files.parse_artifacts(rows, "text STRING, backend STRING").collect()] == ["a"]


def test_the_last_of_several_changes_counts(spark, now):
    old = states(spark, ("a", "pending", {}))
    changes = states(spark, ("a", "failed", {}), ("a", "done", {}), ("b", "pending", {}))
    got = registry.upsert_state(old, changes, now, F.length("status")).collect()
    assert sorted((r.content_id, r.status) for r in got) == [("a", "failed"), ("b", "pending")]
