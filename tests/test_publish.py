"""Names, notes and renames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleanery.operators import publish
from gleanery.policy import Policy
from gleanery.sources import files
from gleanery.sources.files import parse_notes
from gleanery.streaming import jobs


def slug(title):
    s = re.sub("[^a-z0-9]+", "-", title.lower()).strip("-")
    return s[:60].rstrip("-") or "untitled"


def depth(s):
    return len(re.search(r"((?:-(?:[2-9]|[1-9][0-9]+))*)$", s).group(1).split("-")) - 1


def name_one_by_one(items, notes):
    """Hand out names in sequence: the first candidate that is free or already one's own."""
    owners = {(f, n): o for f, n, o in notes if o is not None}

    def own_number(folder, s, cid):
        numbers = []
        for (f, n), o in owners.items():
            m = re.fullmatch(re.escape(s) + r"(?:-([2-9]|[1-9][0-9]+))?\.md", n)
            if f == folder and o == cid and m:
                numbers.append(int(m.group(1) or 1))
        return min(numbers, default=None)

    def turn(item):
        cid, title, added, folder = item
        own = own_number(folder, slug(title), cid)
        return (depth(slug(title)), folder, slug(title), own is None, own or 0, added, cid)

    out = {}
    for cid, title, _added, folder in sorted(items, key=turn):
        s, k = slug(title), 1
        while True:
            name = f"{s}.md" if k == 1 else f"{s}-{k}.md"
            if owners.get((folder, name)) in (None, cid):
                break
            k += 1
        owners[(folder, name)] = cid
        out[cid] = name
    return out


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("hot_rows", [10_000, 15])
def test_names_equal_one_by_one(spark, seed, hot_rows):
    rng = random.Random(seed)
    titles = ["A", "A 2", "a-2", "A 3", "A 2 2", "***", "B", "B 02", "Hot", "Hot", "Hot", "Hot 5", "x" * 70]
    items = [(f"c{i:03d}", rng.choice(titles), rng.randint(0, 30), rng.choice(["", "d/"])) for i in range(90)]
    notes = {}
    for s in ("a", "a-2", "a-3", "a-2-2", "untitled", "hot", "hot-2", "hot-4", "hot-7", "hot-9", "b", "hot-5-2"):
        for folder in ("", "d/"):
            if rng.random() < 0.7:
                owner = rng.choice([None, "other", *(i[0] for i in items if slug(i[1]) == re.sub(r"-\d+$", "", s))])
                notes[(folder, f"{s}.md")] = owner
    notes = [(f, n, o) for (f, n), o in notes.items()]
    i_df = spark.createDataFrame(items, "content_id STRING, title STRING, added_at LONG, folder STRING")
    n_df = spark.createDataFrame(notes, "folder STRING, note_name STRING, owner STRING")
    got = {r.content_id: r.note_name for r in publish.assign_note_names(i_df, n_df, hot_rows).collect()}
    assert got == name_one_by_one(items, notes)
    placed = [(r[3], got[r[0]]) for r in items]
    assert len(set(placed)) == len(placed)


def test_slugs(spark):
    df = spark.createDataFrame([("Hello, World!",), ("***",), ("x" * 59 + " yz",), ("É b",)], "title STRING")
    assert [r.slug for r in publish.slugify_titles(df).collect()] == ["hello-world", "untitled", "x" * 59, "b"]


def test_note_round_trip(spark, now):
    row = ("id1", "https://e/x", now, 'A "b": c', "Sum", ["t"], [], ["k"], True, "why", "body")
    cols = (
        "content_id STRING, source_url STRING, created_at TIMESTAMP, title STRING, summary STRING, tags ARRAY<STRING>, "
        "tools_mentioned ARRAY<STRING>, key_takeaways ARRAY<STRING>, high_signal BOOLEAN, skill_candidate_reason STRING, text STRING"
    )
    note = publish.render_notes(spark.createDataFrame([row], cols))
    text = note.first().content
    keys = [line.split(":")[0] for line in text.split("---\n")[1].strip().splitlines()]
    assert keys == ["title", "source_url", "content_id", "created_at", "tags", "tools_mentioned", "high_signal"]
    assert "## Tools Mentioned\n- (none mentioned)\n\n## Skill Candidate\nwhy\n\n## Transcript\n\nbody\n" in text
    import yaml

    assert yaml.safe_load(text.split("---\n")[1])["title"] == 'A "b": c'
    back = parse_notes(note).first()
    assert (back.owner, back.title) == ("id1", 'A "b": c')
    yaml_style = spark.createDataFrame([("---\ntitle: plain\ncontent_id: abc\n---\nx",), ("no block",)], "content STRING")
    assert [(r.owner, r.title) for r in parse_notes(yaml_style).collect()] == [("abc", "plain"), (None, None)]


def test_skill_gates(spark):
    rows = [("a", True, "r"), ("b", False, "r"), ("c", True, ""), ("d", True, None)]
    df = spark.createDataFrame(rows, "title STRING, high_signal BOOLEAN, skill_candidate_reason STRING")
    assert [r.skill_path for r in publish.skill_candidates(df, Policy()).collect()] == ["a/SKILL.md"]
    assert publish.skill_candidates(df, Policy(skills_enabled=False)).count() == 0


def test_organizer_renames_skips_and_settles(spark):
    state = spark.createDataFrame(
        [("id1", "done", "v/x/old.md", 1), ("id2", "done", "v/x/fine.md", 2), ("id3", "done", "v/y/z.md", 3), ("id4", "failed", "v/q.md", 4), ("id5", "done", "v/x/5.md", 5)],
        "content_id STRING, status STRING, note_path STRING, added_at LONG",
    )
    notes = spark.createDataFrame(
        [("v/x/old.md", "id1", "Fine"), ("v/x/fine.md", "id2", "Fine"), ("v/y/z.md", "someone", "Z"), ("v/q.md", "id4", "Q"), ("v/x/5.md", None, None)],
        "note_path STRING, owner STRING, title STRING",
    )
    plan = {r.content_id: r for r in publish.organize_notes(state, notes).collect()}
    assert plan["id1"].new_path == "v/x/fine-2.md"
    assert plan["id3"].change.startswith("skipped v/y/z.md: frontmatter content_id 'someone'")
    assert set(plan) == {"id1", "id3"}
    moved = {"v/x/old.md": "v/x/fine-2.md"}
    rename = F.create_map(*(F.lit(x) for p in moved.items() for x in p))
    again = publish.organize_notes(
        state.withColumn("note_path", F.coalesce(rename[F.col("note_path")], "note_path")),
        notes.withColumn("note_path", F.coalesce(rename[F.col("note_path")], "note_path")),
    )
    assert {r.content_id for r in again.collect()} == {"id3"}


def test_notes_replace_their_own_path_only(spark, tmp_path):
    schema = "content_id STRING, note_path STRING, content STRING"
    path = str(tmp_path / "notes")
    assert files.read_notes_table(spark, path) is None
    assert files.write_notes(spark.createDataFrame([("a", "a.md", "one"), ("b", "b.md", "two")], schema), path) == 1
    assert files.write_notes(spark.createDataFrame([("b", "b.md", "new"), ("c", "c.md", "x"), ("c", "c.md", "y")], schema), path) == 2
    got = {r.note_path: r.content for r in files.read_notes_table(spark, path).collect()}
    assert got == {"a.md": "one", "b.md": "new", "c.md": "y"}


def test_bare_events_take_place_and_time_from_their_file(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"url": "https://a.org/1"}\n{"url": "https://a.org/2", "seq": 7}\n')
    writer = files.stream_submissions(spark, str(inbox)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    jobs.drain(writer.option("checkpointLocation", str(tmp_path / "ck")), spark)
    rows = {r.url: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows["https://a.org/1"].seq == 0 and rows["https://a.org/2"].seq == 7
    assert all(r.submitted_at is not None and r.source == "webhook" for r in rows.values())
