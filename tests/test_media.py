import random

import pytest

from gleanery.operators import media

FILES = "content_id STRING, path STRING, has_audio BOOLEAN, frame_path STRING"


def groups(spark, rows, **options):
    out = {}
    for r in media.group_media(spark.createDataFrame(rows, FILES), **options).orderBy("content_id", "pos").collect():
        out.setdefault(r.content_id, []).append((r.media_type, r.path, r.error))
    return out


ROWS = [
    ("over", "t/1.jpg", None, None),
    ("over", "t/2.mp4", True, None),
    ("over", "t/3.mp3", None, None),
    ("photos", "t/b.JPG", None, None),
    ("photos", "t/a.png", None, None),
    ("silent", "t/s.mp4", False, "t/s.frame.jpg"),
    ("mixed", "t/s.mp4", False, "t/s.frame.jpg"),
    ("mixed", "t/z.jpg", None, None),
    ("real", "t/s.mov", False, "t/s.frame.jpg"),
    ("real", "t/v.mov", None, None),
    ("none", "t/x.txt", None, None),
]
WANT = {
    "over": [("video", "t/3.mp3", None), ("video", "t/2.mp4", None)],
    "photos": [("image", "t/a.png", None), ("image", "t/b.JPG", None)],
    "silent": [("image", "t/s.frame.jpg", None)],
    "mixed": [("image", "t/z.jpg", None), ("image", "t/s.frame.jpg", None)],
    "real": [("video", "t/v.mov", None)],
    "none": [(None, None, media.NO_MEDIA)],
}


def test_grouping(spark):
    assert groups(spark, ROWS) == WANT
    assert groups(spark, ROWS, hot_rows=2) == WANT


def test_carousel(spark):
    files = spark.createDataFrame(ROWS, FILES)
    refs = spark.createDataFrame([("over", 1), ("photos", None), ("mixed", 9)], "content_id STRING, img_index INT")
    got = {(r.content_id, r.path) for r in media.select_carousel_item(files, refs).collect()}
    assert {p for c, p in got if c == "over"} == {"t/2.mp4"}
    assert {p for c, p in got if c == "photos"} == {"t/a.png", "t/b.JPG"}
    assert not {p for c, p in got if c == "mixed"}


CLIPS = "content_id STRING, clip_no LONG, text STRING, language STRING, backend STRING, duration_seconds DOUBLE"


def test_clips(spark):
    rows = [
        ("two", 0, "first", "", "b0", 0.0),
        ("two", 1, "second", "en", "b1", None),
        ("one", 5, "alone", "", "b", 0.0),
        ("timed", 0, "x", None, "b", 1.5),
        ("timed", 2, "y", None, "b", 2.0),
    ]
    got = {r.content_id: r for r in media.combine_clips(spark.createDataFrame(rows, CLIPS)).collect()}
    assert got["two"].text == "[Clip 1/2] first\n\n[Clip 2/2] second"
    assert (got["two"].language, got["two"].backend, got["two"].duration_seconds) == ("en", "b0", None)
    assert (got["one"].text, got["one"].duration_seconds) == ("alone", 0.0)
    assert got["timed"].duration_seconds == 3.5 and got["timed"].language is None


def test_long_item_comes_whole_in_parts(spark):
    rows = [("hot", i, f"text {i}", "en", "b", 1.0) for i in range(200)] + [("one", 0, "t", "en", "b", 1.0)]
    df = spark.createDataFrame(rows, CLIPS).repartition(4)
    whole = {r.content_id: r for r in media.combine_clips(df).collect()}
    parts = media.combine_clips(df, part_chars=300, hot_rows=20).orderBy("content_id", "part_no").collect()
    assert len(parts) > 10
    joined = "\n\n".join(r.text for r in parts if r.content_id == "hot")
    assert joined == whole["hot"].text
    assert {r.duration_seconds for r in parts if r.content_id == "hot"} == {200.0}


@pytest.mark.parametrize(("part_chars", "hot_rows"), [(8, 10_000), (64, 25), (10**9, 10_000)])
def test_segments_join_to_the_same_text_whatever_the_part_size(spark, part_chars, hot_rows):
    """Blank segments at a clip's ends go, those at a part's border stay."""
    rng = random.Random(part_chars)
    clips = {("c", n): [rng.choice(["", " ", "one", " two ", "\tthree four", "\u2003"]) for _ in range(rng.randrange(1, 40))] for n in range(20)}
    clips[("c", 20)], clips[("d", 0)] = ["", "  "], ["", "a", "", "", "b c", ""]
    rows = [(c, n, i, text) for (c, n), texts in clips.items() for i, text in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "content_id STRING, clip_no LONG, seg_no LONG, text STRING")
    got = {}
    for r in media.join_segments(df, part_chars, hot_rows).orderBy("content_id", "clip_no", "part_no").collect():
        got.setdefault((r.content_id, r.clip_no), []).append((r.text, r.empty))
    want = {k: " ".join(t.strip() for t in texts).strip() for k, texts in clips.items()}
    assert {k: " ".join(t for t, _ in parts) for k, parts in got.items()} == want
    assert all(empty == (want[k] == "") for k, parts in got.items() for _, empty in parts)
    assert (max(map(len, got.values())) > 1) == (part_chars < 1000)
