"""Downloaded files and clip transcripts, grouped per item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import filled, strip
from gleanery.operators.gather import PART_CHARS, fits, gather_text
from gleanery.operators.lookup import lookup
from gleanery.operators.ordered import HOT_ROWS, order_rows, running

# File suffixes.
AUDIO_SUFFIXES = (".mp3", ".m4a", ".wav")
VIDEO_SUFFIXES = (".mp4", ".mov", ".webm", ".mkv")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
NO_MEDIA = "no video or image files"
# Sorts after the ranks of all files that can be used.
USELESS = 9


def _suffix() -> Column:
    return F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))


def _has_audio() -> Column:
    """A probe that could not answer counts as sound."""
    return F.coalesce("has_audio", F.lit(True))


def split_silent_video(media: DataFrame) -> DataFrame:
    """Video containers without an audio stream; there is nothing in them to transcribe."""
    return media.filter(_suffix().isin(*VIDEO_SUFFIXES) & ~_has_audio())


def group_media(media: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per item the files to use, as rows (content_id, media_type, pos, path, error).

    With any file that has sound: audio files, then sounding videos. Otherwise images, then
    the frames of silent videos. An item with neither gives one row with an error.
    """
    suffix = _suffix()
    rank = (
        F.when(suffix.isin(*AUDIO_SUFFIXES), 0)
        .when(suffix.isin(*VIDEO_SUFFIXES) & _has_audio(), 1)
        .when(suffix.isin(*IMAGE_SUFFIXES), 2)
        .when(suffix.isin(*VIDEO_SUFFIXES) & F.col("frame_path").isNotNull(), 3)
        .otherwise(USELESS)
    )
    ranked = media.select("content_id", "path", "frame_path", rank.alias("_rank"))
    # In order of rank an item's first file tells what the item is, and the files to use come first.
    rows = order_rows(ranked, ["content_id"], ["_rank", "path"], hot_rows)
    placed = running(rows, sums={"pos": F.lit(1)}, maxs={"_least": -F.col("_rank")}).rows()
    best, rank = -F.col("_least"), F.col("_rank")
    sounding, none = best <= 1, best == USELESS
    used = F.when(none, F.col("pos") == 1).when(sounding, rank <= 1).otherwise(rank < USELESS)
    file = F.when(rank == 3, F.col("frame_path")).otherwise(F.col("path"))
    return placed.filter(used).select(
        "content_id",
        F.when(~none, F.when(sounding, "video").otherwise("image")).alias("media_type"),
        F.when(none, 0).otherwise(F.col("pos")).cast("long").alias("pos"),
        F.when(~none, file).alias("path"),
        F.when(none, NO_MEDIA).alias("error"),
    )


def append_frames(images: DataFrame, silent: DataFrame) -> DataFrame:
    """Images first, then the frames of silent videos, as one ordered table."""
    frames = silent.filter("frame_path IS NOT NULL").select(
        "content_id", F.lit(1).alias("part"), F.col("frame_path").alias("path")
    )
    return images.select("content_id", F.lit(0).alias("part"), "path").unionByName(frames)


def select_carousel_item(media: DataFrame, refs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keep file n+1 (by path) where the URL's index is n, all files where it names none.

    ``refs`` is (content_id, img_index), one row per item.
    """
    rows = order_rows(media, ["content_id"], ["path"], hot_rows)
    numbered = running(rows, sums={"item_no": F.lit(1)}).rows()
    indexed = lookup(numbered, refs, ["content_id"], ["path"], "left", hot_rows)
    index = F.col("img_index")
    return indexed.filter(index.isNull() | (F.col("item_no") == index + 1)).drop("img_index")


def join_segments(segments: DataFrame, part_chars: int = PART_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Segment texts of a clip joined by one space; ``empty`` marks a clip without words.

    Only the two ends of a clip are stripped: segments without words before its first and after
    its last word go, those between stay. A clip longer than ``part_chars`` comes as
    several rows (``part_no``) that give the whole text when joined by one space.
    """
    clip = ["content_id", "clip_no"]
    clean = segments.withColumn("text", strip(F.col("text")))
    worded = F.when(F.col("text") != "", F.col("seg_no"))
    ends = clean.groupBy(*clip).agg(F.min(worded).alias("_first"), F.max(worded).alias("_last"))
    inside = lookup(clean, ends, clip, ["seg_no"], "inner", hot_rows).filter(F.col("seg_no").between(F.col("_first"), F.col("_last")))
    parts = gather_text(inside.select(*clip, "seg_no", "text"), clip, ["seg_no"], "text", " ", part_chars, hot_rows)
    silent = ends.filter("_first IS NULL").select(*clip, F.lit(0).cast("long").alias("part_no"), F.lit("").alias("text"))
    said = parts.withColumn("empty", F.lit(False)).select(*clip, "part_no", "text", "empty")
    return said.unionByName(silent.withColumn("empty", F.lit(True)))


def combine_clips(
    clips: DataFrame, part_chars: int = PART_CHARS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One capture per item: its only clip as is, or all clips labelled and in order.

    An item longer than ``part_chars`` comes as several rows (``part_no``) that give the
    whole text when joined by a blank line.
    """
    alone = F.count("*") == 1
    seconds = F.sum(F.coalesce("duration_seconds", F.lit(0.0)))
    spoken = F.when(filled(F.col("language")), F.col("clip_no"))
    facts = {
        "duration_seconds": F.when(alone, F.max("duration_seconds")).otherwise(
            F.nullif(seconds, F.lit(0.0))
        ),
        "language": F.when(alone, F.max("language")).otherwise(F.min_by("language", spoken)),
        "backend": F.min_by("backend", "clip_no"),
    }
    named = [c.alias(n) for n, c in facts.items()]
    if fits(clips, ["content_id"], F.length("text") + 20, part_chars):
        ordered = F.array_sort(F.collect_list(F.struct("clip_no", "text")))
        grouped = clips.groupBy("content_id").agg(ordered.alias("_clips"), *named)
        several = F.array_join(
            F.transform(
                "_clips",
                lambda c, i: _labelled(i + 1, F.size("_clips"), c["text"]),
            ),
            "\n\n",
        )
        text = F.when(F.size("_clips") == 1, F.col("_clips")[0]["text"]).otherwise(several)
        return grouped.select(
            "content_id", F.lit(0).cast("long").alias("part_no"), text.alias("text"), *facts
        )
    totals = clips.groupBy("content_id").agg(F.count("*").alias("_n"), *named)
    rows = order_rows(clips.select("content_id", "clip_no", "text"), ["content_id"], ["clip_no"], hot_rows)
    numbered = running(rows, sums={"_i": F.lit(1)}).rows()
    counted = lookup(
        numbered, totals.select("content_id", "_n"), ["content_id"], ["clip_no"], "inner", hot_rows
    )
    label = F.when(F.col("_n") == 1, F.col("text")).otherwise(
        _labelled(F.col("_i"), F.col("_n"), F.col("text"))
    )
    lines = counted.withColumn("text", label)
    parts = gather_text(lines, ["content_id"], ["clip_no"], "text", "\n\n", part_chars, hot_rows)
    return parts.join(totals.drop("_n"), "content_id").select(
        "content_id", "part_no", "text", *facts
    )


def _labelled(i: Column, n: Column, text: Column) -> Column:
    return F.concat(F.lit("[Clip "), i.cast("string"), F.lit("/"), n.cast("string"), F.lit("] "), text)
