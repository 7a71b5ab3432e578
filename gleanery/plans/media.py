"""Captures of downloaded media: sounding files are transcribed, pictures and frames described."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.durable import durable
from gleanery.functions.text import strip
from gleanery.operators.answers import BatchFunction, apply_model, flag_refusals, render_image_prompts
from gleanery.operators.gather import PART_CHARS, gather_text
from gleanery.operators.media import combine_clips, group_media, select_carousel_item
from gleanery.operators.ordered import HOT_ROWS

HEARD = "text STRING, language STRING, duration_seconds DOUBLE"


def _piece(number: str) -> Column:
    return F.concat_ws("#", "content_id", number)


def _of_pieces(answers: DataFrame) -> DataFrame:
    """Answers by piece with ``content_id`` and ``n``, the piece's number, again."""
    number = F.substring_index("_piece", "#", -1)
    owner = F.substring(F.col("_piece"), F.lit(1), F.length("_piece") - F.length(number) - 1)
    return answers.withColumns({"content_id": owner, "n": number.cast("long")})


def capture_media(
    files: DataFrame,
    describe: Callable[[], BatchFunction] | None,
    transcribe: Callable[[], BatchFunction] | None,
    template: str,
    refs: DataFrame | None = None,
    part_chars: int = PART_CHARS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(content_id, part_no, text, error) of every item that media files (content_id, path, has_audio,
    frame_path) are there for.

    ``refs`` (content_id, img_index) picks one file of a carousel. Files with sound go to
    ``transcribe`` one by one (rows with ``path`` in, ``HEARD`` out) and are put together as clips.
    Without any, pictures and the frames of silent videos go to ``describe`` together (rows with
    ``prompt`` and ``paths``, a line each, in; ``text`` out); an answer that refuses is an error. An item
    whose kind of file has no model given is left out. Parts join by a blank line.
    """
    chosen = files if refs is None else select_carousel_item(files, refs, hot_rows)
    grouped = durable(group_media(chosen, hot_rows))
    none = grouped.filter("error IS NOT NULL")
    legs = [none.select("content_id", F.lit(0).cast("long").alias("part_no"), F.lit(None).cast("string").alias("text"), "error")]
    if transcribe is not None:
        films = grouped.filter("media_type = 'video'").select(_piece("pos").alias("_piece"), "path")
        heard = durable(_of_pieces(apply_model(films, transcribe, HEARD, key="_piece")))
        clips = heard.filter("error IS NULL").select(
            "content_id", F.col("n").alias("clip_no"), "text", "language", "duration_seconds", F.lit("model").alias("backend")
        )
        legs.append(_parts(heard, combine_clips(clips, part_chars, hot_rows)))
    if describe is not None:
        pictures = grouped.filter("media_type = 'image'")
        paths = gather_text(pictures.select("content_id", "pos", "path"), ["content_id"], ["pos"], "path", "\n", part_chars, hot_rows)
        asked = render_image_prompts(grouped, template).join(paths, "content_id")
        rows = asked.select(_piece("part_no").alias("_piece"), "static_prefix", "prompt", F.col("text").alias("paths"))
        told = apply_model(rows, describe, "text STRING", key="_piece").withColumnRenamed("error", "_failed")
        seen = flag_refusals(told.withColumn("text", strip(F.col("text"))))
        seen = durable(_of_pieces(seen.withColumn("error", F.coalesce("_failed", "error")).drop("_failed", "refused")))
        legs.append(_parts(seen, seen.select("content_id", F.col("n").alias("part_no"), "text")))
    return reduce(DataFrame.unionByName, legs)


def _parts(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """The parts of items without a failed piece, and one row with the first error of the others."""
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("n")))
    lost = pieces.filter("error IS NOT NULL").groupBy("content_id").agg(first.alias("error"))
    good = texts.join(lost.select("content_id"), "content_id", "left_anti")
    bad = lost.select("content_id", F.lit(0).cast("long").alias("part_no"), F.lit(None).cast("string").alias("text"), "error")
    return good.select("content_id", "part_no", "text", F.lit(None).cast("string").alias("error")).unionByName(bad)
