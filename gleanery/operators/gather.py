"""Joining the ordered lines of an item into text, in parts when an item is too long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ordered import HOT_ROWS, order_rows, running

PART_CHARS = 64_000_000


def fits(df: DataFrame, keys: list[str], size: Column, limit: int) -> bool:
    """Whether every key's total size stays within the limit (one pre-aggregated pass)."""
    largest = df.groupBy(*keys).agg(F.sum(size).alias("size")).agg(F.max("size")).first()[0]
    return (largest or 0) <= limit


def join_lines(order: list[str], text: str, sep: str) -> Column:
    """Aggregate: the texts of a group in order, joined by ``sep``."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(ordered, lambda r: r["_text"]), sep)


def gather_text(
    lines: DataFrame,
    keys: list[str],
    order: list[str],
    text: str,
    sep: str,
    part_chars: int = PART_CHARS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows (keys, part_no, text): all lines of a key in order, none dropped.

    An item has one part unless its text exceeds ``part_chars``; joining its parts by
    ``sep`` gives the whole text, so no group handed to one task is larger than a part.
    """
    size = F.length(text) + len(sep)
    if fits(lines, keys, size, part_chars):
        grouped = lines.withColumn("part_no", F.lit(0).cast("long")).groupBy(*keys, "part_no")
    else:
        placed = running(order_rows(lines, keys, order, hot_rows), sums={"_end": size}).rows()
        part = F.floor((F.col("_end") - size) / F.lit(part_chars))
        grouped = placed.withColumn("part_no", part).groupBy(*keys, "part_no")
    return grouped.agg(join_lines(order, text, sep).alias("text"))
