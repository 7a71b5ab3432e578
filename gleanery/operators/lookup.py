"""Equi join of many rows to a table with one row per key, with hot keys spread out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ordered import HOT_ROWS

MAX_HOT_KEYS = 100_000


def hot_slices(facts: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Rows (keys, _slices) of the keys that own too many rows, or None when there are none.

    Each holds more than total / MAX_HOT_KEYS rows, so there are fewer than MAX_HOT_KEYS.
    """
    counts = facts.groupBy(*keys).count()
    largest, total = counts.agg(F.max("count"), F.sum("count")).first()
    limit = max(hot_rows, -(-(total or 0) // MAX_HOT_KEYS))
    if (largest or 0) <= limit:
        return None
    slices = F.ceil(F.col("count") / limit).cast("int").alias("_slices")
    return counts.filter(F.col("count") > limit).select(*keys, slices)


def sliced_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str,
    slices: DataFrame | None,
) -> DataFrame:
    """Join with the hot keys that ``hot_slices`` found cut up and their ``dim`` row repeated."""
    if slices is None:
        return facts.join(dim, keys, how)
    hot = F.broadcast(slices)
    width = F.coalesce(F.col("_slices"), F.lit(1))
    cut = facts.join(hot, keys, "left").withColumn("_slice", F.pmod(F.xxhash64(*spread), width))
    numbers = F.sequence(F.lit(0).cast("long"), (width - 1).cast("long"))
    copies = dim.join(hot, keys, "left").withColumn("_slice", F.explode(numbers))
    joined = cut.drop("_slices").join(copies.drop("_slices"), [*keys, "_slice"], how)
    return joined.drop("_slice")


def lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``facts`` to ``dim`` (unique on ``keys``).

    A key with more than ``hot_rows`` rows is cut into slices by a hash of the ``spread``
    columns, so none of its rows has to meet all others in one task.
    """
    return sliced_join(facts, dim, keys, spread, how, hot_slices(facts, keys, hot_rows))
