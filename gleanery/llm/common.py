"""Pieces the corpus operators share: stage tables, balanced running sums, byte batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.durable import shared_dir

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_ROWS = 5_000


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows as Parquet into the shared folder and read them back.

    Cuts the lineage: what follows survives lost executors and never computes the rows twice.
    """
    path = f"{shared_dir(df.sparkSession)}/gleanery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def high_bits(hashed: Column, parts: int) -> Column:
    """The part, of ``parts`` equal ones, of the range of 64-bit hashes; keeps their order."""
    top = F.shiftrightunsigned(hashed, 33)
    return F.floor(top * F.lit(parts) / F.lit(float(1 << 31))).cast("int")


def running_before(
    df: DataFrame,
    groups: Sequence[str],
    hashed: str,
    ties: Sequence[str],
    values: dict[str, Column],
    rows: int,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per group, in order of a hash, what the values of the rows before each row add up to.

    A group may own any share of the rows: it is cut into blocks by the leading bits of the
    hash, each block has its own window, and sums of earlier blocks (one row per group and
    block) come in by a join on the same keys. ``groups`` hold no nulls; ``rows`` is the
    number of rows of ``df``; rows that tie on all order columns must be interchangeable.
    """
    parts = max(1, -(-rows // block_rows))
    keys = [*groups, "_block"]
    order = [F.shiftrightunsigned(F.col(hashed), 1), F.col(hashed), *(F.col(c) for c in ties)]
    cut = df.withColumn("_block", high_bits(F.col(hashed), parts))
    sums = cut.groupBy(*keys).agg(*(F.sum(v).alias(f"_sum_{n}") for n, v in values.items()))
    earlier = Window.partitionBy(*groups).orderBy("_block")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *keys,
        *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in values),
    )
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumns({n: F.coalesce(F.sum(v).over(own), F.lit(0)) for n, v in values.items()})
    joined = local.join(carry, keys, "left")
    return joined.select(
        *df.columns, *((F.col(n) + F.col(f"_carry_{n}")).cast("long").alias(n) for n in values)
    )


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``most`` each (one item may exceed it)."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)
