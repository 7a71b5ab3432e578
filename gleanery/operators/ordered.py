"""Running values in key order that stay balanced when one key owns most of the rows.

A window over a key puts all rows of that key into one task. Here that form is used only
while no key exceeds ``hot_rows``. Otherwise the rows are range-partitioned by (key, order),
which cuts a hot key into even chunks; each chunk runs its own window, and what earlier
chunks of the same key add up to is brought in as a carry. Only keys that straddle a chunk
border have a carry, so there are fewer carry rows than chunks, however large the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.durable import durable

HOT_ROWS = 4_000_000
CHUNK = "_chunk"


@dataclass(frozen=True)
class OrderedRows:
    """Rows with a total order inside each key, cut into chunks when a key is hot."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool

    def rows(self) -> DataFrame:
        return self.df.drop(CHUNK)


def order_rows(
    df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS
) -> OrderedRows:
    """Fix the order (it must be total inside a key) and pick the balanced form if needed."""
    sizes = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    largest, total = sizes[0] or 0, sizes[1] or 0
    if largest <= hot_rows:
        return OrderedRows(df, tuple(keys), tuple(order), False)
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(default, -(-total // hot_rows))
    ranged = df.repartitionByRange(chunks, *keys, *order).withColumn(CHUNK, F.spark_partition_id())
    # Chunk numbers are read more than once, so they are fixed on disk first.
    return OrderedRows(durable(ranged), tuple(keys), tuple(order), True)


def running(
    rows: OrderedRows,
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    maxs_before: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
) -> OrderedRows:
    """Add running sums and maxima (up to the row, or before it) and values of the row before."""
    sums, maxs = sums or {}, maxs or {}
    maxs_before, previous = maxs_before or {}, previous or {}
    scope = [*rows.keys, CHUNK] if rows.split else list(rows.keys)
    w = Window.partitionBy(*scope).orderBy(*rows.order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    added = [F.sum(c).over(upto).alias(n) for n, c in sums.items()]
    added += [F.max(c).over(upto).alias(n) for n, c in maxs.items()]
    added += [F.max(c).over(before).alias(n) for n, c in maxs_before.items()]
    added += [F.lag(F.struct(c.alias("v"))).over(w).alias(n) for n, c in previous.items()]
    local = rows.df.select("*", *added)
    if rows.split:
        local = _with_carry(rows, local, sums, {**maxs, **maxs_before}, previous)
    unwrapped = {n: F.col(n)["v"] for n in previous}
    return replace(rows, df=local.withColumns(unwrapped) if unwrapped else local)


def _with_carry(
    rows: OrderedRows,
    local: DataFrame,
    sums: dict[str, Column],
    maxs: dict[str, Column],
    previous: dict[str, Column],
) -> DataFrame:
    place = F.struct(*rows.order)
    totals = [F.sum(c).alias(n) for n, c in sums.items()]
    totals += [F.max(c).alias(n) for n, c in maxs.items()]
    totals += [F.max_by(F.struct(c.alias("v")), place).alias(n) for n, c in previous.items()]
    summary = rows.df.groupBy(*rows.keys, CHUNK).agg(*totals)

    ahead = Window.partitionBy(*rows.keys).orderBy(CHUNK)
    past = ahead.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(n).over(past).alias(f"_carry_{n}") for n in sums]
    carried += [F.max(n).over(past).alias(f"_carry_{n}") for n in maxs]
    carried += [F.last(n).over(past).alias(f"_carry_{n}") for n in previous]
    names = {k: f"_key_{k}" for k in (*rows.keys, CHUNK)}
    carry = (
        summary.select(*rows.keys, CHUNK, F.row_number().over(ahead).alias("_nth"), *carried)
        .filter(F.col("_nth") > 1)
        .drop("_nth")
        .withColumnsRenamed(names)
    )
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    # Fewer rows than chunks: every extra chunk of a key needs one chunk border.
    joined = local.join(F.broadcast(carry), same, "left")
    merged = {n: F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0)) for n in sums}
    merged |= {n: F.greatest(F.col(n), F.col(f"_carry_{n}")) for n in maxs}
    merged |= {n: F.coalesce(F.col(n), F.col(f"_carry_{n}")) for n in previous}
    return joined.withColumns(merged).select(*local.columns)
