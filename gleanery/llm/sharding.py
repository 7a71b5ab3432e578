"""Sharding: a uniform shuffle with exact shard sizes by a hypergeometric communication matrix.

1. The rows lie in input parts by a hash of their content (independent of file layout).
2. A matrix of counts (part x shard) is drawn: given the shard sizes that are still open, the
   counts of a part are multivariate hypergeometric. Rows and columns add up exactly.
3. Each part permutes its rows (a seeded hash) and deals them out by its row of the matrix.
4. After the exchange each shard permutes again (another seed); places are gapless slots.

Only counts pass through the driver: one per part of ``PART_ROWS`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import high_bits, running_before, staged

PART_ROWS = 50_000


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """Number of good ones among ``draws`` of ``good + bad``, for any sizes."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(draws, good)

    def log_p(k: int) -> float:
        pick = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
        return pick(good, k) + pick(bad, draws - k) - pick(good + bad, draws)

    # Inversion outwards from the mode: expected steps are of the order of the deviation.
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    u, down, up = rng.random(), mode, mode + 1
    while True:
        for k in (down, up):
            if low <= k <= high:
                u -= math.exp(log_p(k))
                if u <= 0:
                    return k
        if down < low and up > high:
            return mode
        down, up = down - 1, up + 1


def communication_matrix(
    parts: Sequence[int], shards: Sequence[int], seed: int
) -> list[list[int]]:
    """Counts (part x shard) of a uniform random deal; sums are ``parts`` and ``shards``."""
    rng = np.random.default_rng(seed)
    left = list(shards)
    matrix = []
    for size in parts:
        row, open_rows, draws = [], sum(left), size
        for quota in left:
            taken = hypergeometric(quota, open_rows - quota, draws, rng) if draws else 0
            row.append(taken)
            open_rows -= quota
            draws -= taken
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(
    docs: DataFrame, shards: int = 8, seed: int = 7, part_rows: int = PART_ROWS
) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot): every row of ``docs`` at its new place.

    ``size`` is the text's UTF-8 bytes plus one (a null text has none), shards differ by one
    row at most, slots run from 0 without gaps in each shard. Equal rows (same id and text)
    are interchangeable; null ids are rows like any other; other columns are not read. An
    empty table gives no rows. The same rows and seed give the same places again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = staged(narrow, "shard-rows")
    keys = ["doc_id", "size", "text_crc32"]
    rows = rows.withColumns(
        {"_h1": F.xxhash64(F.lit(seed), *keys), "_h2": F.xxhash64(F.lit(seed + 1), *keys)}
    )
    total = rows.count()
    parts = max(1, -(-total // part_rows))
    rows = rows.withColumn("_part", high_bits(F.xxhash64(F.lit(seed + 2), *keys), parts))
    found = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    sizes = [found.get(i, 0) for i in range(parts)]
    quotas = [total // shards + (i < total % shards) for i in range(shards)]
    matrix = communication_matrix(sizes, quotas, seed)
    ends = np.cumsum(np.array(matrix, dtype=np.int64).reshape(parts, shards), axis=1)
    schema = T.StructType().add("_part", T.IntegerType()).add("_ends", T.ArrayType(T.LongType()))
    deal = rows.sparkSession.createDataFrame([(i, e.tolist()) for i, e in enumerate(ends)], schema)

    placed = running_before(rows, ["_part"], "_h1", keys, {"_rank": F.lit(1)}, total, part_rows)
    dealt = placed.join(deal, "_part").withColumn(
        "shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int")
    )
    dealt = dealt.drop("_part", "_ends", "_rank")
    return running_before(dealt, ["shard"], "_h2", keys, {"slot": F.lit(1)}, total, part_rows).select(
        *keys, "shard", "slot"
    )
