"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded, seeded sample of the vectors. A vector is represented by its ``ORDERED``
nearest pivots in order. The vectors are dealt into blocks by a hash; each block posts its vectors in
one inverted file per pivot, with the pivot's place in the vector's order. A query walks the files
of its own pivots and adds up the footrule distance of the two orders; the best ``SHARE`` of the
block is ranked anew by the exact cosine, and a few answers per query leave the block.

* The query set meets all rows block by block; a block has about ``BLOCK_ROWS`` vectors.
* Equal vectors are posted once, with the few smallest ids an answer can need; every row is
  covered, and a vector that a third of the rows share costs one posting.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import staged

#: The index is fitted on this many vectors at most.
PIVOTS = 256
ORDERED = 64
#: Of each block, the share of vectors ranked by the exact measure, and the least number of them.
SHARE = 0.05
LEAST = 200
BLOCK_ROWS = 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): finite, non-zero vectors without null components, as doubles."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    nonzero = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter("vec_id is not null").filter(fine & nonzero)


def _units(values: list | pd.Series) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in values])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _with_orders(rows: DataFrame, pivots: np.ndarray, ordered: int) -> DataFrame:
    """Add ``order``: the numbers of the nearest pivots, nearest first."""
    ordered = min(ordered, len(pivots))
    schema = rows.schema.simpleString()[7:-1] + ",order:array<int>"

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                near = _units(frame["v"]) @ pivots.T
                frame["order"] = list(np.argsort(-near, axis=1, kind="stable")[:, :ordered].astype(np.int32))
                yield frame

    return rows.mapInPandas(add, schema)


def inverted_files(orders: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pivot: the vectors that list it, and its place in each one's order."""
    who = np.repeat(np.arange(len(orders)), orders.shape[1])
    place = np.tile(np.arange(orders.shape[1]), len(orders))
    by = np.argsort(orders.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(orders.ravel(), minlength=pivots))
    return [(who[by[a:b]], place[by[a:b]]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def footrule(query: np.ndarray, files: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Footrule distance of one order to those of n vectors, from the files of its pivots alone.

    A pivot missing from an order has the place after its last. Starting from two orders that share
    nothing, each shared pivot takes back what both sides were charged for it.
    """
    m = len(query)
    apart = np.full(n, m * (m + 1), dtype=np.int32)
    for rank, pivot in enumerate(query):
        who, place = files[pivot]
        apart[who] += (np.abs(place - rank) - (m - rank) - (m - place)).astype(np.int32)
    return apart


def search(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    pivots: int = PIVOTS,
    ordered: int = ORDERED,
    share: float = SHARE,
    least: int = LEAST,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row with vec_id % every = 0.

    Nearness is the cosine in double precision; ties go to the smaller id. Rows with a null id,
    and vectors that are null, zero or hold null or non-finite components take no part.
    Vectors of different lengths are never compared. Rows that repeat an id and vector answer
    once; a query's own id is never among its answers. An empty table gives no rows.
    """
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().collect()
    parts = [
        _search(rows.filter(F.size("v") == r["d"]), every, k, pivots, ordered, share, least, block_rows)
        for r in sorted(sizes)
    ]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _search(
    rows: DataFrame, every: int, k: int, pivots: int, ordered: int, share: float, least: int, block_rows: int
) -> DataFrame:
    # Equal vectors become one, with the k + 1 smallest ids that an answer can need.
    hashed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    smallest = hashed.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1)
    groups = smallest.groupBy("h1", "h2").agg(
        F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v")
    )
    groups = staged(groups.select(F.xxhash64("h1", "h2").alias("vector"), "ids", "v"), "ann-vectors")
    sample = groups.orderBy("vector").limit(pivots).select("v").collect()
    chosen = _units([r["v"] for r in sample])
    count = len(chosen)
    ordered = min(ordered, count)
    blocks = max(1, -(-groups.count() // block_rows))
    block = F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int")
    index = _with_orders(groups, chosen, ordered).withColumn("block", block)
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = _with_orders(asked, chosen, ordered)
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rank(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(own):
            values = np.stack(own["v"].to_numpy()).astype(np.float64)
            norms = np.sqrt((values * values).sum(axis=1))
            smallest = own["ids"].map(lambda x: x[0]).to_numpy()
            ids = own["ids"].to_numpy()
            files = inverted_files(np.stack(own["order"].to_numpy()), count)
            kept = min(len(own), max(least, math.ceil(share * len(own))))
            for query_id, v, order in zip(queries["query_id"], queries["v"], queries["order"], strict=True):
                apart = footrule(order, files, len(own))
                near = np.argpartition(apart, kept - 1)[:kept] if kept < len(own) else np.arange(kept)
                v = np.asarray(v, dtype=np.float64)
                score = values[near] @ v / (norms[near] * math.sqrt(v @ v))
                best = np.lexsort((smallest[near], -score))[: k + 1]
                out += [(query_id, list(ids[near[i]]), float(score[i])) for i in best]
        return pd.DataFrame(out, columns=["query_id", "ids", "score"])

    met = asked.groupBy("block").cogroup(index.groupBy("block"))
    met = met.applyInPandas(rank, "query_id long, ids array<long>, score double")
    answers = met.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(nearest).cast("int")).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")
