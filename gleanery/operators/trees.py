"""Reading order of block trees: one walk per page, or list doubling for very large pages.

A page that is a usual answer is walked depth first in one go. Pages with more than ``walk_rows``
rows are ordered by Spark:

* A *tree* (no block named by two parents) takes two rounds of pointer doubling. Sizes of subtrees
  add up over ancestors 1, 2, 4, ... levels away; the place of a block is then the sum, over
  its ancestors, of what comes before each of them. A tree of any depth takes as many rounds as its
  depth has binary digits; blocks whose pointer has reached the page take no further part.
* Any other page is extended level by level: depth first with a visited set reaches a block by
  its smallest path that repeats no block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.durable import durable
from gleanery.operators.lookup import hot_slices, lookup, sliced_join
from gleanery.operators.ordered import HOT_ROWS, order_rows, running

#: Rows of a page that one task walks; beyond it the page is ordered by joins.
WALK_ROWS = 200_000
PLACES = "page_id string, block_id string, place long"
KEY = ["page_id", "block_id"]


def visit(roots: list[str], children: dict[str, list[str]]) -> list[str]:
    """Blocks in the order a depth-first walk first meets them; no recursion."""
    seen: set[str] = set()
    order: list[str] = []
    stack = roots[::-1]
    while stack:
        block = stack.pop()
        if block not in seen:
            seen.add(block)
            order.append(block)
            stack += [c for c in reversed(children.get(block, ())) if c not in seen]
    return order


def walked(blocks: DataFrame) -> DataFrame:
    """(page_id, block_id, place) of pages that fit a task, page after page."""
    rows = blocks.select("page_id", "parent_id", "pos", "block_id").repartition("page_id")
    ordered = rows.sortWithinPartitions("page_id", "pos", "block_id")

    def walk(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page: str | None = None
        roots: list[str] = []
        children: dict[str, list[str]] = defaultdict(list)
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            order = visit(roots, children)
            out[0].extend([page] * len(order))
            out[1].extend(order)
            out[2].extend(range(len(order)))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())],
                ["page_id", "block_id", "place"],
            )

        for frame in frames:
            columns = (frame.column(c).to_pylist() for c in ("page_id", "parent_id", "block_id"))
            for owner, parent, block in zip(*columns, strict=True):
                if owner != page:
                    close()
                    page, roots, children = owner, [], defaultdict(list)
                if parent is None:
                    roots.append(block)
                else:
                    children[parent].append(block)
            if len(out[0]) >= 10_000:
                yield batch()
                out = ([], [], [])
        close()
        yield batch()

    return ordered.mapInArrow(walk, PLACES)


def _roots(blocks: DataFrame) -> DataFrame:
    return blocks.filter("parent_id IS NULL").groupBy(*KEY).agg(F.min("pos").alias("pos"))


def _links(blocks: DataFrame) -> DataFrame:
    """Each link between two blocks once, at its first place."""
    links = blocks.filter("parent_id IS NOT NULL")
    return links.groupBy("page_id", "parent_id", "block_id").agg(F.min("pos").alias("pos"))


def _followed(nodes: DataFrame, value: str) -> DataFrame:
    """Nodes with a pointer, with ``_next`` (where it points on to) and ``_more`` (the value there).

    Many nodes come to point at one; the engine's own skew join cuts such keys while it runs.
    """
    there = nodes.select("page_id", F.col("block_id").alias("up"), F.col("up").alias("_next"), F.col(value).alias("_more"))
    return nodes.filter("up IS NOT NULL").join(there, ["page_id", "up"], "left")


def _most_rounds(links: DataFrame) -> int:
    largest = links.groupBy("page_id").count().agg(F.max("count")).first()[0] or 0
    return largest.bit_length() + 1


def subtree_sizes(nodes: DataFrame, rounds: int) -> DataFrame:
    """(page_id, block_id, size): blocks beneath each block, itself included, by doubling."""
    now = durable(nodes.select(*KEY, "up", F.lit(1).cast("long").alias("size")))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        moving = now.filter("up IS NOT NULL")
        if moving.isEmpty():
            break
        gained = moving.groupBy("page_id", F.col("up").alias("block_id")).agg(F.sum("size").alias("_gain"))
        moved = _followed(now, "size").select(*KEY, F.col("_next").alias("up"), "size")
        rest = now.filter("up IS NULL").select(*KEY, "up", "size")
        now = durable(
            moved.unionByName(rest)
            .coalesce(parts)
            .join(gained, KEY, "left")
            .select(*KEY, "up", (F.col("size") + F.coalesce("_gain", F.lit(0))).alias("size"))
        )
    return now.select(*KEY, "size")


def tree_places(links: DataFrame, roots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(page_id, block_id, place) of pages that are trees, whatever their depth."""
    rounds = _most_rounds(links)
    tops = roots.select("page_id", F.col("block_id").alias("parent_id"), F.lit(True).alias("_top"))
    # A pointer to the page itself is an end: nothing comes before the page.
    nodes = durable(
        lookup(links, tops, ["page_id", "parent_id"], ["block_id"], "left", hot_rows).select(
            *KEY, "parent_id", "pos", F.when(F.col("_top").isNull(), F.col("parent_id")).alias("up")
        )
    )
    sized = nodes.join(subtree_sizes(nodes, rounds), KEY)
    siblings = running(order_rows(sized, ["page_id", "parent_id"], ["pos", "block_id"], hot_rows), sums={"_upto": F.col("size")}).rows()
    before = F.col("_upto") - F.col("size") + 1
    now = durable(siblings.select(*KEY, "up", before.cast("long").alias("place")))
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        if now.filter("up IS NOT NULL").isEmpty():
            break
        moved = _followed(now, "place").select(*KEY, F.col("_next").alias("up"), (F.col("place") + F.col("_more")).alias("place"))
        # Without it a union after a join that doesn't shuffle doubles the parts each round.
        now = durable(moved.unionByName(now.filter("up IS NULL")).coalesce(parts))
    # What still points on hangs in a circle, and what has no place under a block that isn't there.
    found = now.filter("up IS NULL AND place IS NOT NULL").select(*KEY, "place")
    return roots.select(*KEY, F.lit(0).cast("long").alias("place")).unionByName(found)


def graph_places(links: DataFrame, roots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(page_id, block_id, place) of pages whose blocks have several parents: one round a level."""
    edges = durable(links)
    slices = hot_slices(edges, ["page_id", "parent_id"], hot_rows)
    step = F.struct(F.col("pos").cast("int").alias("pos"), F.col("block_id").alias("block"))
    changed = durable(roots.select(*KEY, F.array(step).alias("path")))
    found = changed
    while True:
        frontier = changed.select("page_id", F.col("block_id").alias("parent_id"), "path")
        steps = sliced_join(edges, frontier, ["page_id", "parent_id"], ["pos", "block_id"], "inner", slices)
        fresh = ~F.exists("path", lambda p: p["block"] == F.col("block_id"))
        longer = steps.filter(fresh).withColumn("path", F.concat("path", F.array(step))).groupBy(*KEY).agg(F.min("path").alias("path"))
        known = found.select(*(F.col(c).alias(f"_{c}") for c in found.columns))
        no_worse = (F.col("page_id") == F.col("_page_id")) & (F.col("block_id") == F.col("_block_id")) & (F.col("_path") <= F.col("path"))
        changed = durable(longer.join(known, no_worse, "left_anti"))
        if changed.isEmpty():
            break
        found = durable(found.unionByName(changed).groupBy(*KEY).agg(F.min("path").alias("path")))
    rows = order_rows(found, ["page_id"], ["path", "block_id"], hot_rows)
    numbered = running(rows, sums={"_nth": F.lit(1)}).rows()
    return numbered.select(*KEY, (F.col("_nth") - 1).cast("long").alias("place"))


def reading_order(blocks: DataFrame, hot_rows: int = HOT_ROWS, walk_rows: int = WALK_ROWS) -> DataFrame:
    """Rows (page_id, block_id, place): the depth-first place of every reachable block, from 0.

    ``blocks`` is (page_id, parent_id, pos, block_id); the row without a parent is the page.
    Blocks of one parent at the same ``pos`` go by id; a block named by several parents, or by
    itself through others, comes where the walk first meets it; what no page leads to is left out.
    """
    sizes = blocks.groupBy("page_id").count()
    large = sizes.filter(F.col("count") > walk_rows).select("page_id")
    if large.isEmpty():
        return walked(blocks)
    large = durable(large)
    big = durable(blocks.join(large, "page_id", "left_semi").select("page_id", "parent_id", "pos", "block_id"))
    small = blocks.join(large, "page_id", "left_anti")
    roots, links = durable(_roots(big)), durable(_links(big))
    # Links back to the page are never followed; a page stays a tree with them.
    inner = durable(links.join(roots.select(*KEY), KEY, "left_anti"))
    several = inner.groupBy(*KEY).count().filter("count > 1").select("page_id")
    several = several.unionByName(roots.groupBy("page_id").count().filter("count > 1").select("page_id"))
    graphs = durable(several.distinct())
    places = walked(small)
    for how, own, ordered in (("left_anti", inner, tree_places), ("left_semi", links, graph_places)):
        tops = roots.join(graphs, "page_id", how)
        if not tops.isEmpty():
            places = places.unionByName(ordered(own.join(graphs, "page_id", how), tops, hot_rows))
    return places
