"""Block pages: JSON block maps to rows, and rows to text in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.durable import durable
from gleanery.operators.gather import PART_CHARS, gather_text
from gleanery.operators.ordered import HOT_ROWS
from gleanery.operators.trees import WALK_ROWS, reading_order

# Block types whose title is a file name, linked databases, mention marks.
FILE_TYPES = ("image", "file", "video", "audio", "pdf")
DATABASE_TYPES = ("collection_view", "collection_view_page")
MENTION_MARKS = ("‣", "⁍")
UNTITLED = "# (untitled Notion page)"


def _unwrap(node: Column) -> Column:
    """Go through all ``value`` wrappers around a block, however many there are."""
    most = F.regexp_count(F.to_json(node), F.lit('"value"'))
    steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    inner = F.aggregate(
        steps, node, lambda n, _: F.coalesce(F.try_variant_get(n, "$.value", "variant"), n)
    )
    return inner


def _plain(block: Column) -> Column:
    """Rich text to plain text: the first element of each run, without mention marks."""
    runs = F.try_variant_get(block, "$.properties.title", "array<variant>")
    texts = F.transform(runs, lambda r: F.try_variant_get(r, "$[0]", "string"))
    kept = F.filter(texts, lambda t: t.isNotNull() & ~t.isin(*MENTION_MARKS))
    return F.coalesce(F.array_join(kept, ""), F.lit(""))


def parse_block_map(responses: DataFrame) -> DataFrame:
    """Block rows (page_id, parent_id, pos, block_id, type, title) of each answer.

    ``responses`` is (page_id, payload). The page itself is the row without a parent; a page
    with no such row was not found or is not public. A block named by several parents comes
    once per parent.
    """
    parsed = responses.select("page_id", F.try_parse_json("payload").alias("_doc"))
    block_map = F.try_variant_get(F.col("_doc"), "$.recordMap.block", "map<string, variant>")
    found = (
        parsed.select("page_id", F.explode(block_map).alias("block_id", "_node"))
        .withColumn("_block", _unwrap(F.col("_node")))
        .filter(F.try_variant_get(F.col("_block"), "$.id", "string").isNotNull())
        .select(
            "page_id",
            "block_id",
            F.try_variant_get(F.col("_block"), "$.type", "string").alias("type"),
            _plain(F.col("_block")).alias("title"),
            F.try_variant_get(F.col("_block"), "$.content", "array<string>").alias("_children"),
        )
    )
    links = found.select(
        "page_id", F.col("block_id").alias("parent_id"), F.posexplode("_children").alias("pos", "block_id")
    )
    facts = found.select("page_id", "block_id", "type", "title")
    children = links.join(facts, ["page_id", "block_id"])
    roots = facts.filter(F.col("block_id") == F.col("page_id")).withColumns(
        {"parent_id": F.lit(None).cast("string"), "pos": F.lit(0)}
    )
    names = ["page_id", "parent_id", "pos", "block_id", "type", "title"]
    return roots.select(*names).unionByName(children.select(*names))


def block_lines(blocks: DataFrame, hot_rows: int = HOT_ROWS, walk_rows: int = WALK_ROWS) -> DataFrame:
    """Text lines of each page as rows (page_id, place, line_no, line), page title first."""
    facts = blocks.groupBy("page_id", "block_id").agg(
        F.max("type").alias("type"), F.max("title").alias("title")
    )
    placed = reading_order(blocks, hot_rows, walk_rows).join(facts, ["page_id", "block_id"])
    title, root = F.coalesce("title", F.lit("")), F.col("place") == 0
    heading = F.when(title != "", F.concat(F.lit("# "), title)).otherwise(F.lit(UNTITLED))
    is_file = F.coalesce(F.col("type").isin(*FILE_TYPES), F.lit(False))
    prose = F.when((title != "") & ~is_file, title)
    name = F.when(title != "", title).otherwise(F.lit("untitled"))
    database = F.when(
        F.col("type").isin(*DATABASE_TYPES),
        F.concat(F.lit("[linked database: "), name, F.lit(" - contents not included]")),
    )
    lines = F.when(root, F.array(heading)).otherwise(F.array_compact(F.array(prose, database)))
    return placed.select("page_id", "place", F.posexplode(lines).alias("line_no", "line"))


def flatten_block_trees(
    blocks: DataFrame, part_chars: int = PART_CHARS, hot_rows: int = HOT_ROWS, walk_rows: int = WALK_ROWS
) -> DataFrame:
    """Text of each page: its blocks depth first, one line each (parts when very long)."""
    lines = durable(block_lines(blocks, hot_rows, walk_rows))
    return gather_text(lines, ["page_id"], ["place", "line_no"], "line", "\n", part_chars, hot_rows)
