"""Block pages against a plain depth-first walk, cycles and shared blocks included."""

import json
import random

import pytest

from gleanery.operators import blocks, trees

SCHEMA = "page_id STRING, parent_id STRING, pos INT, block_id STRING, type STRING, title STRING"


def walk(page, children, facts):
    lines = [f"# {facts[page][1]}" if facts[page][1] else blocks.UNTITLED]
    visited = {page}

    def visit(b):
        for child in children.get(b, []):
            if child in visited:
                continue
            visited.add(child)
            if child not in facts:
                continue
            kind, title = facts[child]
            if title and kind not in blocks.FILE_TYPES:
                lines.append(title)
            if kind in blocks.DATABASE_TYPES:
                lines.append(f"[linked database: {title or 'untitled'} - contents not included]")
            visit(child)

    visit(page)
    return "\n".join(lines)


@pytest.mark.parametrize("hot_rows,walk_rows", [(10_000, 10_000), (10_000, 14), (8, 0)])
def test_walk(spark, hot_rows, walk_rows):
    rng = random.Random(11)
    rows, want = [], {}
    for p in range(12):
        page = f"p{p}"
        names = [page, *(f"{page}-{i}" for i in range(rng.randint(3, 12)))]
        kinds = ["text", "text", "image", "collection_view"]
        facts = {n: (rng.choice(kinds), rng.choice(["", "t " + n, "u " + n])) for n in names}
        children = {n: [rng.choice(names) for _ in range(rng.randint(0, 4))] for n in names}
        rows.append((page, None, 0, page, *facts[page]))
        rows += [(page, n, i, c, *facts[c]) for n, cs in children.items() for i, c in enumerate(cs)]
        want[page] = walk(page, children, facts)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.text for r in blocks.flatten_block_trees(df, 10_000, hot_rows, walk_rows).collect()}
    assert got == want


def as_rows(page, children, extra=()):
    rows = [(page, None, 0, page, "page", page)]
    rows += [(page, n, i, c, "text", c) for n, cs in children.items() for i, c in enumerate(cs)]
    return rows + list(extra)


def places(df, **options):
    return {(r.page_id, r.block_id): r.place for r in trees.reading_order(df, **options).collect()}


def test_deep_and_wide_trees_need_few_rounds(spark, monkeypatch):
    """A chain of 5,000 blocks, a page with 3,000 children, random trees; by walks and by doubling."""
    rng = random.Random(7)
    chain = {"c" if i == 0 else f"c{i}": [f"c{i + 1}"] for i in range(5000)}
    wide = {"w": [f"w{i}" for i in range(3000)], "w7": ["x", "y"], "y": ["z"]}
    rows, want = as_rows("c", chain) + as_rows("w", wide), {}
    for p in range(5):
        names = [f"t{p}"]
        tree = {}
        for i in range(rng.randrange(1, 60)):
            tree.setdefault(rng.choice(names), []).append(f"t{p}-{i}")
            names.append(f"t{p}-{i}")
        rows += as_rows(f"t{p}", tree)
        want |= {(f"t{p}", b): i for i, b in enumerate(trees.visit([f"t{p}"], tree))}
    want |= {("c", b): i for i, b in enumerate(trees.visit(["c"], chain))}
    want |= {("w", b): i for i, b in enumerate(trees.visit(["w"], wide))}
    # Circles that no page leads to, a block under one that isn't there, a link back to the page.
    odd = [("w", "q1", 0, "q2", "text", ""), ("w", "q2", 0, "q1", "text", ""), ("w", "gone", 0, "lost", "text", ""), ("w", "lost", 0, "too", "text", "")]
    df = spark.createDataFrame(rows + odd + [("w", "w7", 9, "w", "page", "")], SCHEMA)
    assert places(df) == want
    stages = []
    written = trees.durable
    monkeypatch.setattr(trees, "durable", lambda d: stages.append(1) or written(d))
    assert places(df, walk_rows=0, hot_rows=500) == want
    assert len(stages) < 45  # two rounds of doubling of 13 steps each, not 5,000


def test_pages_with_shared_blocks_and_several_roots(spark):
    """Random graphs: joins level by level give the order of the walk."""
    rng = random.Random(3)
    rows = []
    for p in range(8):
        names = [f"g{p}-{i}" for i in range(9)]
        graph = {n: rng.sample(names, rng.randrange(0, 4)) for n in names}
        rows += [(f"g{p}", None, 0, r, "page", "") for r in names[: 1 + p % 2]]
        rows += [(f"g{p}", n, rng.randrange(3), c, "text", "") for n, cs in graph.items() for c in cs]
        rows += rows[-1:]
    df = spark.createDataFrame(rows, SCHEMA)
    want = places(df)
    assert places(df, walk_rows=0) == want and places(df, walk_rows=15, hot_rows=4) == want


def test_no_blocks(spark):
    assert places(spark.createDataFrame([], SCHEMA)) == {}
    assert places(spark.createDataFrame([("p", "a", 0, "b", "text", "")], SCHEMA), walk_rows=0) == {}


def test_block_map(spark):
    page = "11111111-2222-3333-4444-555555555555"
    doc = {
        "recordMap": {
            "block": {
                page: {"value": {"value": {"id": page, "type": "page", "properties": {"title": [["Ti"], ["‣"], ["tle", [["b"]]]]}, "content": ["b1", "gone", "b2"]}}},
                "b1": {"value": {"id": "b1", "type": "text", "properties": {"title": [["One"]]}}},
                "b2": {"value": {"value": {"value": {"id": "b2", "type": "divider"}}}},
                "bad": {"value": {"role": "none"}},
            }
        }
    }
    df = spark.createDataFrame([(page, json.dumps(doc)), ("other", json.dumps({"recordMap": {"block": {}}})), ("third", "no json")], "page_id STRING, payload STRING")
    got = sorted(map(tuple, blocks.parse_block_map(df).collect()), key=str)
    assert got == sorted(
        [(page, None, 0, page, "page", "Title"), (page, page, 0, "b1", "text", "One"), (page, page, 2, "b2", "divider", "")], key=str
    )
