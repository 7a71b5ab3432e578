"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits: bit b is set when over half of the text's shingle hashes have it.
Fingerprints that differ in at most ``radius`` (4) bits link. The 64 bits are cut into a ring
of five segments. Walking the ring from some segment, the differences added up over 1, 2, 3...
segments never exceed their proportional budget 4/5, 8/5, 12/5... for linked fingerprints, so
some start segment is equal, the next adds at most 1, the next two at most 2, and so on.

* Candidates meet on (start segment, its value): distinct fingerprints only, five rows each.
* A crowded value takes the second step of the chain into the key: the next segment with one
  bit masked (equal for some mask when at most one bit differs). What is still crowded is cut
  into slices that meet pair by pair. No candidate is lost and no task gets a whole hot group.
* In a task the chain prunes pairs before the full Hamming check, and links are reduced to a
  spanning forest: at most one edge per row leaves, never all pairs of a group.
* Components come from alternating star contractions of the edges, written between rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import staged

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: First bits and widths of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
CROWDED = 4096
#: Where a corpus is thinned out: words of a shingle, and independent fingerprints of a text.
STAGE_WORDS = 5
STAGE_HASHES = 8
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of one text (UTF-8); 0 for a text without words."""
    return several_fingerprints(text, shingle_words, 1)[0]


def shingle_hashes(text: bytes, shingle_words: int) -> np.ndarray:
    """64-bit hashes of the text's shingles in order, repeats included; none for a text without words."""
    words = text.lower().split()  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not words:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        spans = [(0, len(joined))]
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        spans = zip(
            starts[: len(words) - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist(), strict=True
        )
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def several_fingerprints(text: bytes, shingle_words: int, count: int) -> list[int]:
    """Fingerprints of one text by ``count`` independent hashes; the first is the plain one."""
    return fingerprints_of(shingle_hashes(text, shingle_words), count)


def fingerprints_of(hashes: np.ndarray, count: int) -> list[int]:
    """Fingerprints of a text's shingle hashes, repeats included."""
    if not len(hashes):
        return [0] * count
    out = []
    for k in range(count):
        if k:
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(hashes), HASHES_AT_ONCE):
            part = hashes[i : i + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]))
    return out


def _marked_fingerprints(docs: DataFrame, shingle_words: int, count: int) -> DataFrame:
    """(doc_id, _h, _k, fps) from (doc_id, text, _h, _k), fingerprints as signed 64-bit numbers."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(1).cast(pa.large_binary())
            fps = [several_fingerprints(t.as_py() or b"", shingle_words, count) for t in texts]
            flat = pa.array(np.array(fps, dtype=np.uint64).reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, count), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), frame.column(2), frame.column(3), lists], ["doc_id", "_h", "_k", "fps"]
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_h", "_k")
    return narrow.mapInArrow(batches, "doc_id long, _h long, _k long, fps array<long>")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): a row per document."""
    none = F.lit(None).cast("long")
    bare = docs.select("doc_id", "text", none.alias("_h"), none.alias("_k"))
    return _marked_fingerprints(bare, shingle_words, 1).select("doc_id", F.element_at("fps", 1).alias("fp"))


def _segment(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _meetings(distinct: DataFrame, crowded: int) -> DataFrame:
    """(fp, seg, key, i, j, own): rows that share (key, i, j) hold every linked pair."""
    fp = F.col("fp")
    starts = F.array(
        *(
            F.struct(
                F.lit(k).alias("seg"),
                _segment(fp, *SEGMENTS[k]).alias("value"),
                _segment(fp, *SEGMENTS[(k + 1) % 5]).alias("after"),
            )
            for k in range(5)
        )
    )
    rows = distinct.select("fp", "k", F.inline(starts)).withColumn("seg", F.col("k") * 5 + F.col("seg")).drop("k")
    # At most 5 * 2**13 keys for each hash, so this side is small whatever the input.
    hot = rows.groupBy("seg", "value").count().filter(F.col("count") > crowded).select("seg", "value")
    hot = F.broadcast(hot.withColumn("hot", F.lit(True)))
    rows = rows.join(hot, ["seg", "value"], "left")
    masks = F.when(
        F.col("hot"),
        F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(~(1 << b)).cast("long").alias("mask")) for b in range(13))),
    ).otherwise(F.array(F.struct(F.lit(-1).alias("bit"), F.lit(0).cast("long").alias("mask"))))
    rows = rows.select("fp", "seg", "value", "after", F.inline(masks))
    masked = F.col("after").bitwiseAND(F.col("mask"))
    chained = ((F.col("bit") + 1).cast("long") * 8192 + F.col("value")) * 8192 + masked
    rows = rows.select("fp", "seg", chained.alias("key"))
    sizes = rows.groupBy("seg", "key").count().filter("count > 1")
    cut = F.ceil(F.col("count") / crowded).cast("int")
    rows = rows.join(sizes.select("seg", "key", cut.alias("cut")), ["seg", "key"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    return rows.select(
        "fp", "seg", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own"
    )


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while len(a):
        a, b = parent[a], parent[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(parent, high[apart], low[apart])
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return parent


def _chain(first: np.ndarray, second: np.ndarray, seg: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose differences stay within the chain's budgets from segment ``seg`` on."""
    apart = first[:, None] ^ second[None, :]
    a = b = None
    total = None
    for step in range(5):
        start, width = SEGMENTS[(seg + step) % 5]
        bits = np.bitwise_count(apart & np.uint64(((1 << width) - 1) << start)).astype(np.int16)
        total = bits if total is None else total + bits
        fits = total <= (step + 1) * radius // 5
        if a is None:
            a, b = np.nonzero(fits)
        else:
            kept = np.nonzero(fits)[0]
            a, b = a[kept], b[kept]
        if step == 0:
            apart, total = apart[a, b], total[a, b]
        else:
            apart, total = apart[kept], total[kept]
    return a, b


def _forest(fps: np.ndarray, own: np.ndarray, seg: int, i: int, j: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fp, root), of the links within one meeting."""
    parent = np.arange(len(fps))
    left = np.nonzero(own == i)[0]
    right = left if i == j else np.nonzero(own == j)[0]
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        a, b = _chain(fps[part], fps[right], seg, radius)
        a, b = part[a], right[b]
        apart = a != b
        parent = _union(parent, a[apart], b[apart])
    linked = np.nonzero(parent != np.arange(len(fps)))[0]
    return fps[linked], fps[parent[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(k, a, b) edges that connect exactly the fingerprints of a ``k`` within ``radius`` of each other.

    ``distinct`` is (k, fp): fingerprints by the number of the hash that made them.
    """
    if not 0 <= radius <= 4:
        raise ValueError("the ring of five segments serves radii up to 4")
    met = _meetings(distinct, crowded).repartition("seg", "key", "i", "j")
    met = met.sortWithinPartitions("seg", "key", "i", "j")

    def edges(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for frame in _with_end(frames):
            if frame is None:
                rows, done = (np.concatenate(held) if held else np.empty((0, 6), np.int64)), True
            else:
                columns = [frame.column(c).cast(pa.int64()).to_numpy() for c in range(6)]
                held.append(np.stack(columns, axis=1))
                rows, done = np.concatenate(held), False
            if not len(rows):
                continue
            new = np.any(rows[1:, 1:5] != rows[:-1, 1:5], axis=1)
            bounds = np.concatenate([[0], np.nonzero(new)[0] + 1, [len(rows)]])
            if not done:
                held, bounds = [rows[bounds[-2] :]], bounds[:-1]
            out = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo > 1:
                    group = rows[lo:hi]
                    _, seg, _, i, j, _ = group[0].tolist()
                    a, b = _forest(group[:, 0].view(np.uint64), group[:, 5], seg % 5, i, j, radius)
                    out.append((np.full(len(a), seg // 5, dtype=np.int64), a.view(np.int64), b.view(np.int64)))
            if out:
                columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["k", "a", "b"])

    return met.mapInArrow(edges, "k long, a long, b long")


def _with_end(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from frames
    yield None


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node.

    Alternates large-star and small-star steps; each round is written to the shared folder.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = staged(edges.select(a.alias("a"), b.alias("b")).filter("a <> b").distinct(), "star")
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(lower.select("a", F.col("m").alias("b")))
        now = staged(small.distinct(), "star")


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, crowded: int = CROWDED
) -> DataFrame:
    """(doc_id, fp, component_id): every row of ``docs`` with the smallest doc_id of its class.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows whose doc_id is
    null take part; a class of none but such rows has a null component_id. Repeated rows stay.
    An empty table gives an empty result; other columns are not read.
    """
    prints = staged(fingerprints(docs, shingle_words), "simhash")
    return prints.join(_classes(prints, radius, crowded), "fp").select("doc_id", "fp", "component_id")


def _classes(prints: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint."""
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct.select(F.lit(0).alias("k"), "fp"), radius, crowded).drop("k"))
    roots = roots.withColumnRenamed("node", "fp")
    named = staged(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def joint_links(nodes: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """(a, b) edges that connect the nodes (node, fps) linked by any of their fingerprints."""
    each = nodes.select("node", F.posexplode("fps").alias("k", "fp")).withColumn("k", F.col("k").cast("long"))
    named = staged(each.groupBy("k", "fp").agg(F.min("node").alias("rep")), "simhash-reps")
    equal = each.join(named, ["k", "fp"]).filter("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    met = links(named.select("k", "fp"), radius, crowded)
    one = named.select("k", F.col("fp").alias("a"), F.col("rep").alias("x"))
    other = named.select("k", F.col("fp").alias("b"), F.col("rep").alias("y"))
    near = met.join(one, ["k", "a"]).join(other, ["k", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return equal.unionByName(near)


def _joint_classes(prints: DataFrame, radius: int, crowded: int) -> DataFrame:
    """(node, root) of texts, as hashes of all their fingerprints, linked by any of these."""
    nodes = staged(prints.select("node", "fps").dropDuplicates(["node"]), "simhash-nodes")
    roots = components(joint_links(nodes, radius, crowded))
    return nodes.select("node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def one_of_each(
    docs: DataFrame,
    shingle_words: int = STAGE_WORDS,
    hashes: int = STAGE_HASHES,
    radius: int = RADIUS,
    crowded: int = CROWDED,
) -> DataFrame:
    """One row of each class: that with the smallest doc_id, of equal ids the first by hash.

    Texts link when their fingerprints by any of ``hashes`` independent hashes lie within
    ``radius``. With five words and eight hashes that finds nearly all pairs of shingle
    similarity 0.9, fewer towards 0.8, and hardly any below 0.7. The choice is made on ids and hashes;
    texts are read again afterwards. Of rows that repeat id and text, one stays. Rows with null
    ids take part and give way to rows with one.
    """
    marks = {"_h": F.xxhash64("doc_id", "text"), "_k": F.xxhash64(F.lit(1), "doc_id", "text")}
    marked = [c.alias(n) for n, c in marks.items()]
    narrow = docs.select("doc_id", "text", *marked)
    prints = _marked_fingerprints(narrow, shingle_words, hashes)
    prints = staged(prints.withColumn("node", F.xxhash64("fps")), "simhash-marks")
    classes = staged(_joint_classes(prints, radius, crowded), "simhash-classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_h", "_k")).alias("c")
    chosen = prints.join(classes, "node").groupBy("root").agg(best).select("c._h", "c._k")
    own = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), *marked)
    kept = rows.join(chosen, ["_h", "_k"], "left_semi").dropDuplicates(["_h", "_k"])
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))
