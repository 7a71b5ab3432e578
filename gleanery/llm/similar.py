"""Near copies by SimHash and minwise bands, linked by the exact Jaccard similarity of their word shingles.

Two texts link when their sets of five-word shingles have a similarity of 0.8 or more. A class
is what links connect; of each class one row stays. Nothing that is less similar links.

* Texts with equal sets are one node. Nodes that may link are sought in two ways.
* By SimHash, as in ``simhash.py``: a node has eight independent 64-bit fingerprints, and nodes meet when
  the ring search finds any of them within four bits. At similarity 0.9 that is nearly every pair; at
  0.8 about 10 of 64 bits differ, which only some pairs stay below.
* By minwise bands, for the pairs too far apart for the ring: 160 minwise hashes in 32 bands of five.
  Nodes that share a band meet: a pair at similarity 0.8 does so with probability
  1 - (1 - 0.8 ** 5) ** 32, which leaves out 3 in a million, and fewer above. There, set sizes and one
  bit of each minwise hash are compared. At 0.8, 16 of 160 bits differ on average, with deviation
  3.8; up to 36 pass.
* What meets in either way forms coarse classes. The texts of one with several nodes meet once more, and
  links are decided on the whole sets. Coarse classes only say who may be compared; they delete nothing.
* Groups beyond a size are cut into slices that meet pair by pair. In a task, a node that is
  linked is never compared again with its own class, and a spanning forest is all that leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import staged
from gleanery.llm.simhash import RADIUS, SEED, STAGE_HASHES, _union, _with_end, components, fingerprints_of, joint_links, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 32
BAND_HASHES = 5
#: Differing bits, of one for each minwise hash, with which a pair is still compared in full.
SKETCH_BITS = 36
CROWDED = 2048
#: Shingles of a slice of a coarse class.
SLICE_SHINGLES = 1 << 21
SHINGLES_AT_ONCE = 1 << 10

_MIX = np.uint64(0x9E3779B97F4A7C15)
_DRAWS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (2, BANDS * BAND_HASHES, 1), np.uint64)
_FACTORS, _OFFSETS = _DRAWS[0] | np.uint64(1), _DRAWS[1]


def shingle_set(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes."""
    return np.unique(shingle_hashes(text, shingle_words))


def minwise(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bands, and a bit of each minwise hash packed into three words."""
    least = np.full(BANDS * BAND_HASHES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), SHINGLES_AT_ONCE):
        np.minimum(least, (shingles[i : i + SHINGLES_AT_ONCE] * _FACTORS + _OFFSETS).min(axis=1), out=least)
    mixed = least * _MIX
    bits = np.packbits((mixed >> np.uint64(63)).astype(np.uint8))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_HASHES).T:
        keys = (keys ^ column) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys, np.pad(bits, (0, 24 - len(bits))).view("<u8")


def _marked(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, _h, _k, node, n, fps, sketch, keys): the node is a hash of the set, n its size."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            nodes, sizes, fps, sketches, keys = [], [], [], [], []
            for text in frame.column(1).cast(pa.large_binary()):
                hashes = shingle_hashes(text.as_py() or b"", shingle_words)
                shingles = np.unique(hashes)
                fps.append(fingerprints_of(hashes, STAGE_HASHES))
                key, sketch = minwise(shingles)
                nodes.append(xxhash.xxh64_intdigest(shingles.tobytes(), SEED))
                sizes.append(len(shingles))
                sketches.append(sketch)
                keys.append(key)
            lists = []
            for values, width in ((fps, STAGE_HASHES), (sketches, 3), (keys, BANDS)):
                flat = pa.array(np.array(values, dtype=np.uint64).reshape(-1).view(np.int64))
                lists.append(pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width), pa.int32()), flat))
            node = pa.array(np.array(nodes, dtype=np.uint64).view(np.int64))
            columns = [frame.column(0), frame.column(2), frame.column(3), node, pa.array(sizes, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_h", "_k", "node", "n", "fps", "sketch", "keys"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "_h", "_k")
    schema = "doc_id long, _h long, _k long, node long, n long, fps array<long>, sketch array<long>, keys array<long>"
    return narrow.mapInArrow(batches, schema)


def _sliced(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Rows of each key in ``sizes`` (key, cut), once for each pair (i, j) of slices they belong to."""
    rows = rows.join(sizes, key)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cut")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    rows = rows.filter((F.col("cut") == 1) | (F.col("own") != F.col("other")))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _cut(amount: Column, most: int) -> Column:
    return F.ceil(amount / most).cast("int")


def alike(sizes: np.ndarray, sketches: np.ndarray, similarity: float) -> np.ndarray:
    """The parent of each row in a forest of the pairs whose sizes and sketches allow a link."""
    parent = np.arange(len(sizes))
    for at in range(0, len(sizes), 256):
        part = slice(at, at + 256)
        apart = np.bitwise_count(sketches[part, None, :] ^ sketches[None, :, :]).sum(axis=2, dtype=np.int16)
        low = np.minimum(sizes[part, None], sizes[None, :])
        high = np.maximum(sizes[part, None], sizes[None, :])
        a, b = np.nonzero((apart <= SKETCH_BITS) & (low >= similarity * high))
        parent = _union(parent, a + at, b)
    return parent


def _coarse_edges(nodes: DataFrame, similarity: float, crowded: int) -> DataFrame:
    """(a, b) edges whose classes hold every pair that shares a band and may link."""
    words = [F.element_at("sketch", w + 1).alias(f"s{w}") for w in range(3)]
    rows = nodes.select("node", "n", *words, F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").count().filter("count > 1").select("key", _cut(F.col("count"), crowded).alias("cut"))
    met = _sliced(rows, sizes, "key").select("key", "i", "j", "node", "n", "s0", "s1", "s2")

    def edges(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 8), np.int64)
        for frame in _with_end(frames):
            rows = held
            if frame is not None:
                columns = [frame.column(c).cast(pa.int64()).to_numpy() for c in range(8)]
                rows = np.concatenate([held, np.stack(columns, axis=1)])
            if not len(rows):
                continue
            new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
            bounds = np.concatenate([[0], np.nonzero(new)[0] + 1, [len(rows)]])
            if frame is not None:
                held, bounds = rows[bounds[-2] :], bounds[:-1]
            out = [np.empty((0, 2), np.int64)]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                group = rows[lo:hi]
                parent = alike(group[:, 4], group[:, 5:].view(np.uint64), similarity)
                linked = np.nonzero(parent != np.arange(len(group)))[0]
                out.append(np.stack([group[linked, 3], group[parent[linked], 3]], axis=1))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return met.mapInArrow(edges, "a long, b long")


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of sets with at least this Jaccard similarity.

    A set is compared with those that no class has reached yet, by counting shared shingles in
    posting lists of these alone.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    distinct, codes = np.unique(np.concatenate(sets), return_inverse=True)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    order = np.argsort(codes, kind="stable")
    codes_by, owners_by = codes[order], owner[order]
    unseen = np.ones(len(sets), dtype=bool)
    left, indexed, edges = len(sets), -1, []
    bounds = np.empty(0, dtype=np.int64)
    for start in range(len(sets)):
        if not unseen[start]:
            continue
        unseen[start] = False
        left -= 1
        waiting = [start]
        while waiting and left:
            if indexed < 0 or left * 2 <= indexed:
                kept = unseen[owners_by]
                codes_by, owners_by = codes_by[kept], owners_by[kept]
                bounds = np.searchsorted(codes_by, np.arange(len(distinct) + 1))
                indexed = left
            x = waiting.pop()
            own = codes[firsts[x] : firsts[x + 1]]
            lengths = bounds[own + 1] - bounds[own]
            at = np.arange(lengths.sum()) + np.repeat(bounds[own] - np.cumsum(lengths) + lengths, lengths)
            common = np.bincount(owners_by[at], minlength=len(sets))
            near = unseen & (common > 0)
            near[near] = common[near] / (sizes[x] + sizes[near] - common[near]) >= similarity
            reached = np.nonzero(near)[0].tolist()
            unseen[near] = False
            left -= len(reached)
            edges += [(y, x) for y in reached]
            waiting += reached
    return edges


def _exact_edges(texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b) edges from texts (root, i, j, node, text) that lie together by (root, i, j)."""

    def found(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        edges = forest(sets, similarity) if len(sets) > 1 else []
        columns = [pa.array([nodes[e[side]] for e in edges], pa.int64()) for side in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def edges(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        for frame in frames:
            places = zip(*(frame.column(c).to_pylist() for c in range(4)), strict=True)
            for (*place, node), text in zip(places, frame.column(4).cast(pa.large_binary()), strict=True):
                if place != group:
                    if group is not None:
                        yield found(nodes, sets)
                    group, nodes, sets = place, [], []
                nodes.append(node)
                sets.append(shingle_set(text.as_py() or b"", shingle_words))
        if group is not None:
            yield found(nodes, sets)

    return texts.select("root", "i", "j", "node", "text").mapInArrow(edges, "a long, b long")


def one_of_similar(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, crowded: int = CROWDED
) -> DataFrame:
    """One row of each class: that with the smallest doc_id, of equal ids the first by hash.

    The bands are laid out for similarities of 0.8 and more. Texts without words are one class.
    Of rows that repeat id and text, one stays. Rows with null ids take part and give way to
    rows with one. The choice is made on ids and hashes; texts are read again afterwards.
    """
    if not SIMILARITY <= similarity <= 1:
        raise ValueError("the bands serve similarities from 0.8 to 1")
    marks = {"_h": F.xxhash64("doc_id", "text"), "_k": F.xxhash64(F.lit(1), "doc_id", "text")}
    marked = [c.alias(n) for n, c in marks.items()]
    prints = staged(_marked(docs.select("doc_id", "text", *marked), shingle_words), "similar-marks")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_h", "_k"))
    # Of a node's rows, the best stands for all: its text has the node's set.
    same = prints.groupBy("node").agg(
        best.alias("best"),
        F.first("n").alias("n"),
        F.min("fps").alias("fps"),
        F.first("sketch").alias("sketch"),
        F.first("keys").alias("keys"),
    )
    nodes = staged(same, "similar-nodes")
    near = joint_links(nodes.select("node", "fps"), RADIUS, crowded)
    coarse = components(near.unionByName(_coarse_edges(nodes, similarity, crowded)))
    coarse = coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct())
    members = staged(nodes.join(coarse, "node").select("node", "n", "root", "best._h", "best._k"), "similar-coarse")
    cut = F.greatest(_cut(F.sum("n"), SLICE_SHINGLES), _cut(F.count("*"), crowded))
    sizes = members.groupBy("root").agg(cut.alias("cut"))
    texts = docs.select("text", *marked).join(members, ["_h", "_k"]).dropDuplicates(["node"])
    edges = _exact_edges(_sliced(texts.select("node", "root", "text"), sizes, "root"), shingle_words, similarity)
    roots = components(edges)
    classes = nodes.join(roots, "node", "left").select("best", F.coalesce("root", "node").alias("root"))
    chosen = classes.groupBy("root").agg(F.min("best").alias("c")).select("c._h", "c._k")
    own = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), *marked)
    kept = rows.join(chosen, ["_h", "_k"], "left_semi").dropDuplicates(["_h", "_k"])
    return kept.select(*(F.col(n).alias(c) for c, n in own.items()))
