"""Repeated passages by grouping 400-byte windows by their hashes.

A start position counts as repeated when the ``length`` (400) bytes from it also start
elsewhere. No suffix array and no longest-previous-factor array is built: removal only asks whether
400 bytes occur again, and windows with equal bytes have equal hashes.

1. *Anchors.* Every window of 400 bytes picks its leftmost least 32-byte hash. Equal windows pick
   equal anchors at equal places, so windows are compared within the group of an anchor's hash
   only. Consecutive windows share an anchor: one row per run of windows, about one per 180 bytes.
2. *Groups.* Runs whose hash occurs once repeat nothing. Runs with equal bytes (a *variant*)
   repeat each other whole; one of each variant goes on when its group has several.
3. *Windows.* The windows of all variants of a task's groups are sorted by the hash of their 400
   bytes, ties by position: equal neighbours are repeats, and with ``keep_first`` the first of a
   stretch stays. A group with very many variants is sorted by Spark instead, window by window.
4. *Removal.* Repeated starts become byte intervals per document, merged and cut out of it.

Texts travel compressed. No group of documents, and no list longer than one document's own anchors,
is ever collected in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import slices, staged

LENGTH = 400
CORE = 32
CHUNK_BYTES = 1 << 20
#: Variants in a group beyond which Spark sorts its windows.
CROWDED = 8192
PLACE_BITS = 24
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
SCRAMBLE = np.uint64(0xD6E8FEB86659FD93)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SCRAMBLE
    x = (x ^ (x >> np.uint64(32))) * SCRAMBLE
    return x ^ (x >> np.uint64(32))


def prefix_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each start (length >= 8); by doubling what is covered."""
    n = len(data)
    if n < length:
        return np.empty(0, dtype=np.uint64)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    now = np.empty(n, dtype=np.uint64)
    for r in range(min(8, n)):
        count = (n - r + 7) // 8
        now[r::8] = np.frombuffer(padded[r : r + 8 * count].tobytes().ljust(8 * count, b"\0"), dtype="<u8")
    covered = 8
    while covered < length:
        step = min(covered, length - covered)
        now = _scrambled(now[: len(now) - step]) * MULTIPLY + now[step:]
        covered += step
    return _scrambled(now[: n - length + 1])


def window_runs(texts: list[bytes], length: int = LENGTH, core: int = CORE) -> list[np.ndarray]:
    """Columns (text number, anchor, first window, last window, anchor hash) of all runs.

    ``texts`` together stay below 2**24 bytes; longer ones come in overlapping stretches.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    hashes = prefix_hashes(data, core)
    wide = length - core + 1
    if len(data) < length:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)]
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(key) // wide)
    square = np.full(blocks * wide, np.iinfo(np.uint64).max, dtype=np.uint64)
    square[: len(key)] = key
    square = square.reshape(blocks, wide)
    upto = np.minimum.accumulate(square, axis=1).ravel()
    onward = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - length + 1
    least = np.minimum(onward[:count], upto[wide - 1 : wide - 1 + count])
    place = (least & low).astype(np.int64)
    owner = np.searchsorted(ends, np.arange(count), side="right")
    inside = np.arange(count) + length <= ends[owner]
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    first = np.nonzero(fresh & inside)[0]
    # A run ends where the next begins, or where its text has no further window.
    after = np.append(np.nonzero(fresh)[0], count)
    last = np.minimum(after[np.searchsorted(after, first, side="right")] - 1, ends[owner[first]] - length)
    base = (ends - sizes)[owner[first]]
    return [owner[first], place[first] - base, first - base, last - base, hashes[place[first]]]


def _anchors(docs: DataFrame, length: int, core: int) -> DataFrame:
    """(h, seg, doc, key, first, last): every run of windows of every text."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ids, keys = (frame.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            texts = frame.column(2)
            rows = []
            for i, text in enumerate(texts):
                body = text.as_py()
                for at in range(0, max(1, len(body) - length + 1), 4 * CHUNK_BYTES):
                    rows.append((i, at, body[at : at + 4 * CHUNK_BYTES + length - 1]))
            for lo, hi in slices([len(r[2]) for r in rows], CHUNK_BYTES):
                part = rows[lo:hi]
                owner, _, first, last, h = window_runs([r[2] for r in part], length, core)
                digest = xxhash.xxh64_intdigest
                segs = np.array(
                    [
                        digest(part[o][2][a : b + length])
                        for o, a, b in zip(owner.tolist(), first.tolist(), last.tolist(), strict=True)
                    ],
                    dtype=np.uint64,
                )
                which = np.array([r[0] for r in part], dtype=np.int64)[owner]
                shift = np.array([r[1] for r in part], dtype=np.int64)[owner]
                columns = [h.view(np.int64), segs.view(np.int64), ids[which], keys[which], first + shift, last + shift]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["h", "seg", "doc", "key", "first", "last"]
                )

    return docs.mapInArrow(batches, "h long, seg long, doc long, key long, first long, last long")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, key, packed): the texts, compressed."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for frame in frames:
            packed = [press.compress(t.as_py()) for t in frame.column(2)]
            yield pa.RecordBatch.from_arrays(
                [frame.column(3), frame.column(0), frame.column(1), pa.array(packed, pa.binary())],
                ["doc_id", "doc", "key", "packed"],
            )

    return docs.mapInArrow(batches, "doc_id long, doc long, key long, packed binary")


def _segments(joined: DataFrame, length: int) -> DataFrame:
    """Cut the wanted segments out of their texts."""
    schema = "h long, seg long, n long, doc long, key long, first long, body binary"
    names = ["h", "seg", "n", "doc", "key", "first", "body"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for frame in frames:
            docs, keys, texts, lists = (frame.column(frame.schema.names.index(c)) for c in ("doc", "key", "packed", "wanted"))
            out: list[tuple] = []
            for doc, key, text, wanted in zip(docs.to_pylist(), keys.to_pylist(), texts, lists.to_pylist(), strict=True):
                body = press.decompress(text.as_py())
                out += [
                    (w["h"], w["seg"], w["n"], doc, key, w["first"], body[w["first"] : w["last"] + length]) for w in wanted
                ]
            if out:
                kinds = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
                )

    return joined.mapInArrow(batches, schema)


def repeated_windows(rows: list[tuple], length: int, keep_first: bool) -> list[tuple[int, int, int, int]]:
    """(doc, key, first, last) stretches of repeated starts among segments (doc, key, first, body)."""
    rows = sorted(rows)
    data = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
    sizes = np.array([len(r[3]) for r in rows], dtype=np.int64)
    hashes = prefix_hashes(data, length)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(rows)), counts)
    begin = np.cumsum(sizes) - sizes
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    own = hashes[begin[owner] + inner]
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    repeated = np.zeros(len(own), dtype=bool)
    repeated[order[1:][same]] = True
    if not keep_first:
        repeated[order[:-1][same]] = True
    at = np.nonzero(repeated)[0]
    if not len(at):
        return []
    breaks = np.nonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0))[0]
    starts, stops = at[np.concatenate([[0], breaks + 1])], at[np.append(breaks, len(at) - 1)]
    return [
        (rows[o][0], rows[o][1], rows[o][2] + a, rows[o][2] + b)
        for o, a, b in zip(owner[starts].tolist(), inner[starts].tolist(), inner[stops].tolist(), strict=True)
    ]


def _sorted_in_tasks(segments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    ordered = segments.repartition("h").sortWithinPartitions("h", "seg")
    names = ["doc", "key", "first", "last"]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        before = None

        def finish() -> Iterator[pa.RecordBatch]:
            found = repeated_windows(held, length, keep_first) if held else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names)

        for frame in frames:
            columns = (frame.column(frame.schema.names.index(c)).to_pylist() for c in ("h", "seg", "doc", "key", "first", "body"))
            for h, seg, doc, key, first, body in zip(*columns, strict=True):
                if before == (h, seg):
                    continue  # the same row of the input, repeated
                if before and before[0] != h and size > CHUNK_BYTES:
                    yield from finish()
                    held, size = [], 0
                before = (h, seg)
                held.append((doc, key, first, body))
                size += len(body)
        yield from finish()

    return ordered.mapInArrow(batches, "doc long, key long, first long, last long")


def _sorted_by_spark(segments: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for groups of very many variants: one row per window, equal ones counted."""
    one = segments.dropDuplicates(["h", "seg"])
    index = F.explode(F.sequence(F.lit(0), F.octet_length("body") - length))
    windows = one.select("h", "doc", "key", "first", "body", index.alias("i"))
    window = F.substring("body", F.col("i") + 1, F.lit(length))
    windows = windows.select(
        "h", F.xxhash64(window).alias("w1"), F.xxhash64(F.lit(1), window).alias("w2"), "doc", "key",
        (F.col("first") + F.col("i")).alias("at"),
    )
    runs = windows.groupBy("h", "w1", "w2").agg(
        F.count("*").alias("n"), F.min(F.struct("doc", "key", "at")).alias("least")
    )
    found = windows.join(staged(runs.filter("n > 1"), "repeat-windows"), ["h", "w1", "w2"])
    if keep_first:
        found = found.filter(F.struct("doc", "key", "at") != F.col("least"))
    return found.select("doc", "key", F.col("at").alias("first"), F.col("at").alias("last"))


def repeated_intervals(docs: DataFrame, length: int, keep_first: bool, crowded: int, core: int = CORE) -> DataFrame:
    """(doc, key, spans): for each text with repeats, stretches of repeated starts (in no order)."""
    found = _anchors(docs, length, core)
    # Written, so that the joins below read plain tables on both sides and hot hashes can be split.
    # These tables grow with the input, so no join broadcasts them, however small they are here.
    common = staged(found.groupBy("h").count().filter("count > 1").select("h"), "repeat-hashes")
    runs = staged(found.join(common.hint("merge"), "h"), "repeat-runs")
    place = F.struct("doc", "key", "first", "last")
    variants = runs.groupBy("h", "seg").agg(F.count("*").alias("m"), F.min(place).alias("rep"))
    variants = staged(variants, "repeat-variants")

    # Runs with equal bytes: every start repeats (in the first of them, only for removing all).
    whole = runs.join(variants.filter("m > 1").hint("merge"), ["h", "seg"])
    if keep_first:
        whole = whole.filter(place != F.col("rep"))
    whole = whole.select("doc", "key", "first", "last")

    sizes = variants.groupBy("h").count().filter("count > 1").withColumnRenamed("count", "n")
    sizes = staged(sizes, "repeat-sizes")
    wanted = variants.join(sizes.hint("merge"), "h").select("h", "seg", "n", "rep.*")
    lists = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("h", "seg", "n", "first", "last")).alias("wanted"))
    segments = staged(_segments(_packed(docs).join(lists.hint("merge"), ["doc", "key"]), length), "repeat-segments")
    # ``n``, the group's number of variants, came along, so that no join is needed to tell them.
    partial = _sorted_in_tasks(segments.filter(F.col("n") <= crowded), length, keep_first)
    partial = partial.unionByName(_sorted_by_spark(segments.filter(F.col("n") > crowded), length, keep_first))
    every = whole.unionByName(partial)
    return every.groupBy("doc", "key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _cut(docs: DataFrame, spans: DataFrame, length: int, texts: bool) -> DataFrame:
    """Remove the spans; with the remaining text too, if asked for."""
    joined = _packed(docs).join(spans.hint("merge"), ["doc", "key"], "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if texts else ""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for frame in frames:
            columns = [frame.column(frame.schema.names.index(c)) for c in ("doc_id", "packed", "spans")]
            out: list[tuple] = []
            for doc_id, packed, found in zip(columns[0].to_pylist(), columns[1], columns[2].to_pylist(), strict=True):
                body = press.decompress(packed.as_py())
                kept, at, removed, count = [], 0, 0, 0
                for a, b in sorted((s["first"], s["last"] + length) for s in found or ()):
                    if a > at or not count:
                        kept.append(body[at:a])
                        removed += b - a
                        count += 1
                        at = b
                    elif b > at:
                        removed += b - at
                        at = b
                kept.append(body[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(body), removed, count, hashlib.sha256(rest).hexdigest(), *([rest] if texts else [])))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names
                )

    return joined.mapInArrow(batches, schema)


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    keep_first: bool = False,
    texts: bool = False,
    crowded: int = CROWDED,
    core: int = CORE,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row of ``docs``.

    Removes each byte covered by a ``length``-byte string that also starts elsewhere, in the same
    or another text; with ``keep_first``, only where it starts earlier, by (doc_id, place). Matches
    never cross texts and are judged on the input. Null texts count as empty; texts below
    ``length`` bytes stay whole; rows with null ids come before all others; rows that repeat
    both id and text are two places (with ``keep_first``, one). Other columns are not read.
    """
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), data.alias("data"))
    rows = rows.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("data").alias("key"), "data", "doc_id"
    )
    spans = repeated_intervals(rows, length, keep_first, crowded, core)
    return _cut(rows, spans, length, texts)
