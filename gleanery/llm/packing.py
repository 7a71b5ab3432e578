"""Best-fit packing of token sequences by patterns and non-negative least squares.

The pieces to pack enter as a histogram of lengths (at most ``capacity`` numbers, whatever the
data). Patterns of one to four lengths that fill a sequence exactly are enumerated; repeat
counts that fit the histogram are found by non-negative least squares, rounded down and
kept within what is there; the rest is packed best fit, longest first, run by run. The plan is
a table of runs "pieces number a.. of length l go to sequences s.., at offset o"; its size
depends on the number of distinct lengths only. Pieces are numbered within their length in
balanced blocks and joined to their run.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import running_before, slices, staged

CAPACITY = 4096
END_ID = 1
BATCH_BYTES = 1 << 21
#: Words a worker keeps the ids of; words met later are looked up anew in each batch.
CACHE_WORDS = 750_000
#: Lengths (the most frequent) from which the inner members of longer patterns are taken.
COMMON_LENGTHS = 24
SWEEPS = 40

#: The parts, by the tokenizer's own pattern, of a word of printable ASCII characters in small letters.
_printable = re.compile(rb"[\x21-\x7e]+").fullmatch
_parts = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
PROBE = "".join(map(chr, range(0x21, 0x7F))) + "ab'SCd'tx'Ree'veF'm're12'llo''d'!'s--'tis"

_caches: dict[str, tuple] = {}


def _tokenizer(path: str) -> tuple:
    """The tokenizer, the ids of words met, and its model if it parts printable words as ``_parts`` does."""
    if path not in _caches:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model = None
        if tokenizer.normalizer and tokenizer.pre_tokenizer:
            split = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(PROBE))
            if [p.encode() for p, _ in split] == _parts(PROBE.lower().encode()):
                model = tokenizer.model
        _caches[path] = (tokenizer, {}, model)
    return _caches[path]


def _words(text: bytes) -> list[bytes]:
    # The tokenizer lowers letters itself; doing so first lets more words agree. Marks that may
    # compose with a letter (U+0300 to U+036F) and special tokens tell cases apart, though.
    if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
        text = text.lower()
    return text.split()


def _ids_by_parts(words: list[bytes], known: dict[bytes, bytes], model) -> dict[bytes, bytes]:
    """The ids of printable words, and of their parts, each of which is a word of its own."""
    out: dict[bytes, bytes] = {}
    for word in words:
        found = []
        for part in _parts(word.lower()):
            ids = known.get(part) or out.get(part)
            if ids is None:
                tokens = [t.id for t in model.tokenize(part.decode())]
                ids = out[part] = struct.pack(f"<{len(tokens)}I", *tokens)
            found.append(ids)
        out[word] = b"".join(found)
    return out


def token_bytes(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers.

    The tokenizer never joins across ASCII white space, so a text's ids are those of its
    words in turn, and each word is looked up once. Words of printable ASCII go part by part to the
    tokenizer's model, which saves its work on single words; all others are encoded whole.
    """
    tokenizer, known, model = _tokenizer(path)
    split = [_words(t) for t in texts]
    # A small table of the batch's own words is quicker to look up in than the worker's large one.
    here = {w: known.get(w) for w in set(chain.from_iterable(split))}
    new = [w for w, ids in here.items() if ids is None]
    fresh: dict[bytes, bytes] = {}
    if model is not None:
        plain = [_printable(w) is not None and b"<|" not in w for w in new]
        fresh = _ids_by_parts([w for w, p in zip(new, plain, strict=True) if p], known, model)
        new = [w for w, p in zip(new, plain, strict=True) if not p]
    for i in range(0, len(new), 10_000):
        some = new[i : i + 10_000]
        ids = tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
        fresh.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(some, ids, strict=True))
    if len(known) < CACHE_WORDS:
        known.update(fresh)
    here.update(fresh)
    return [b"".join(map(here.__getitem__, words)) for words in split]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents, cut only above ``capacity``."""
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for frame in frames:
            rows: list[tuple] = []
            ids = frame.column(0).to_pylist()
            texts = [t.as_py() or b"" for t in frame.column(1).cast(pa.large_binary())]
            for lo, hi in slices([len(t) for t in texts], BATCH_BYTES):
                for doc_id, tokens in zip(ids[lo:hi], token_bytes(texts[lo:hi], path), strict=True):
                    tokens += end
                    for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = tokens[at : at + 4 * capacity]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(batches, schema)


def enumerate_patterns(counts: dict[int, int], capacity: int, common: int = COMMON_LENGTHS) -> list[tuple[int, ...]]:
    """Multisets of one to four of the lengths that add up to ``capacity``, longest first."""
    present = sorted(counts)
    have = set(present)
    frequent = sorted(sorted(counts, key=lambda x: (-counts[x], x))[:common])
    found = {(capacity,)} & {(x,) for x in have}
    for a in present:
        if capacity - a in have:
            found.add(tuple(sorted((a, capacity - a), reverse=True)))
        for i, b in enumerate(frequent):
            if capacity - a - b in have:
                found.add(tuple(sorted((a, b, capacity - a - b), reverse=True)))
            for c in frequent[i:]:
                if capacity - a - b - c in have:
                    found.add(tuple(sorted((a, b, c, capacity - a - b - c), reverse=True)))
    return sorted(found, reverse=True)


def fit_counts(patterns: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative repeat counts x that least-squares fit the histogram, by coordinate descent."""
    if not patterns:
        return []
    values = [0.0] * (max(counts) + 1)
    for length, n in counts.items():
        values[length] = float(n)
    norm = [sum(p.count(v) for v in p) for p in patterns]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, p in enumerate(patterns):
            room = 0.0
            for v in p:  # a length that stands twice counts twice
                room += values[v]
            step = max(room / norm[i], -x[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for v in p:
                    values[v] -= step
        if moved < 0.5:
            break
    return x


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first, count, sequence, offset) that place every piece, and the number of sequences.

    Pieces ``first``.. of a length go one each to sequences ``sequence``.. at ``offset``.
    """
    left = {k: v for k, v in counts.items() if v}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    patterns = enumerate_patterns(left, capacity)
    for pattern, repeat in zip(patterns, fit_counts(patterns, left), strict=True):
        n = min(int(repeat), *(left[v] // pattern.count(v) for v in pattern))
        if n > 0:
            offset = 0
            for length in pattern:
                place(length, n, sequences, offset)
                offset += length
            sequences += n

    # Residuals: best fit, longest first. Open sequences with equal room are kept as ranges.
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def reopen(room: int, sequence: int, n: int) -> None:
        if room:
            if not ranges[room]:
                insort(rooms, room)
            ranges[room].append((sequence, n))

    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left[length])
                n = left[length] // each
                for k in range(each):
                    place(length, n, sequences, k * length)
                reopen(capacity - each * length, sequences, n)
                sequences += n
                continue
            room = rooms[at]
            sequence, n = ranges[room].pop()
            if not ranges[room]:
                rooms.pop(at)
            taken = min(n, left[length])
            if n > taken:
                reopen(room, sequence + taken, n - taken)
            place(length, taken, sequence, capacity - room)
            reopen(room - length, sequence, taken)
    return runs, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, piece, start, length, ids_crc32)."""
    pieces = staged(pieces, "pack-pieces")
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = plan_runs(histogram, capacity)
    spark = pieces.sparkSession
    schema = "length long, _first long, _count long, _sequence long, offset long"
    # At most a few runs per distinct length, of which there are ``capacity`` at most.
    plan = F.broadcast(spark.createDataFrame(runs, schema))
    hashed = pieces.withColumn("_h", F.xxhash64(*keys))
    numbered = running_before(hashed, ["length"], "_h", keys, {"_n": F.lit(1)}, sum(histogram.values()))
    inside = (F.col("_n") >= F.col("_first")) & (F.col("_n") < F.col("_first") + F.col("_count"))
    placed = numbered.join(plan, "length").filter(inside)
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_sequence") + F.col("_n") - F.col("_first")).alias("sequence_id"),
        "offset",
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of every document: where it starts in it, and where it lies in a sequence.

    A null or empty text is the end id alone. Null ids and repeated rows are documents like any
    other; an empty table gives no rows; other columns are not read.
    """
    return pack(token_pieces(docs, path, capacity, end_id), capacity)
