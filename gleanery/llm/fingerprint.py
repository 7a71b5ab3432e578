"""Document fingerprints: quartile bucket digests of hashed byte triplets.

A window of five bytes slides over the text; six triplets that hold its first byte are hashed
into 128 buckets and counted. Each bucket's count is coded by its quartile among the 128 (two
bits), the length by its logarithm. The difference of two digests adds quartile distances
(three apart counts double) and a length term, each bounded, so that the score lies in 0..1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import slices

BUCKETS = 128
#: Byte places, in a window of five, of the triplets counted.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
BATCH_BYTES = 1 << 21
LENGTH_STEP = 0.4
LENGTH_WEIGHT = 12
#: Difference at which two digests count as unlike; random texts lie above it.
LARGEST = 200


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """(texts x buckets) counts of hashed triplets; texts under three bytes have none."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    for lo, hi in slices([len(t) for t in texts], BATCH_BYTES):
        part = texts[lo:hi]
        for a in range(0, max(map(len, part)), BATCH_BYTES) if len(part) == 1 else (0,):
            # A long text goes through in overlapping stretches.
            now = [part[0][a : a + BATCH_BYTES + 4]] if len(part) == 1 else part
            sizes = np.array([len(t) for t in now])
            data = np.frombuffer(b"".join(now) + bytes(4), dtype=np.uint8).astype(np.uint32)
            n = len(data) - 4
            owner = np.repeat(np.arange(len(now)) * BUCKETS, sizes)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)
            keep = np.arange(n) < BATCH_BYTES if len(part) == 1 else np.ones(n, dtype=bool)
            first = data[:n] * np.uint32(0x9E3779B1)
            for k, (_, y, z) in enumerate(TRIPLETS):
                mixed = first + data[y : n + y] * np.uint32(0x85EBCA77) + data[z : n + z] * np.uint32(0xC2B2AE3D)
                mixed += np.uint32((k * 0x27D4EB2F) & 0xFFFFFFFF)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(0x2C1B3C6D)
                places = (owner + (mixed >> np.uint32(25)))[(left > z) & keep]
                found = np.bincount(places, minlength=(hi - lo) * BUCKETS)
                out[lo:hi] += found.reshape(hi - lo, BUCKETS)
    return out


def digests(texts: list[bytes]) -> list[bytes]:
    """33 bytes each: the coded length, then the quartile codes of the buckets, four a byte."""
    counts = bucket_counts(texts)
    ordered = np.sort(counts, axis=1)
    quartiles = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > quartiles[:, None, :]).sum(axis=2).astype(np.uint8)
    packed = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    lengths = np.array([len(t) for t in texts], dtype=np.float64)
    coded = np.minimum(255, np.floor(np.log1p(lengths) / np.log1p(LENGTH_STEP) * 2)).astype(np.uint8)
    return [bytes([n]) + row.tobytes() for n, row in zip(coded.tolist(), packed, strict=True)]


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """1 for equal digests, falling to 0 as the difference reaches ``LARGEST``."""
    left = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), -1)
    right = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(len(b), -1)
    apart = np.zeros(len(a), dtype=np.int64)
    for shift in (0, 2, 4, 6):
        step = np.abs((left[:, 1:] >> shift & 3).astype(np.int64) - (right[:, 1:] >> shift & 3))
        apart += np.where(step == 3, 6, step).sum(axis=1)
    length = np.abs(left[:, 0].astype(np.int64) - right[:, 0])
    apart += np.minimum(length, LENGTH_WEIGHT)
    return 1.0 - np.minimum(apart, LARGEST) / LARGEST


def _edited(own: str, following: str) -> str:
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


def compare_with_edits(docs: DataFrame, parts: int = 0) -> DataFrame:
    """Digest of each text and of its edited text, and their likeness (see ``op5`` in the README).

    The edited text swaps the last half for the start of the next document's text, by
    descending doc_id, and the last document is followed by the first. Rows with equal ids go
    by their text; rows with null ids come last. Null texts count as empty; a single row
    follows itself; other columns are not read; an empty table gives no rows.

    The text is shuffled once: ids (narrow) give cut points, the rows at a cut go to both
    sides, so each part knows what follows its last row.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        order.alias("_at"),
    )
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.lit([i / parts for i in range(1, parts)] or [0.5])
    found = rows.agg(F.max("_at"), F.percentile_approx("_at", shares, 10 * parts)).first()
    # Each part is headed by an id that exists; the first holds the largest.
    heads = sorted({found[0], *found[1]}, reverse=True) if found[0] is not None else []
    spans = F.array(*(F.lit(h).cast("long") for h in heads[1:]))
    number = F.size(F.filter(spans, lambda h: h >= F.col("_at"))).cast("int")
    copies = F.when(
        F.array_contains(F.array(*(F.lit(h).cast("long") for h in heads)), F.col("_at")),
        F.array(
            F.struct(F.lit(0).alias("_next"), number.alias("_part")),
            F.struct(F.lit(1).alias("_next"), F.pmod(number - 1, F.lit(max(1, len(heads)))).cast("int").alias("_part")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("_next"), number.alias("_part"))))
    dealt = rows.select("doc_id", "text", "_at", F.inline(copies))
    dealt = dealt.repartition(max(1, len(heads)), "_part").sortWithinPartitions(
        "_part", "_next", F.desc("_at"), "text"
    )
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [c.split()[0] for c in columns.split(", ")]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        for frame in frames:
            ids, texts, nexts, numbers = (frame.column(frame.schema.names.index(c)) for c in ("doc_id", "text", "_next", "_part"))
            for doc_id, text, after, part in zip(ids, texts, nexts.to_pylist(), numbers.to_pylist(), strict=True):
                if held and held[-1][2] and held[-1][3] == part:
                    continue  # only the first row of the next part counts
                held.append((doc_id.as_py(), text.as_py(), after, part))
                chars += len(held[-1][1])
                if chars > BATCH_BYTES or len(held) >= 1024:
                    yield from finish(held)
                    held, chars = held[-1:], 0
        yield from finish(held)

    def finish(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [(a, b) for a, b in zip(held, held[1:], strict=False) if not a[2]]
        for lo, hi in slices([len(a[1]) for a, _ in pairs], BATCH_BYTES):
            part = pairs[lo:hi]
            own = [a[1].encode() for a, _ in part]
            edited = [_edited(a[1], b[1]).encode() for a, b in part]
            follow = [b[1].encode() for _, b in part]
            prints = digests([*own, follow[-1]])
            changed = digests(edited)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in part], pa.int64()),
                    pa.array([len(a[1]) for a, _ in part], pa.int64()),
                    pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                    pa.array([p.hex() for p in prints[:-1]]),
                    pa.array([p.hex() for p in changed]),
                    pa.array(likeness(prints[:-1], changed)),
                    pa.array(likeness(prints[:-1], prints[1:])),
                ],
                names,
            )

    return dealt.mapInArrow(batches, columns)
