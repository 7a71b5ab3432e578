"""Whitening of embeddings from a bit-sliced scatter matrix.

1. *Lattice.* Every entry c becomes the whole number floor(256 * c). The fit list holds each
   distinct vector of whole numbers once, so copies, however many, weigh as one.
2. *Bit planes.* A block of vectors is shifted by its least entry per dimension. Each bit of each
   dimension becomes one plane: the bits of 64 rows in a word. The sum of products of two dimensions
   is the sum over pairs of their planes of 2**(a + b) times the bits that the two planes share
   (AND, popcount). No product of entries is formed and nothing is rounded.
3. *Centring.* Sums of several tasks meet in Spark as 31-bit limbs, so they never overflow. With n
   vectors, sums S and cross-products C, n * C - S S' is n * n times the covariance, a matrix of
   whole numbers; it is divided once, then split by ``eigh``.
4. *Projection.* Every row is projected in tasks; the covariance of the projections is
   measured again over the whole fit list.

What reaches the driver is bounded by the square of the dimension, not by the rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import staged

SCALE = 256
COMPONENTS = 4
#: Rows whose planes are held and compared at a time; a multiple of 64.
BLOCK = 8192
LIMB = 31
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """floor(256 * c) as 64-bit numbers; beyond their range, the nearest one."""
    with np.errstate(over="ignore"):
        scaled = np.floor(entries.astype(np.float64) * SCALE)
    inside = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(scaled >= 2.0**63, MOST_LONG, inside)


def _narrow(x: np.ndarray) -> list[bytes]:
    """One byte string per vector, of the narrowest width that holds it; equal vectors, equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    left = np.ones(len(x), dtype=bool)
    for width in (1, 2, 4, 8):
        limits = np.iinfo(f"i{width}")
        fits = left & (low >= limits.min) & (high <= limits.max)
        body = x[fits].astype(f"<i{width}")
        for at, row in zip(np.nonzero(fits)[0].tolist(), body, strict=True):
            out[at] = bytes([width]) + row.tobytes()
        left &= ~fits
    return out


def _wide(packed: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(p, f"<i{p[0]}", offset=1).astype(np.int64) for p in packed], dtype=np.int64)


def bit_planes(shifted: np.ndarray) -> np.ndarray:
    """Planes (dimension, bit, word) of a block of numbers that are not negative."""
    rows, width = shifted.shape
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    padded = np.zeros((-(-rows // 64) * 64, width), dtype=np.uint64)
    padded[:rows] = shifted
    planes = np.empty((width, bits, len(padded) // 64), dtype=np.uint64)
    for b in range(bits):
        flags = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[:, b] = np.packbits(np.ascontiguousarray(flags.T), axis=1, bitorder="little").view("<u8")
    return planes


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums per dimension and the upper triangle of all cross-products, exact for any entries."""
    width = x.shape[1]
    least = x.min(axis=0)
    planes = bit_planes(x.view(np.uint64) - least.view(np.uint64))
    bits = planes.shape[1]
    alone = np.bitwise_count(planes).sum(axis=2, dtype=np.int64)
    plain = 2 * bits + len(x).bit_length() <= 62
    weights = np.array([1 << b for b in range(bits)], dtype=np.int64 if plain else object)
    shifted = (alone * weights).sum(axis=1)
    base = [int(v) for v in least]
    own = [int(v) for v in shifted]
    sums = [s + len(x) * m for s, m in zip(own, base, strict=True)]
    cross = []
    for i in range(width):
        total = 0
        for a in range(bits):
            shared = np.bitwise_count(planes[i:] & planes[i, a]).sum(axis=2, dtype=np.int64)
            total = total + (shared * weights).sum(axis=1) * int(weights[a])
        cross.append(
            [
                int(t) + base[i] * own[j] + base[j] * own[i] + len(x) * base[i] * base[j]
                for j, t in enumerate(total, start=i)
            ]
        )
    return sums, cross


def _limbs(value: int) -> list[int]:
    sign, left, out = (-1 if value < 0 else 1), abs(value), []
    while left:
        out.append(sign * (left & ((1 << LIMB) - 1)))
        left >>= LIMB
    return out


@dataclass(frozen=True)
class Whitening:
    """n fit vectors, their sums, and the leading components of their covariance."""

    n: int
    sums: list[int]
    values: list[float]
    vectors: list[list[float]]
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as doubles, rounded once per entry."""
        bound = self.n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) + max(map(abs, self.sums))
        if bound < 1 << 62:
            return (self.n * x - np.array(self.sums, dtype=np.int64)).astype(np.float64)
        return (self.n * x.astype(object) - np.array(self.sums, dtype=object)).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exact; None where a 64-bit number cannot hold one."""
        top = self.n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) + max(map(abs, self.sums))
        if top * top * x.shape[1] <= MOST_LONG:
            apart = self.n * x - np.array(self.sums, dtype=np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return [v if v <= MOST_LONG else None for v in (apart * apart).sum(axis=1).tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the roots of their variances; 0 where there is no variance."""
        along = self.centred(x) / self.n @ np.array(self.vectors).T
        return along * np.array([v**-0.5 if v > 0 else 0.0 for v in self.values])


def _clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with vectors whose entries are all there and finite."""
    v = F.col("embedding")
    number = v.cast("array<double>")
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("v"))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def _width(rows: DataFrame) -> int | None:
    """The length most vectors have (of equally common ones the largest)."""
    lengths = rows.groupBy(F.size("v").alias("d")).count()
    most = lengths.agg(F.max(F.struct("count", "d")).alias("m")).first().m
    return most and most.d


def _entries(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distinct_vectors(rows: DataFrame, width: int) -> DataFrame:
    """(packed): each distinct vector of whole numbers once."""

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                found = dict.fromkeys(_narrow(whole_numbers(_entries(frame.column("v"), width))))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["packed"])

    return rows.select("v").mapInArrow(pack, "packed binary").distinct()


def _blocks(frames: Iterator[pa.RecordBatch], block: int) -> Iterator[np.ndarray]:
    held: list[bytes] = []
    for frame in frames:
        held += frame.column("packed").to_pylist()
        while len(held) >= block:
            yield _wide(held[:block])
            held = held[block:]
    if held:
        yield _wide(held)


def exact_sums(fit: DataFrame, block: int = BLOCK) -> tuple[int, dict[tuple[int, int], int]]:
    """Number of vectors, and sums by (-1, dimension) or (dimension, dimension)."""

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = defaultdict(int)
        for x in _blocks(frames, block):
            sums, cross = scatter(x)
            total[-1, -1] += len(x)
            for i, s in enumerate(sums):
                total[-1, i] += s
            for i, row in enumerate(cross):
                for j, c in enumerate(row, start=i):
                    total[i, j] += c
        rows = [(i, j, k, part) for (i, j), value in total.items() for k, part in enumerate(_limbs(value))]
        if rows:
            kinds = [pa.int32()] * 3 + [pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "limb", "part"])

    parts = fit.mapInArrow(add, "i int, j int, limb int, part long").groupBy("i", "j", "limb").agg(F.sum("part").alias("part"))
    sums: dict[tuple[int, int], int] = defaultdict(int)
    for r in parts.collect():  # at most dimension * (dimension + 3) / 2 numbers of a few limbs
        sums[r.i, r.j] += r.part << (LIMB * r.limb)
    return sums.pop((-1, -1), 0), sums


def fit_components(n: int, sums: dict[tuple[int, int], int], width: int, components: int = COMPONENTS) -> Whitening:
    """Leading eigenvectors of the covariance, from whole numbers divided once."""
    s = [sums.get((-1, i), 0) for i in range(width)]
    v = np.zeros((width, width))
    trace = 0
    for i in range(width):
        for j in range(i, width):
            whole = n * sums.get((i, j), 0) - s[i] * s[j]
            v[i, j] = v[j, i] = whole / (n * n)
            trace += whole if i == j else 0
    total = trace / (n * n)
    values, vectors = np.linalg.eigh(v)
    top = np.argsort(-values, kind="stable")[:components]
    # Beneath this, a value is what rounding leaves of 0.
    floor = max(float(values.max()), 0.0) * width * np.finfo(np.float64).eps
    kept = [float(values[t]) if values[t] > floor else 0.0 for t in top]
    return Whitening(n, s, kept, [vectors[:, t].tolist() for t in top], [e / total if total else 0.0 for e in kept])


def identity_error(fit: DataFrame, model: Whitening, block: int = BLOCK) -> float:
    """Largest entry by which the whitened fit list's covariance differs from the identity.

    Over the components that vary. The mean of the projections is 0 but for rounding, so the sums of
    their products lose nothing when it is taken off.
    """
    axes = [k for k, e in enumerate(model.values) if e > 0]
    if not axes:
        return 0.0

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(axes) + 1, len(axes) + 1))
        for x in _blocks(frames, block):
            w = np.column_stack([np.ones(len(x)), model.whitened(x)[:, axes]])
            total += w.T @ w
        i, j = np.indices(total.shape)
        columns = [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "part"])

    parts = fit.mapInArrow(add, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part"))
    second = np.zeros((len(axes) + 1, len(axes) + 1))
    for r in parts.collect():
        second[r.i, r.j] = r.part / model.n
    means = second[0, 1:]
    apart = second[1:, 1:] - np.outer(means, means) - np.eye(len(axes))
    return float(np.abs(apart).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per row and component.

    ``vectors`` is (vec_id, embedding); other columns are not read. Rows whose vector is null, empty,
    or holds null or non-finite entries are dropped, and so are vectors of another length than the
    most common one. Rows that repeat are returned each; null ids stay null. Entries whose whole number
    is beyond 64 bits count as the nearest one; a deviation beyond 64 bits is null. A component without
    variance (one distinct vector, fewer vectors than dimensions) is whitened to 0 and explains 0; the
    error is over the others. Ties between eigenvalues leave the choice of axes to ``eigh``; every row
    uses the same. A table without usable rows gives none.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _clean(vectors)
    width = _width(rows)
    if not width:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == width)
    fit = staged(distinct_vectors(rows, width), "whitening-fit")
    n, sums = exact_sums(fit, block)
    model = fit_components(n, sums, width, components)
    error = identity_error(fit, model, block)
    shown = len(model.values)

    def project(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if not frame.num_rows:
                continue
            x = whole_numbers(_entries(frame.column("v"), width))
            ids = frame.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), shown)))
            apart = pa.array([d for d in model.deviations(x) for _ in range(shown)], pa.int64())
            number = pa.array(np.tile(np.arange(1, shown + 1), len(x)), pa.int32())
            along = pa.array(model.whitened(x).ravel())
            share = pa.array(np.tile(model.explained, len(x)))
            yield pa.RecordBatch.from_arrays([ids, number, apart, along, share], ["vec_id", "component", "deviation", "whitened", "explained"])

    done = rows.mapInArrow(project, "vec_id long, component int, deviation long, whitened double, explained double")
    extra: dict[str, Column] = {"n": F.lit(n).cast("long"), "identity_error": F.lit(error)}
    return done.withColumns(extra).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
