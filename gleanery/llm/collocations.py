"""Phrase collocations by Toivonen mining: a sample proposes, full passes count exactly.

1. *Sample.* One in ``sample_one_in`` texts, dealt by a hash, is counted. Phrases below the longest
   length that occur there at least ``sample_count`` times are proposed. The support asked for is
   a fixed, small count, so no sample can propose all; one that proposes few wrong ones is cheapest.
2. *Full pass.* Over all texts it counts every word, and every longer phrase whose two parts of one
   word less (all but its last, all but its first word) are proposed: the proposed phrases and
   their negative border, exactly.
3. *Border failures.* Where a phrase outside the proposal turns out frequent, phrases over it were
   not counted. Another pass counts those that rest on known frequent phrases and that no earlier
   pass has counted; this repeats until no pass finds a new frequent phrase to build on.
   Every frequent phrase then has its exact count, whatever the sample held.
4. *Scores.* Counts of the two sides of every cut meet their phrase by joins; hot words
   ("the ...") are cut into slices. All products are 38-digit whole numbers.

Which phrases are proposed or known travels to the tasks as one bitmap a length, of a fixed number of
bits. A wrongly set bit only lets a phrase be counted that need not have been, and what a pass has
counted is judged by the bits of all parts, as that pass did, so the bitmaps never change a result. Texts are counted in stretches; no list of a language or word is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import staged
from gleanery.operators.lookup import lookup

#: One in so many texts is in the sample, and so often must a phrase occur there to be proposed.
SAMPLE_ONE_IN = 16
SAMPLE_COUNT = 3
#: Bits of a bitmap, as a power of two: 4 MB a length.
BITS = 25
PAGE = 1 << 13
#: Words whose phrases are counted together in a task, and distinct ones among them, at most.
STRETCH_WORDS = 1_500_000
STRETCH_DISTINCT = 250_000
SLICE_BYTES = 1 << 18
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
BREAK = b"."
#: Capitals A-Z to small letters, tabs to blanks, every piece border to a full stop.
TABLE = bytes(
    BREAK[0] if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else 32 if b == 9 else b for b in range(256)
)
#: One key a phrase: its number of words (1 byte), the length of the language's name (2), both texts.
COUNTS = "key binary, f long"


def _mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all but the last word and of the last word."""
    x = left * SPREAD + right
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def tokens(text: str) -> list[bytes]:
    """Words in order, with a full stop (never part of a word) at every border of pieces."""
    return text.encode().translate(TABLE).replace(BREAK, b" . ").split()


def _slices(text: str) -> Iterator[str]:
    """The text in stretches that end at a border or blank; one longer word stays whole."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        end = at + SLICE_BYTES
        while end < len(text) and text[end] not in " \t.,;:!?\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


class Stretch:
    """Word numbers of one language's texts, gathered until their phrases are counted."""

    def __init__(self, lang: str) -> None:
        self.lang = lang
        self.numbers: dict[bytes, int] = {BREAK: 0}
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        number = self.numbers.setdefault
        for part in _slices(text):
            found = [number(w, len(self.numbers)) for w in tokens(part)]
            self.codes.append(np.array(found, dtype=np.int32))
            self.size += len(found)
        self.codes.append(np.zeros(1, dtype=np.int32))
        self.size += 1

    def counts(self, longest: int, now: list[np.ndarray] | None, before: list[list[np.ndarray]], words: bool):
        """(n, phrases, counts) for n words up to ``longest``.

        ``now`` holds a bitmap a length: a phrase counts when both its parts, and theirs in turn, are
        set there, and no list of ``before`` has them all. Without ``now`` every phrase counts.
        ``words``: also give single words, and their total as n = 0.
        """
        codes = np.concatenate(self.codes)
        vocabulary = list(self.numbers)
        spelled = pa.array(vocabulary, pa.binary())
        base = len(vocabulary)
        hashed = word_hashes(self.lang, vocabulary)
        if words:
            times = np.bincount(codes, minlength=base)
            yield 0, pa.array([b""], pa.binary()), times[1:].sum(keepdims=True)
            yield 1, spelled.slice(1), times[1:]
        # Per place: number of the phrase of n words that starts there (-1: none that can matter).
        place = np.where(codes == 0, np.int32(-1), codes)
        grams, names = hashed, spelled
        blank = pa.scalar(b" ", pa.binary())
        # Per list of ``before``: which phrases its pass met. One whose own bit is set there but not
        # those of its parts (by chance alone) was not, and nothing over it was counted.
        met = [np.ones(base, dtype=bool) for _ in before]
        for n in range(2, longest + 1):
            usable = (place >= 0) & _set_in(grams, now, n - 1)[place]
            left = np.nonzero(usable[:-1] & usable[1:])[0].astype(np.int32)
            del usable
            key, distinct = pd.factorize(place[left].astype(np.int64) * base + codes[left + (n - 1)])
            if not len(distinct):
                return
            key = key.astype(np.int32)
            head, tail = distinct // base, distinct % base
            new_names = pa.compute.binary_join_element_wise(names.take(pa.array(head)), spelled.take(pa.array(tail)), blank)
            fresh = np.ones(len(distinct), dtype=bool)
            if before:
                first = np.empty(len(distinct), dtype=np.int32)
                first[key[::-1]] = left[::-1]
                second = place[first + 1]
                for i, bitmaps in enumerate(before):
                    usable = met[i] & _set_in(grams, bitmaps, n - 1)
                    met[i] = usable[head] & usable[second]
                    fresh &= ~met[i]
            at = np.nonzero(fresh)[0]
            if len(at):
                yield n, new_names.take(pa.array(at)), np.bincount(key, minlength=len(distinct))[at]
            if n < longest:
                grams, names = _mixed(grams[head], hashed[tail]), new_names
                place = np.full(len(codes), -1, dtype=np.int32)
                place[left] = key


def _set_in(hashes: np.ndarray, bitmaps: list[np.ndarray] | None, n: int) -> np.ndarray:
    if bitmaps is None:
        return np.ones(len(hashes), dtype=bool)
    slot = hashes >> np.uint64(64 - BITS)
    return (bitmaps[n][(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _counted(
    texts: DataFrame, longest: int, now: list[np.ndarray] | None, before: list[list[np.ndarray]], words: bool, least: int
) -> DataFrame:
    """(lang, n, phrase, f): the phrases that one pass counts ``least`` times or more, and totals."""

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Stretch] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, stretch in held.items():
                name = lang.encode()
                for n, phrases, times in stretch.counts(longest, now, before, words):
                    start = pa.scalar(bytes([n]) + len(name).to_bytes(2, "big") + name, pa.binary())
                    for lo in range(0, len(phrases), 50_000):
                        keys = pa.compute.binary_join_element_wise(start, phrases.slice(lo, 50_000), b"")
                        yield pa.RecordBatch.from_arrays([keys, pa.array(times[lo : lo + 50_000], pa.int64())], ["key", "f"])

        for frame in frames:
            for lang, text in zip(frame.column("lang").to_pylist(), frame.column("text"), strict=True):
                held.setdefault(lang, Stretch(lang)).add(text.as_py())
                if sum(s.size for s in held.values()) > STRETCH_WORDS or sum(len(s.numbers) for s in held.values()) > STRETCH_DISTINCT:
                    yield from give()
                    held = {}
        yield from give()

    counts = texts.select("lang", "text").mapInArrow(count, COUNTS).groupBy("key").agg(F.sum("f").alias("f"))
    total = F.substring("key", 1, 1) == F.lit(b"\0")
    counts = counts.filter((F.col("f") >= least) | total)
    size = F.conv(F.hex(F.substring("key", 2, 2)), 16, 10).cast("int")
    named = counts.withColumn("_size", size)
    return named.select(
        F.substring("key", F.lit(4), F.col("_size")).cast("string").alias("lang"),
        F.conv(F.hex(F.substring("key", 1, 1)), 16, 10).cast("int").alias("n"),
        F.expr("substring(key, 4 + _size)").alias("phrase"),
        "f",
    )


def bitmaps(phrases: DataFrame, longest: int) -> list[np.ndarray]:
    """Per length a bitmap of the phrases (lang, n, phrase), made in pages of which the driver gets each once."""

    def slots(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            rows = zip(*(frame.column(c).to_pylist() for c in ("lang", "n", "phrase")), strict=True)
            found = []
            for lang, n, phrase in rows:
                hashed = word_hashes(lang, phrase.split(b" "))
                whole = reduce(_mixed, (hashed[i : i + 1] for i in range(1, len(hashed))), hashed[:1])
                found.append((n, int(whole[0]) >> (64 - BITS)))
            if found:
                n, slot = (np.array(c, dtype=np.int64) for c in zip(*found, strict=True))
                mask = np.uint64(1) << (slot & 63).astype(np.uint64)
                columns = [pa.array(n, pa.int32()), pa.array(slot >> 6, pa.int32()), pa.array(mask.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["n", "word", "mask"])

    def page(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        body = np.zeros(PAGE, dtype=np.uint64)
        body[rows["word"].to_numpy() % PAGE] = rows["mask"].to_numpy().view(np.uint64)
        return pd.DataFrame({"n": [key[0]], "page": [key[1]], "body": [body.tobytes()]})

    maps = [np.zeros((1 << (BITS - 6)) if n else 0, dtype=np.uint64) for n in range(longest)]
    marked = phrases.select("lang", "n", "phrase").mapInArrow(slots, "n int, word int, mask long")
    merged = marked.groupBy("n", "word").agg(F.bit_or("mask").alias("mask"))
    pages = merged.groupBy("n", F.floor(F.col("word") / PAGE).cast("int").alias("page")).applyInPandas(page, "n int, page int, body binary")
    for r in pages.toLocalIterator():
        maps[r.n][r.page * PAGE : (r.page + 1) * PAGE] = np.frombuffer(r.body, dtype=np.uint64)
    return maps


def frequent_phrases(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    sample_one_in: int = SAMPLE_ONE_IN,
    sample_count: int = SAMPLE_COUNT,
) -> tuple[DataFrame, int]:
    """(lang, n, phrase, f) of all phrases of up to ``longest`` words with f >= ``least``, and the number
    of full passes it took. Rows with n = 0 hold each language's number of words."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    texts = docs.select(lang, text, F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample_one_in)).alias("_part"))
    proposed = _counted(texts.filter("_part = 0"), longest - 1, None, [], True, sample_count)
    proposed = staged(proposed.filter("n > 0"), "phrases-proposed")
    now, before, passes, parts = bitmaps(proposed, longest), [], 0, []
    while True:
        parts.append(staged(_counted(texts, longest, now, before, not passes, least), f"phrases-{passes}"))
        passes += 1
        before.append(now)
        frequent = reduce(DataFrame.unionByName, parts)
        known = bitmaps(frequent.filter((F.col("n") > 0) & (F.col("n") < longest)), longest)
        # Closed when a pass has counted all that rests on known phrases of every length.
        if any(all(not (k & ~b).any() for k, b in zip(known, old, strict=True)) for old in before):
            return frequent, passes
        now = known


def scored(frequent: DataFrame, longest: int = 3, drop_percent: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that stay."""
    rows = frequent.filter("n > 0").select("lang", "n", F.col("phrase").cast("string").alias("phrase"), "f")
    words = F.split("phrase", " ")
    cand = rows.filter("n > 1").withColumn("w", words)
    cuts = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.col("n") - 1),
                lambda k: F.array(
                    F.struct(k.alias("k"), F.lit(0).alias("side"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("part")),
                    F.struct(k.alias("k"), F.lit(1).alias("side"), F.array_join(F.slice("w", k + 1, F.col("n") - k), " ").alias("part")),
                ),
            )
        )
    )
    sides = staged(cand.select("lang", "phrase", F.col("f").alias("a"), cuts.alias("c")).select("lang", "phrase", "a", "c.*"), "phrase-sides")
    dim = rows.select("lang", F.col("phrase").alias("part"), "f")
    met = lookup(sides, dim, ["lang", "part"], ["phrase"], "inner")
    none = F.lit(None).cast("long")
    # A phrase one word longer holds any longer one's count or more, so it alone decides the drop.
    ends = [F.array_join(F.slice("w", F.lit(1), F.col("n") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("n") - 1), " ")]
    longer = cand.filter("n > 2").select("lang", F.explode(F.array(*ends)).alias("phrase"), F.col("f").alias("longer"))
    both = met.withColumn("longer", none).select("lang", "phrase", "a", "k", "side", "f", "longer").unionByName(
        longer.select("lang", "phrase", none.alias("a"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("int").alias("side"), none.alias("f"), "longer")
    )
    count = {
        f"{'lr'[side]}{k}": F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
        for k in range(1, longest)
        for side in (0, 1)
    }
    per = both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *(c.alias(n) for n, c in count.items()))
    kept = per.filter(F.col("a").isNotNull() & (F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * drop_percent)))

    def cut(k: int):
        exact = [F.col(c).cast("decimal(16,0)") for c in ("a", f"l{k}", f"r{k}")]
        top = (exact[0] * exact[0]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
        score = F.call_function("div", top, exact[1] * exact[2])
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    lowest = F.least(*(cut(k) for k in range(1, longest))) if longest > 2 else cut(1)
    return kept.select("lang", "phrase", "a", lowest.alias("s")).select("lang", "phrase", "a", "s.l", "s.r", F.col("s.score").cast("long").alias("score"))


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    top: int = 2000,
    drop_percent: int = 50,
    sample_one_in: int = SAMPLE_ONE_IN,
    sample_count: int = SAMPLE_COUNT,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    Reads doc_id, text and lang of ``docs``; other columns are ignored. Null languages are ``und``,
    null texts empty; rows that repeat count each; a language without words, and an empty table, give
    no rows. Phrases of 2 to ``longest`` words within a piece count every place, overlaps included.
    Ties in score go to the larger count, then to the phrase that comes first by its bytes. Counts
    are exact up to 10**15.
    """
    frequent, _ = frequent_phrases(docs, longest, least, sample_one_in, sample_count)
    ranked = scored(frequent, longest, drop_percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within hashed parts of a language, so that the last window only meets ``top`` rows a part.
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = ranked.withColumn("_part", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    last = first.filter(F.col("_r") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = frequent.filter("n = 0").select("lang", F.col("f").alias("n"))
    return (
        last.filter(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
