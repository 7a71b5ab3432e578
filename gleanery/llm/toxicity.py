"""Toxicity by maximum-scoring segments of token log-odds.

Fitting (a bounded sample of labelled rows): a word's weight is the log-odds of meeting it in
toxic against clean documents, under a Dirichlet prior in proportion to its overall use; words
whose weight comes near the largest one the prior allows, in a fair share of the toxic documents,
form the lexicon, every other word costs a small drift. Scoring (every whole text): the linear-time scan for all maximal scoring segments
finds the toxic passages; segment scores follow an extreme-value law, so an expected count
``K * n * exp(-lambda * S)`` tells which are significant in a text of ``n`` words. A logistic
curve over these figures, fitted on the same sample, gives the probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import staged

#: Labelled rows the model is fitted on at most, and lexicon entries kept at most.
SAMPLE_ROWS = 20_000
LEXICON_WORDS = 4096
#: A lexicon word reaches this share of the largest weight, and is in this share of toxic texts.
LEAST_WEIGHT = 0.9
LEAST_SUPPORT = 0.008
LEAST_TEXTS = 4
PRIOR_SHARE = 0.02
PRIOR_FLAT = 1.0
LOG_SIGNIFICANT = math.log(0.05)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: ASCII bytes that are not letters or digits separate words; others are kept.
_TABLE = bytes(_LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    drift: float
    lam: float
    log_k: float
    curve: tuple[float, ...]

    def passages(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal scoring segments as (first word, end word, score), left to right."""
        weights = self.weights
        hits = [i for i, w in enumerate(words) if w in weights]
        return maximal_segments([(i, weights[words[i]]) for i in hits], self.drift)

    def log_expected(self, score: float, n: int) -> float:
        """Log of how many segments of this score or more a clean text of n words has on average."""
        return self.log_k + math.log(max(n, 1)) - self.lam * score

    def features(self, words: list[bytes]) -> tuple[float, ...]:
        found = self.passages(words)
        n = len(words)
        best = max((s for _, _, s in found), default=0.0)
        significant = [s for _, _, s in found if self.log_expected(s, n) < LOG_SIGNIFICANT]
        surprise = -self.log_expected(best, n) if found else 0.0
        return (
            1.0,
            float(bool(found)),
            min(best, 20.0) / 10,
            min(max(surprise, 0.0), 20.0) / 10,
            float(min(len(significant), 5)),
        )

    def score(self, text: str | None) -> float:
        x = sum(a * b for a, b in zip(self.curve, self.features(words_of(text)), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, x))))


def maximal_segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments when hits have positive scores and all other places ``-drift``.

    A new segment looks for the last earlier one that starts lower; ``link`` remembers that
    one for each, which keeps the whole scan linear.
    """
    kept: list[list] = []  # [start, end, sum before, sum after, link]
    total, place = 0.0, 0
    for at, weight in hits:
        total -= drift * (at - place)
        place = at + 1
        new = [at, at + 1, total, total + weight, -1]
        total += weight
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                new[4] = j
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


def _fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def held_out(doc_id: Column) -> Column:
    """Rows that no fitting may see: crc32 of the id as text leaves 0 when divided by 5."""
    return _fold(doc_id) == 0


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled rows, chosen by a hash of their id.

    Labels without id or value are not used; of several labels of an id, the largest counts.
    Without any labelled document the model scores every text 0.5 or below alike.
    """
    chosen = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = chosen.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(sample_rows)
    narrow = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    # Bounded: at most sample_rows narrow rows.
    sample = staged(narrow.join(F.broadcast(chosen), "_id").select("text", "_toxic"), "toxic-sample")

    def presence(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            words: list[bytes] = []
            toxic: list[int] = []
            halves: list[int] = []
            for text, label, half in zip(*(frame.column(c).to_pylist() for c in range(3)), strict=True):
                distinct = set(words_of(text))
                words.extend(distinct)
                toxic.extend([label] * len(distinct))
                halves.extend([half] * len(distinct))
            kinds = (pa.binary(), pa.int32(), pa.int32())
            columns = [pa.array(c, k) for c, k in zip((words, toxic, halves), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "toxic", "half"])

    # Copies count once, so that a text copied often doesn't make its rare words look toxic.
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    distinct = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("_toxic").alias("_toxic"))
    distinct = staged(distinct.select("text", "_toxic", half.alias("half")), "toxic-distinct")
    sizes = {(r["half"], r["_toxic"]): r["count"] for r in distinct.groupBy("half", "_toxic").count().collect()}
    counts = distinct.mapInArrow(presence, "word binary, toxic int, half int").groupBy("word")
    counts = counts.agg(
        *(F.sum((F.col("half") == h).cast("int") * F.col("toxic")).alias(f"t{h}") for h in (0, 1)),
        *(F.sum((F.col("half") == h).cast("int")).alias(f"n{h}") for h in (0, 1)),
    ).filter("t0 + t1 > 1")
    counts = staged(counts, "toxic-words")
    length = (sample.agg(F.avg(F.length("text"))).first()[0] or 6.0) / 6
    # The curve is fitted on each half as the other half's lexicon sees it.
    rows: list[tuple[int, list[float]]] = []
    for h in (0, 1):
        other = _lexicon(counts, sizes, (1 - h,), length)
        seen = distinct.filter(F.col("half") == h).select("_toxic", features_of(other)("text").alias("x"))
        rows += [(r["_toxic"], r["x"]) for r in seen.collect()]
    model = _lexicon(counts, sizes, (0, 1), length)
    if rows:
        curve = logistic_fit(np.array([x for _, x in rows]), np.array([float(y) for y, _ in rows]))
        model = replace(model, curve=tuple(map(float, curve)))
    return model


def _lexicon(counts: DataFrame, sizes: dict, halves: tuple[int, ...], length: float) -> ToxicityModel:
    """Lexicon and clean law from the word counts of some halves; ``length`` is words per text."""
    bad, good = (float(sum(sizes.get((h, y), 0) for h in halves)) for y in (1, 0))
    t = sum((F.col(f"t{h}") for h in halves), F.lit(0))
    n = sum((F.col(f"n{h}") for h in halves), F.lit(0))
    bad_mass, good_mass = (x + PRIOR_SHARE * (bad + good) + 1 for x in (bad, good))

    def weight(flat: float) -> Column:
        prior = n * PRIOR_SHARE + flat
        return F.log((t + prior) / bad_mass) - F.log((n - t + prior) / good_mass)

    largest = math.log((1 + PRIOR_SHARE) / PRIOR_SHARE) + math.log(good_mass / bad_mass)
    best = counts.filter((t >= max(LEAST_TEXTS, LEAST_SUPPORT * bad)) & (weight(0.0) >= LEAST_WEIGHT * largest))
    best = best.select("word", t.alias("t"), n.alias("n"), weight(PRIOR_FLAT).alias("weight"))
    best = best.filter("weight > 0").orderBy(F.desc("t"), "word").limit(LEXICON_WORDS).collect()
    weights = {bytes(r["word"]): float(r["weight"]) for r in best}

    # Rates of lexicon words per word of text turn into the drift, and into lambda of the clean law.
    hits_bad = sum(r["t"] for r in best) + 1.0
    hits_good = sum((r["n"] - r["t"]) + PRIOR_SHARE * r["n"] for r in best) + 1.0
    tokens = max(1.0, length)
    q = min(0.5, hits_bad / max(1.0, bad) / tokens)
    p = min(q / 2, hits_good / max(1.0, good) / tokens)
    drift = max(1e-3, math.log((1 - p) / (1 - q)))
    strength = sum(weights.values()) / len(weights) if weights else 1.0
    return ToxicityModel(weights, drift, _root(p, strength, drift), math.log(max(p, 1e-12)), (-1.0, 0.0, 0.0, 0.0, 0.0))


def _root(p: float, strength: float, drift: float) -> float:
    """lambda > 0 with p * exp(lambda * strength) + (1 - p) * exp(-lambda * drift) = 1."""
    low, high = 1e-6, 50.0
    value = lambda x: p * math.exp(min(700, x * strength)) + (1 - p) * math.exp(-x * drift) - 1
    if value(high) <= 0 or value(low) >= 0:
        return 1.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if value(middle) > 0 else (middle, high)
    return high


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Logistic coefficients by Newton steps, kept finite by a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def features_of(model: ToxicityModel):
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([list(model.features(words_of(t))) for t in texts])

    return features


def score_of(model: ToxicityModel):
    """Column function: the probability of label 1 for a text (null counts as empty)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def toxic_passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, first_word, end_word, score, log_expected): every significant passage of every text.

    Words are counted in the text with ASCII punctuation taken as white space.
    """
    schema = "doc_id long, first_word long, end_word long, score double, log_expected double"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                words = words_of(text)
                for a, b, s in model.passages(words):
                    if (e := model.log_expected(s, len(words))) < LOG_SIGNIFICANT:
                        rows.append((None if pd.isna(doc_id) else int(doc_id), a, b, s, e))
            yield pd.DataFrame(rows, columns=["doc_id", "first_word", "end_word", "score", "log_expected"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInPandas(batches, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null texts count as empty and, like all texts without lexicon words, get the base rate of
    such texts. Repeated rows and null ids are scored like others; other columns are not read.
    """
    score = score_of(fit(docs, labels))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        score(F.col("text").cast("string")).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5 by a model fitted on ``labelled``."""
    score = score_of(fit(labelled, labels))
    return docs.filter(score(F.col("text").cast("string")) < 0.5)
