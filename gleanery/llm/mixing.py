"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets come from weights, with no source above twice its size (water filling). Slot ``j`` of
the schedule looks up the golden-ratio point ``frac(j * phi)`` in the cumulative weights and
so picks a source; its rank among the source's slots names the block it plays. Blocks cut
the source's shuffled stream of words (every document once, then again) into equal numbers
of words. The few slots by which a source's points fall short of its target close the schedule.

DataFrame functions only. Sources are few against documents: one row each, joined, never
collected. A source may own any share of the rows (``running_before``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import WORD, running_before, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
BLOCK_WORDS = 1024
BINS = 4096
CHUNK_SLOTS = 4096
#: The golden ratio's fraction, and that of 2**20 times it (keeps long schedules exact).
PHI = 0.6180339887498949
PHI_HIGH = 0.2087988406072768


@dataclass(frozen=True)
class Mixture:
    """rows: one per document; slots: the schedule; pieces: what each slot plays."""

    rows: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) plus a dense number ``_s`` by code point, null last."""
    ranked = sizes.withColumn(
        "_s", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")
    )
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)), (F.col("_s") % len(weights) + 1).cast("int")
    )
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * 2.0)
    # In order of cap over weight, the first sources are capped: each whose cap lies below
    # what an equal share per weight of the rest would give it.
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_s")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    levels = capped.withColumn("_level", level)
    full = F.col("_cap") <= F.col("_level") * F.col("_w")
    levels = levels.withColumn("_open", F.max(F.when(~full, F.col("_level"))).over(every))
    target = F.when(full, F.col("_cap")).otherwise(F.col("_open") * F.col("_w"))
    return levels.select("source", "_s", "source_size", target.alias("target"))


def golden_slots(sources: DataFrame, total: int, block_words: int) -> DataFrame:
    """(slot, _s, block): every source gets as many blocks as its target needs."""
    spark = sources.sparkSession
    quotas = sources.filter("target >= 0.5").withColumn(
        "_quota", F.ceil(F.round("target") / block_words).cast("long")
    )
    by_number = Window.orderBy("_s")
    upto = F.sum("target").over(by_number) / F.sum("target").over(Window.partitionBy())
    spans = quotas.withColumn("_to", upto).withColumn(
        "_from", F.coalesce(F.lag("_to").over(by_number), F.lit(0.0))
    )
    first, last = F.floor(F.col("_from") * BINS), F.floor(F.col("_to") * BINS)
    spans = spans.select("_s", "_from", "_to", "_quota", F.explode(F.sequence(first, last)).alias("_bin"))

    j = F.col("slot") + 1
    high, low = F.floor(j / (1 << 20)), j % (1 << 20)
    point = high * F.lit(PHI_HIGH) + low * F.lit(PHI)
    point = point - F.floor(point)
    drawn = spark.range(total).withColumnRenamed("id", "slot").withColumn("_u", point)
    drawn = drawn.withColumn("_bin", F.floor(F.col("_u") * BINS))
    drawn = drawn.join(spans, "_bin").filter("_u >= _from and _u < _to")
    drawn = drawn.select("slot", "_s", "_quota", F.floor(F.col("slot") / CHUNK_SLOTS).alias("_chunk"))
    # The rank of a slot within its source: own chunk by a window, earlier chunks by sums.
    counts = drawn.groupBy("_s", "_chunk").count()
    past = Window.partitionBy("_s").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select("_s", "_chunk", F.coalesce(F.sum("count").over(past), F.lit(0)).alias("_carry"))
    own = Window.partitionBy("_s", "_chunk").orderBy("slot")
    ranked = drawn.withColumn("_rank", F.row_number().over(own) - 1).join(carry, ["_s", "_chunk"])
    ranked = ranked.withColumn("block", (F.col("_rank") + F.col("_carry")).cast("long"))
    ranked = ranked.filter("block < _quota").select("slot", "_s", "block")

    reached = counts.groupBy("_s").agg(F.sum("count").alias("_n"))
    short = quotas.join(reached, "_s", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    short = short.filter("_n < _quota")
    missing = F.col("_quota") - F.col("_n")
    begins = F.sum(missing).over(by_number) - missing + F.lit(total)
    rest = short.withColumn("_begin", begins).select(
        "_s", "_begin", "_n", F.explode(F.sequence("_n", F.col("_quota") - 1)).alias("block")
    )
    rest = rest.select((F.col("_begin") + F.col("block") - F.col("_n")).alias("slot"), "_s", "block")
    return ranked.unionByName(rest)


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    block_words: int = BLOCK_WORDS,
    seed: int = 11,
) -> Mixture:
    """Schedule ``share`` times all words of ``docs`` by weight.

    Null texts have no words; a null source is a source of its own, after the others; rows
    without words are kept and take nothing; equal rows are separate documents; an empty
    table gives empty results. Columns other than doc_id, text and source are not read, and
    doc_id may be null. ``pieces`` holds (slot, _s, _row, pass, first, words): in pass 1 or 2
    a document gives ``words`` words from word ``first`` on.
    """
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        count.alias("size"),
        *(c.alias(n) for n, c in _row_keys(seed).items()),
    )
    narrow = staged(narrow, "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sources = staged(source_targets(sizes, share, weights).drop("_n"), "mix-sources")
    totals = sources.agg(F.sum("target"), F.sum("source_size")).first()
    total = -(-int(round(totals[0] or 0)) // block_words)

    numbered = narrow.join(
        sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    rows = running_before(
        numbered,
        ["_s"],
        "_h",
        ["doc_id", "size"],
        {"_from": F.col("size"), "_row": F.lit(1)},
        narrow.count(),
    )
    rows = staged(rows, "mix-rows")
    slots = golden_slots(sources, total, block_words)

    # The stream of a source: all its words in shuffled order, twice; cut at the target.
    passes = rows.filter("size > 0").select(
        "_s", "_row", "size", "_from", "source_size", "target", F.explode(F.array(F.lit(1), F.lit(2))).alias("pass")
    )
    begin = F.col("_from") + (F.col("pass") - 1) * F.col("source_size")
    end = F.least(begin + F.col("size"), F.round("target").cast("long"))
    played = passes.withColumns({"_begin": begin, "_end": end}).filter("_end > _begin")
    blocks = F.sequence(F.floor(F.col("_begin") / block_words), F.floor((F.col("_end") - 1) / block_words))
    played = played.select("_s", "_row", "pass", "_begin", "_end", F.explode(blocks).alias("block"))
    first = F.greatest(F.col("block") * block_words, F.col("_begin"))
    last = F.least((F.col("block") + 1) * block_words, F.col("_end"))
    cut = played.select(
        "_s", "_row", "pass", "block", (first - F.col("_begin")).alias("first"), (last - first).alias("words")
    )
    pieces = cut.join(slots, ["_s", "block"]).drop("block")
    return Mixture(rows, sources, slots, pieces)


def taken_words(mixture: Mixture) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source), a row per document."""
    taken = mixture.pieces.groupBy("_s", "_row").agg(F.sum("words").alias("taken"))
    joined = mixture.rows.join(taken, ["_s", "_row"], "left")
    return joined.select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source"
    )


def mixed_texts(docs: DataFrame, mixture: Mixture, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` as often as the mixture plays them, cut where a pass ends inside one.

    Whole plays keep the text as it is; a part keeps its first words, joined by blanks. Of
    rows that agree on id, text and source one stands for all, as often as they are played.
    """
    played = mixture.pieces.groupBy("_s", "_row", "pass").agg(F.sum("words").alias("_keep"))
    plan = mixture.rows.join(played, ["_s", "_row"])
    plan = plan.groupBy("_h", "_k", F.col("size").alias("_size"), "_keep").agg(F.count("*").alias("_plays"))
    own = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    text, source = own["text"], F.col(own["text"])
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()), *(c.alias(n) for n, c in _row_keys(seed).items()))
    joined = rows.dropDuplicates(["_h", "_k"]).join(plan, ["_h", "_k"])
    joined = joined.withColumn("_play", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_plays"))))
    part = F.array_join(F.slice(F.regexp_extract_all(source, F.lit(WORD), 0), 1, F.col("_keep").cast("int")), " ")
    played = F.when(F.col("_keep") < F.col("_size"), part).otherwise(source)
    return joined.withColumn(text, played).select(*(F.col(n).alias(c) for c, n in own.items()))


def _row_keys(seed: int) -> dict[str, Column]:
    own = ("doc_id", "text", "source")
    return {"_h": F.xxhash64(F.lit(seed), *own), "_k": F.xxhash64(F.lit(seed + 1), *own)}
