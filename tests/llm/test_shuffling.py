"""Sharding and mixing: exact sizes, uniform places, targets."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import awkward, documents

from gleanery.llm import mixing, sharding
from gleanery.llm.common import running_before


def test_shards_hold_every_row_once_at_gapless_slots(spark):
    rows = awkward()
    got = sharding.shuffle_into_shards(documents(spark, rows), shards=8, part_rows=7).collect()
    want = Counter((i, len((t or "").encode()) + 1) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shuffle_into_shards(documents(spark, rows[::-1]).repartition(5), part_rows=7).collect()
    assert Counter(got) == Counter(again)


def test_empty_table_has_no_shards(spark):
    assert sharding.shuffle_into_shards(documents(spark, [])).collect() == []


def test_matrix_adds_up_and_is_fair():
    parts, quotas = [5, 0, 17, 30], [13, 13, 13, 13]
    cells = np.array([sharding.communication_matrix(parts, quotas, seed) for seed in range(400)])
    assert (cells.sum(axis=2) == parts).all() and (cells.sum(axis=1) == quotas).all()
    assert np.allclose(cells.mean(axis=0), np.outer(parts, quotas) / 52, atol=0.35)


def test_hypergeometric_of_sizes_beyond_the_library():
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(2_000_000_000, 2_000_000_000, 1000, rng) for _ in range(300)]
    assert abs(np.mean(draws) - 500) < 5 and 10 < np.std(draws) < 22


def test_running_sums_over_hot_groups(spark):
    rows = [("hot" if i % 3 else "cold", i * 7919 % 1000 * 2**50 - 2**59, i, i % 5) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, h long, i long, v long")
    from pyspark.sql import functions as F

    got = running_before(df, ["g"], "h", ["i"], {"s": F.col("v"), "n": F.lit(1)}, 900, block_rows=20).collect()
    order = lambda r: ((r[1] % 2**64) >> 1, r[1], r[2])
    want = {}
    for g in ("hot", "cold"):
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=order)):
            want[r[2]] = (total, n)
            total += r[3]
    assert {r.i: (r.s, r.n) for r in got} == want


def filled(sizes, weights, share):
    """Targets by handing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), list(names)
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if target[s] + unit * weight[s] >= 2 * sizes[s] - 1e-12]
        if not full:
            for s in open_:
                target[s] += unit * weight[s]
            break
        for s in full:
            left -= 2 * sizes[s] - target[s]
            target[s] = 2.0 * sizes[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("block", [3, 64, 1024])
def test_mixture_meets_targets(spark, block):
    rows = awkward()
    mixture = mixing.mix_sources(documents(spark, rows), block_words=block)
    got = mixing.taken_words(mixture).collect()
    words = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, words(t)) for i, t, s in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    target = filled(sizes, mixing.WEIGHTS, mixing.SHARE)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    slots = [r.slot for r in mixture.slots.collect()]
    assert len(set(slots)) == len(slots)
    again = mixing.taken_words(mixing.mix_sources(documents(spark, rows).repartition(7), block_words=block))
    assert Counter(again.collect()) == Counter(got)


def test_schedule_spreads_each_source(spark):
    rows = [(i, "x " * 50, "abc"[i % 3]) for i in range(90)]
    mixture = mixing.mix_sources(documents(spark, rows), block_words=10)
    slots = sorted((r.slot, r._s) for r in mixture.slots.collect())
    first_half = Counter(s for _, s in slots[: len(slots) // 2])
    whole = Counter(s for _, s in slots)
    assert all(abs(first_half[s] - whole[s] / 2) <= 4 for s in whole)


def test_mixed_texts_hold_what_was_taken(spark):
    rows = [(i, " ".join(f"t{i}_{k}" for k in range(5 + i)), "ab"[i % 2]) for i in range(40)] + [(50, None, "a")]
    docs = documents(spark, rows)
    mixture = mixing.mix_sources(docs, block_words=4)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(mixture).collect()}
    out = mixing.mixed_texts(docs, mixture)
    assert out.columns == docs.columns
    found = Counter()
    for r in out.collect():
        assert rows[r.doc_id if r.doc_id < 50 else 40][1].startswith(r.text)
        found[r.doc_id] += len(r.text.split())
    assert dict(found) == {k: v for k, v in taken.items() if v}


def test_mixing_nothing(spark):
    mixture = mixing.mix_sources(documents(spark, []))
    assert mixing.taken_words(mixture).collect() == [] and mixture.slots.collect() == []
