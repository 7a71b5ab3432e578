"""The near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pytest
from helpers import awkward, brute_force, documents, jaccard, plain_set, prose

import corpus_pipeline
from gleanery.llm import similar


def edited(words, edits, rng):
    """Edits that each change five shingles."""
    copy = list(words)
    for at in rng.sample(range(2, len(copy) // 5 - 1), edits):
        copy[at * 5] = f"x{rng.randrange(10**9)}"
    return " ".join(copy)


def families(seed, count, words, edits):
    rng = random.Random(seed)
    rows = []
    for n in range(count):
        base = prose(1000 * seed + n, words, 5000).split()
        rows.append((len(rows), " ".join(base), "s"))
        for e in edits:
            rows.append((len(rows), edited(base, e, rng), "s"))
    return rows


@pytest.mark.parametrize("crowded", [2, 2048])
def test_pairs_at_the_threshold_are_found(spark, crowded):
    # 450 words, 10 edits: 446 shingles, 50 of them changed: similarity 396 / 496 = 0.798; 9 edits: 0.817.
    rows = families(3, 60, 450, [9, 10])
    got = {r.doc_id for r in similar.one_of_similar(documents(spark, rows), crowded=crowded).collect()}
    assert got == brute_force(rows)
    assert not any(3 * n + 1 in got for n in range(60))


def test_the_stage_deletes_nothing_below_the_threshold(spark):
    rows = families(4, 60, 450, [10, 11, 12, 13])
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()}
    assert got == brute_force(rows) == set(range(len(rows)))


def test_the_stage_links_all_at_08(spark):
    rows = families(5, 60, 450, [9, 1])
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()}
    assert got == brute_force(rows) == {3 * n for n in range(60)}


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    """The SimHash search is part of the stage: without any band it still finds pairs above 0.95."""
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(similar, "_coarse_edges", lambda *_: none)
    rows = families(6, 40, 450, [1, 2]) + [(200 + n, prose(200 + n, 300), "s") for n in range(20)]
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(spark, rows), "").collect()}
    assert got == brute_force(rows) == {3 * n for n in range(40)} | {200 + n for n in range(20)}


def test_awkward_rows(spark):
    docs = documents(spark, awkward())
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(10) == 1
    assert [i for i in ids if i in (4, 5, 6)] == [4] and ids.count(None) == 1
    assert similar.one_of_similar(documents(spark, [])).collect() == []


def test_a_chain_is_one_class(spark):
    words = prose(9, 600, 5000).split()
    rows = []
    for n in range(40):
        words[10 * n + 5] = f"y{n}"
        rows.append((n, " ".join(words), "s"))
    sets = [plain_set(t) for _, t, _ in rows]
    assert jaccard(sets[0], sets[-1]) < 0.6
    got = {r.doc_id for r in similar.one_of_similar(documents(spark, rows), crowded=7).collect()}
    assert got == brute_force(rows) == {0}


def test_forest_connects_what_brute_force_connects():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, 50).astype(np.uint64)
        for _ in range(8):
            base = base.copy()
            base[rng.integers(0, 50, rng.integers(1, 5))] = rng.integers(0, 2**63, 1).astype(np.uint64)
            sets.append(np.unique(base))
    edges = similar.forest(sets)
    plain = [set(s.tolist()) for s in sets]
    assert all(jaccard(plain[a], plain[b]) >= 0.8 for a, b in edges)
    names = list(range(len(sets)))
    for a, b in edges:
        assert names[a] != names[b]
        names = [names[b] if x == names[a] else x for x in names]
    for i, a in enumerate(plain):
        for j, b in enumerate(plain):
            assert names[i] == names[j] or jaccard(a, b) < 0.8
