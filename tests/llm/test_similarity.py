"""Near-duplicates, repeats and neighbours against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import awkward, documents, prose

from gleanery.llm import neighbours, repeats, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius=4):
    names = {v: v for v in values}
    for a in names:
        for b in names:
            if (a ^ b).bit_count() <= radius:
                ra, rb = a, b
                while names[ra] != ra:
                    ra = names[ra]
                while names[rb] != rb:
                    rb = names[rb]
                names[max(ra, rb)] = min(ra, rb)

    def root(v):
        while names[v] != v:
            v = names[v]
        return v

    return {v: root(v) for v in names}


@pytest.mark.parametrize("crowded", [2, 4096])
def test_components_of_documents(spark, crowded):
    rows = awkward()
    got = simhash.near_duplicates(documents(spark, rows), crowded=crowded).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    roots = classes(prints)
    least = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        known = least.get(roots[p])
        least[roots[p]] = i if known is None else known if i is None else min(i, known)
    want = Counter((i, p, least[roots[p]]) for (i, *_), p in zip(rows, prints, strict=True))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


@pytest.mark.parametrize("crowded", [3, 40, 4096])
def test_links_connect_what_brute_force_connects(spark, crowded):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(150)}
    for start in list(values)[:20]:
        for _ in range(12):
            for _ in range(rng.randrange(1, 5)):
                start ^= 1 << rng.randrange(64)
            values.add(start)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame([(0, *v) for v in signed], "k long, fp long"), crowded=crowded).drop("k")
    found = {r.node % 2**64: r.root % 2**64 for r in simhash.components(edges).collect()}
    want = classes(values)
    groups = Counter(want.values())
    assert set(found) <= set(want)
    same = lambda m: Counter(frozenset(v for v in values if m(v) == m(w)) for w in values)
    assert same(lambda v: found.get(v, v)) == same(lambda v: want[v])
    assert max(groups.values()) > 3


def test_one_of_each_keeps_the_smallest(spark):
    docs = documents(spark, awkward())
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 not in ids and ids.count(10) == 1
    assert simhash.one_of_each(documents(spark, [])).collect() == []


@pytest.mark.parametrize("crowded", [3, 4096])
def test_one_of_each_is_what_brute_force_keeps(spark, crowded):
    rng = random.Random(8)
    rows = []
    for n in range(25):
        words = prose(100 + n, 200, 5000).split()
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 30])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(copy), "s"))
    prints = [simhash.several_fingerprints(t.encode(), 5, 8) for _, t, _ in rows]
    names = list(range(len(rows)))
    for i in names:
        for j in range(i):
            if any((a ^ b).bit_count() <= 4 for a, b in zip(prints[i], prints[j], strict=True)):
                old, new = sorted((names[i], names[j]), reverse=True)
                names = [new if x == old else x for x in names]
    got = {r.doc_id for r in simhash.one_of_each(documents(spark, rows), crowded=crowded).collect()}
    assert got == set(names) and 25 <= len(got) < 60


def plain_removal(texts, length, keep_first):
    """texts: (key, bytes) in order."""
    places = {}
    for n, body in enumerate(texts):
        for p in range(len(body) - length + 1):
            places.setdefault(body[p : p + length], []).append((n, p))
    out = []
    for n, body in enumerate(texts):
        gone = [False] * len(body)
        for p in range(len(body) - length + 1):
            same = places[body[p : p + length]]
            if len(same) > 1 and not (keep_first and same[0] == (n, p)):
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeating(seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abcde \n") for _ in range(rng.randrange(10, 160))) for _ in range(12)]
    pieces += ["x" * 150, "ab" * 70, "é😀" * 20]
    rows = [(i, "".join(rng.choice(pieces) + rng.choice(["", "z", "yy"]) for _ in range(rng.randrange(0, 9))), "s") for i in range(50)]
    return rows + [(60, None, None), (61, "", "s"), (62, rows[3][1], "s"), (63, rows[3][1], "s")]


@pytest.mark.parametrize("crowded", [1, 8192])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_are_those_of_brute_force(spark, crowded, keep_first):
    rows = repeating(3)
    got = repeats.remove_repeats(documents(spark, rows), length=60, core=16, keep_first=keep_first, crowded=crowded)
    want = plain_removal([(t or "").encode() for _, t, _ in rows], 60, keep_first)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()}
    assert got == {i: w for (i, *_), w in zip(rows, want, strict=True)}


def test_repeats_of_awkward_rows(spark):
    rows = awkward() + [(None, prose(5, 200), "s"), (99, prose(5, 200), "s"), (10, prose(6, 200), "s"), (10, prose(6, 200), "s")]
    got = repeats.remove_repeats(documents(spark, rows), texts=True).collect()
    want = Counter((i, *w) for (i, *_), w in zip(rows, plain_removal([(t or "").encode() for _, t, _ in rows], 400, False), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove_repeats(documents(spark, [])).collect() == []


def test_runs_cover_each_window_once():
    texts = [prose(1, 300).encode(), b"short", b"q" * 1000, b"", prose(2, 90).encode()]
    owner, anchor, first, last, _ = repeats.window_runs(texts, 100, 16)
    for n, text in enumerate(texts):
        covered = [p for o, a, b in zip(owner, first, last, strict=True) if o == n for p in range(a, b + 1)]
        assert covered == list(range(max(0, len(text) - 99)))
    assert all(f <= a <= f + 84 and a >= b for a, f, b in zip(anchor, first, last, strict=True) if a >= b)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_in_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(150)]
    rows += [(200 + i, rows[7][1], 1) for i in range(9)]
    rows += [(300, None, 0), (350, [0.0] * 8, 0), (400, [float("nan")] * 8, 0), (450, [float("inf")] * 8, 0), (None, rows[1][1], 0), (500, [1.0, 2.0], 0)]
    data = vectors(spark, rows)
    got = {}
    for r in neighbours.search(data, every=50).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    good = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if i is not None and v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    assert set(got) == {0, 50, 100, 200}
    for i, v in good:
        if i % 50 == 0:
            scores = sorted((-(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in good if j != i)
            best = sorted((round(s, 12), j) for s, j in scores)[:5]
            assert [got[i][k + 1][0] for k in range(5)] == [j for _, j in best]
            assert [got[i][k + 1][1] for k in range(5)] == pytest.approx([-s for s, _ in best])
    assert neighbours.search(vectors(spark, [])).collect() == []


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    got = {}
    for r in neighbours.search(vectors(spark, rows), block_rows=800, pivots=128, ordered=48).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    found = 0
    for i in range(0, 3000, 50):
        near = unit @ unit[i]
        near[i] = -9
        found += len(got[i] & set(np.argsort(-near)[:5].tolist()))
    assert found >= 0.9 * 5 * 60


def test_footrule_by_definition():
    rng = np.random.default_rng(3)
    orders = np.stack([rng.permutation(20)[:6] for _ in range(40)])
    files = neighbours.inverted_files(orders, 20)
    query = rng.permutation(20)[:6]
    place = lambda o, p: list(o).index(p) if p in o else 6
    want = [sum(abs(place(query, p) - place(o, p)) for p in range(20)) for o in orders]
    assert neighbours.footrule(query, files, 40).tolist() == want
