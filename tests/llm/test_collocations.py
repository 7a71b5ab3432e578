"""Collocations against brute force and the query's SQL."""

import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from gleanery.llm import collocations
from gleanery.llm.queries import COLLOCATIONS_SQL

DOCS = "doc_id long, text string, lang string, source string, n long, phrase string, f long, _part int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, "s", -1, "p", -2, 7) for i, t, g in rows], DOCS)


def plain(rows, longest=3, least=10, top=2000, percent=50):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            inside = any(
                len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in cands.items()
            )
            if inside:
                continue
            cuts = [(Fraction(10**6 * a * a, f[p[:k]] * f[p[k:]]).__floor__(), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def rows_for(seed, docs=60):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdé" for b in ("", "x", "日")]
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t ", None), (4, "one", "xx"), (None, "A b. a B a b, a b", None),
        (5, "the same row here " * 12, "en"), (5, "the same row here " * 12, "en"), (6, "Une\tphrase\x0bune phrase;une phrase " * 9, None),
    ]
    for i in range(docs):
        words = rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(15)], k=rng.randrange(5, 120))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", ", ", ".\n", "\t"]) for w in words)
        rows.append((10 + i, text, rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize(("longest", "one_in", "sample_count"), [(3, 4, 2), (3, 1, 1), (3, 3, 10**6), (2, 2, 3), (4, 2, 5)])
def test_phrases_are_those_of_brute_force(spark, longest, one_in, sample_count):
    """Whatever the sample proposes: everything, nothing, or some."""
    rows = rows_for(longest * 10 + one_in)
    got = collocations.collocations(documents(spark, rows), longest, sample_one_in=one_in, sample_count=sample_count)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, longest)


def test_small_stretches_and_slices(spark, monkeypatch):
    rows = rows_for(5, 30) + [(900, "long phrase again. " * 3000, "en")]
    want = plain(rows)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 64)
    docs = documents(spark, rows)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == want
    stretch, whole = collocations.Stretch("en"), collocations.tokens(rows[-1][1])
    stretch.add(rows[-1][1])
    assert sum(len(c) for c in stretch.codes) == len(whole) + 1


def test_a_bit_set_by_chance_hides_no_phrase():
    """An earlier pass had the bit of a pair, but not that of its word: it never met the pair."""
    stretch = collocations.Stretch("en")
    stretch.add("a a a a. b c d")
    word = collocations.word_hashes("en", [b"a"])
    pair = int(collocations._mixed(word, word)[0]) >> (64 - collocations.BITS)
    none, full = (np.full(1 << (collocations.BITS - 6), x, dtype=np.uint64) for x in (0, 2**64 - 1))
    by_chance = none.copy()
    by_chance[pair >> 6] = np.uint64(1) << np.uint64(pair & 63)

    def found(before):
        counts = stretch.counts(3, [none, full, full], before, False)
        return {p.as_py(): int(t) for n, phrases, times in counts for p, t in zip(phrases, times, strict=True)}

    every = {b"a a": 3, b"a a a": 2, b"b c": 1, b"c d": 1, b"b c d": 1}
    assert found([]) == found([[none, none, by_chance]]) == found([[none, none, full]]) == every
    assert found([[none, full, none]]) == {b"a a a": 2, b"b c d": 1}
    assert found([[none, full, by_chance]]) == {b"b c d": 1}
    assert found([[none, none, by_chance], [none, full, full]]) == {}


def test_border_failures_lead_to_more_passes(spark):
    rows = rows_for(8)
    frequent, passes = collocations.frequent_phrases(documents(spark, rows), sample_one_in=2, sample_count=10**6)
    assert passes == 3  # words, then pairs, then triples
    full, one = collocations.frequent_phrases(documents(spark, rows), sample_one_in=1, sample_count=1)
    assert one == 1
    assert {tuple(r) for r in frequent.collect()} == {tuple(r) for r in full.collect()}


def test_first_ones_and_ties(spark):
    text = " . ".join(f"w{i} v{i}" for i in range(300))
    rows = [(i, text, "en") for i in range(12)]
    got = collocations.collocations(documents(spark, rows), top=25).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, top=25)
    assert [r.phrase for r in sorted(got, key=lambda r: r.rank)] == sorted(f"w{i} v{i}" for i in range(300))[:25]


def test_wide_products_are_exact(spark):
    a, b, pair = 10**12 + 7, 10**12 + 9, 10**12 + 1
    rows = [("en", 1, b"a", a), ("en", 1, b"b", b), ("en", 2, b"a b", pair)]
    frequent = spark.createDataFrame(rows, "lang string, n int, phrase binary, f long")
    row = collocations.scored(frequent).first()
    assert (row.a, row.l, row.r, row.score) == (pair, a, b, 10**6 * pair * pair // (a * b))


def test_empty_table_and_no_words(spark):
    assert collocations.collocations(documents(spark, [])).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, None), (2, " ", "en")])).collect() == []


def test_sql_says_the_same(spark, tmp_path):
    rows = rows_for(11)
    documents(spark, rows).write.parquet(str(tmp_path / "documents"))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
        assert sorted(db.sql(COLLOCATIONS_SQL).fetchall()) == plain(rows)
