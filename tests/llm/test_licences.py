"""Licence scans: base places against brute force, statistics and spans against plain forms."""

import random
import re
from collections import Counter

import pytest
from helpers import awkward, documents

from gleanery.llm import licences

NOTICE = "Licensed under the Apache License, Version 2.0."


def plain(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in licences.BASE:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def mixtures(seed):
    rng = random.Random(seed)
    parts = ["MIT", "mit", "license", "Apache", "general", "public", "License", "the", "gnu", "-", ". ", "é", "ünter", "under"]
    rows = [(100 + i, " ".join(rng.choices(parts, k=rng.randrange(0, 80))), "a") for i in range(200)]
    rows += [(400, "MIT\x00License Apache–license Apache_license MITLicense", "b"), (401, (NOTICE + "\n") * 500, "b")]
    return rows


def test_base_places_are_those_of_brute_force(spark):
    rows = awkward() + mixtures(3)
    got = licences.scan(documents(spark, rows)).collect()
    want = Counter((i, *plain(t)) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_statistics_are_longest_matches():
    rng = random.Random(4)
    lists = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] for _ in range(6)]
    machine = licences.Automaton()
    for words in lists:
        machine.add(words)
    parts = {tuple(w[i:j]) for w in lists for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    text = [rng.randrange(5) for _ in range(400)]
    for i, (_, length) in enumerate(machine.statistics(text)):
        longest = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in parts), default=0)
        assert length == longest


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", ["mit"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
        ("Licensed under CC BY 4.0.", ["cc-by"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl"]),
        ("distributed under the GNU Lesser General Public License version 3", ["lgpl"]),
        ("released under the terms of my own licence, for the use of this software", []),
        ("released under the foo license", []),
        ("see the license for the terms of the license and the conditions of the work", []),
        (licences.PARAGRAPHS[0][1].replace("Software", "Product"), ["mit"]),
        (f"{NOTICE} {NOTICE} x Released under the MIT License", ["apache", "apache", "mit"]),
    ],
)
def test_spans(text, labels):
    scanner = licences.Scanner()
    _, spans = scanner.scan(scanner.word_numbers(text))
    assert [s.label for s in spans] == labels
    for a, b in zip(spans, spans[1:], strict=False):
        assert a.last_word < b.first_word


def test_edited_paragraphs_are_still_covered():
    """Every twelfth word lost: chains bridge the gaps; every template finds its own label."""
    scanner = licences.Scanner()
    for label, text in licences.PARAGRAPHS:
        words = text.split()
        kept = " ".join(w for i, w in enumerate(words) if i % 12 != 5)
        _, spans = scanner.scan(scanner.word_numbers(kept))
        assert label in {s.label for s in spans}
    for label, words in licences.templates()[3:]:
        _, spans = scanner.scan(scanner.word_numbers(b" ".join(words).decode()))
        assert [s.label for s in spans] == [label]


def test_long_texts_in_slices(monkeypatch):
    scanner = licences.Scanner()
    text = ("of the work and the license " * 5 + NOTICE + " é日本 ") * 300
    whole = scanner.word_numbers(text)
    monkeypatch.setattr(licences, "SLICE_CHARS", 7)
    assert scanner.word_numbers(text).tolist() == whole.tolist()
    places, spans = scanner.scan(whole)
    assert len(places) == len(spans) == 300


def test_empty_table_and_spans_column(spark):
    assert licences.scan(documents(spark, [])).collect() == []
    row = licences.scan(documents(spark, [(1, "so: " + NOTICE, "a")])).first()
    assert [(s.label, s.first_word, s.last_word, s.covered, s.coverage) for s in row.spans] == [("apache", 1, 8, 8, 1.0)]
    assert row.score == 0.8
