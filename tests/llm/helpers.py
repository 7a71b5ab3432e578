"""Small tables with every awkward case, and plain forms of the operators."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, fp string, _h string"


def documents(spark, rows):
    """rows: (doc_id, text, source); other columns clash with names the operators use."""
    full = [(i, t, "en", s, len(t or ""), -1, "x", "y", "z") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed, words, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def awkward(seed=1):
    """Nulls, empties, long texts, exact copies, near copies and repeated rows."""
    base = prose(seed, 300)
    near = base.replace("w1 ", "W1x ", 1)
    rows = [
        (1, base, "a"),
        (2, base, "a"),
        (3, near, "b"),
        (4, "", "b"),
        (5, None, None),
        (6, "   \n\t ", "c"),
        (7, "one", "c"),
        (8, prose(seed + 1, 20_000), "a"),
        (9, "Ünïcode wörds — 日本語 😀 mixed in", "ä"),
        (10, "repeated row", "a"),
        (10, "repeated row", "a"),
        (None, "no id here", "b"),
        (None, None, None),
    ]
    return rows + [(i, prose(seed + i, 40 + i), "abc"[i % 3]) for i in range(20, 60)]


def plain_set(text):
    """Five-word shingles of a text (fewer words: all of them together)."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_force(rows, similarity=0.8):
    """Smallest ids of the classes of rows (id, text, ...) linked by shingle similarity."""
    sets = [plain_set(r[1]) for r in rows]
    names = list(range(len(rows)))
    for i in names:
        for j in range(i):
            if names[i] != names[j] and jaccard(sets[i], sets[j]) >= similarity:
                old, new = sorted((names[i], names[j]), reverse=True)
                names = [new if x == old else x for x in names]
    return {min(rows[i][0] for i in range(len(rows)) if names[i] == n) for n in set(names)}
