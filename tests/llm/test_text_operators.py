"""Personal data, toxicity, URLs, fingerprints and packing against plain forms."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import awkward, documents, prose

from gleanery.llm import fingerprint, packing, pii, toxicity, url_filter
from gleanery.llm.queries import tokenizer_path

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base(text):
    out = []
    for number, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if good:
                out.append((m.start(), number, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def private_rows():
    rng = random.Random(4)
    parts = ["a@b.co", "x.y%z@d-e.f.g", "a@b", "1.2.3.4", "256.1.1.1", "001.002.003.004", "1.2.3.4.5.6.7.8",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+12", "+1 2345678901234567",
             "a@b.c%d@e.f", "😀", "é", "@", "..", "-", "tel: 0170 1234567", "12  34", "+4111111111111111", "\n"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(30))), "s") for i in range(300)]
    long = [(900, "7" * 50_000, "s"), (901, "a" * 50_000, "s"), (902, "a@b" + ".c" * 20_000, "s"), (903, "1.2.3.4 " * 3000, "s")]
    return rows + long + [(904, None, None), (905, "", "s"), (None, "me@here.org", "s"), (1, "me@here.org", "s"), (1, "me@here.org", "s")]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = private_rows()
    got = pii.find_private(documents(spark, rows)).collect()
    want = Counter((i, hashlib.sha256(base(t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert [kinds[k] for k, _ in KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]


def test_trees_learn_format_and_keep_their_precision():
    rng = random.Random(2)
    cells = []
    for held in (False, True):
        for _ in range(400):
            codes = tuple(rng.randrange(n) for n in pii.LEVELS)
            good = codes[2] == 1 and codes[0] >= 2
            cells.append((codes, 50, 50 if good else 0, held))
    trees = pii.grow(cells)
    score = lambda c: trees.score(dict(zip(pii.FEATURES, c, strict=True)))
    chosen = [(n, yes) for codes, n, yes, held in cells if held and score(codes) >= trees.threshold]
    assert sum(y for _, y in chosen) >= pii.LEAST_PRECISION * sum(n for n, _ in chosen) > 0
    assert sum(y for _, y in chosen) >= 0.9 * sum(c[2] for c in cells if c[3])


def test_redaction_leaves_nothing_private(spark):
    rows = private_rows()
    docs = documents(spark, rows)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    spans = {r.doc_id: r.spans for r in pii.find_private(docs).collect()}
    for i, t, _ in rows:
        if not spans[i]:
            assert (i, t) in texts
        elif i not in (None, 1):
            want, at = "", 0
            for kind, a, b in sorted((s.split(":") for s in spans[i].split(",")), key=lambda s: int(s[1])):
                if int(a) >= at:
                    want += t[at : int(a)] + f"[{kind}]"
                at = max(at, int(b))
            assert (i, want + t[at:]) in texts
    short = documents(spark, [(1, "hi me@x.org and 1.2.3.4!", "s")])
    assert [r.text for r in pii.redact(short).collect()] == ["hi [email] and [ip]!"]


def test_nothing_private_in_nothing(spark):
    assert pii.find_private(documents(spark, [])).collect() == []


def plain_segments(scores):
    """All maximal scoring subsequences by their recursive definition."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return plain_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in plain_segments(scores[j:])]


def test_scan_finds_all_maximal_segments():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 24)
        hits = [(i, rng.choice([0.37, 1.03, 2.51])) for i in range(n) if rng.random() < 0.4]
        scores = [-0.61] * n
        for i, w in hits:
            scores[i] = w
        got = toxicity.maximal_segments(hits, 0.61)
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def toxic_tables(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(500):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 80))]
        toxic = i % 8 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile,", "awful.", "rotten"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None), (1001, "", "s"), (None, "vile awful rotten vile", "s"), (0, rows[0][1], "s")]
    labels += [(1000, 1, None), (None, 1, 1), (0, 1, 1)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows)


def test_toxic_documents_are_told_apart_on_held_out_rows(spark):
    docs, labels, n = toxic_tables(spark)
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == n
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 if r.doc_id is not None else True)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 500:
            assert r.predicted == int(r.doc_id % 8 == 0)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1000, 1001))
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    model = toxicity.fit(docs, labels)
    assert set(model.weights) == {b"vile", b"awful", b"rotten"}
    passages = toxicity.toxic_passages(docs, model).collect()
    assert {r.doc_id for r in passages} <= {None, *range(0, 500, 8)} and len(passages) > 50
    assert toxicity.without_toxic(docs, docs, labels).columns == docs.columns


def test_toxicity_without_labels_or_documents(spark):
    docs, labels, n = toxic_tables(spark)
    got = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len(got) == n and all(r.predicted == 0 for r in got)
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(h + p), a, h + p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls_are_judged_by_the_longest_rule(spark):
    rng = random.Random(5)
    hosts = ["Example.com", "www.EXAMPLE.com", "a.www.example.com", "xexample.com", "news.net", "net", "site.org", "ÄB.org", "com"]
    ends = ["", "/", "/en", "/en/1", "/es/2?x=/fr/", "/fr/#a", "?q", "#f", "/EN/1", "/en/" + "x" * 500]
    urls = [f"https://{h}{e}" for h in hosts for e in ends]
    urls += [None, "", "no scheme.com/en/", "://", "a://b://c/", "http://site.org/\n/en/"] + [rng.choice(urls) for _ in range(200)]
    pages = spark.createDataFrame([(i, u, "h", "r", "x") for i, u in enumerate(urls)] + [(None, urls[0], "h", "r", "x")], "page_id long, url string, html string, rule string, _row string")
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, verdict, rule = judged(urls[r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0)).collect() == []


def test_language_models_tell_hosts_apart(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    urls = [f"http://{word('abcde')}.com/" for _ in range(150)] + [f"http://{word('uvwxyz')}.net/es/" for _ in range(150)]
    new = [f"http://{word('abcde')}.org/" for _ in range(50)] + [f"http://{word('uvwxyz')}.org/" for _ in range(50)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + new)], "page_id long, url string")
    verdict = {r.page_id: r.verdict for r in url_filter.judge_urls(pages).collect()}
    right = sum(verdict[300 + i] == ("allow" if i < 50 else "block") for i in range(100))
    assert right >= 90


def test_smoothed_chances_add_up_to_one(spark):
    rows = [(g, g % 3 == 0) for g in range(0, 42**3, 997)]
    seen = spark.createDataFrame(rows, "gram int, accepted boolean")
    table = {r.gram: r.ratio for r in url_filter.log_ratios(seen).collect()}
    assert len(table) == 42**3 and all(abs(x) < 20 for x in table.values())


def test_edits_and_order_of_fingerprints(spark):
    rows = [r for r in awkward() if r[0] is not None]
    got = fingerprint.compare_with_edits(documents(spark, rows), parts=5).collect()
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    want = Counter()
    for k, (i, t, _) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].fingerprint == by_id[2].fingerprint and by_id[2].near_edited > by_id[7].near_next
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    one = fingerprint.compare_with_edits(documents(spark, [(3, "alone here", "s")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprint.compare_with_edits(documents(spark, [])).collect() == []


def test_fingerprints_with_null_ids(spark):
    got = fingerprint.compare_with_edits(documents(spark, awkward()), parts=4).collect()
    assert len(got) == len(awkward()) and sum(r.doc_id is None for r in got) == 2


def test_bucket_counts_by_definition(monkeypatch):
    monkeypatch.setattr(fingerprint, "BATCH_BYTES", 64)
    texts = [b"", b"ab", b"abc", b"hello world, hello", prose(1, 60).encode(), "é😀".encode()]
    counts = fingerprint.bucket_counts(texts)
    for text, row in zip(texts, counts, strict=True):
        assert row.sum() == sum(max(0, len(text) - z) for *_, z in fingerprint.TRIPLETS)
    whole = np.stack([fingerprint.bucket_counts([t])[0] for t in texts])
    assert (whole == counts).all()
    a = fingerprint.digests([prose(1, 500).encode()])
    near = fingerprint.digests([prose(1, 500).replace("w7 ", "q ").encode()])
    far = fingerprint.digests([("zq xv " * 800).encode()])
    assert fingerprint.likeness(a, a)[0] == 1 and fingerprint.likeness(a, near)[0] > fingerprint.likeness(a, far)[0]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = awkward() + [(70, "İstanbul T̈est <|ENDOFTEXT|> <|endoftext|> ẞ ΣΑΣ don't I'LL", "s")]
    got = packing.pack_documents(documents(spark, rows), tokenizer_path(), capacity=256).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 256)):
            part = ids[start : start + 256]
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(places) <= -(-sum(r.length for r in got) // 256) + 2
    assert packing.pack_documents(documents(spark, []), tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 300) for _ in range(rng.randrange(1, 60))}
    runs, sequences = packing.plan_runs(counts, 100)
    seen, load = Counter(), Counter()
    for length, first, n, sequence, offset in runs:
        for k in range(n):
            seen[length, first + k] += 1
            assert load[sequence + k] == offset
            load[sequence + k] += length
    assert seen == Counter((length, k) for length, n in counts.items() for k in range(n))
    assert max(load.values()) <= 100 and set(load) == set(range(sequences))
    assert packing.plan_runs({}, 100) == ([], 0)


def test_printable_words_spare_the_tokenizer(monkeypatch):
    """Their ids come part by part from its model, and are those of whole words."""
    path = tokenizer_path()
    tokenizer, _, model = packing._tokenizer(path)
    asked = []

    class Spy:
        def encode_batch_fast(self, words, **kwargs):
            asked.extend(words)
            return tokenizer.encode_batch_fast(words, **kwargs)

    monkeypatch.setitem(packing._caches, path, (Spy(), {}, model))
    rng = random.Random(3)
    words = ["".join(rng.choices("'sdtrevlm09azAZ_~!<>|.", k=rng.randrange(1, 9))) for _ in range(20_000)]
    words = [w for w in words if "<|" not in w]
    odd = ["Ünïcode", "áb", "x\x00y", "\x7f", "<|endoftext|>", "日本"]
    texts = [" ".join(words), " ".join(odd[:1] + words[:50] + odd[2:]), odd[1] + " It'S HERE's", ""]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert packing.token_bytes([t.encode() for t in texts], path) == want
    assert set(asked) <= {w.lower() for w in odd} | set(odd)
    monkeypatch.setitem(packing._caches, path, (tokenizer, {}, None))
    monkeypatch.setattr(packing, "CACHE_WORDS", 0)
    assert packing.token_bytes([t.encode() for t in texts], path) == want
