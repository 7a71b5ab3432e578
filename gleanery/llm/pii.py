"""Personal data: base patterns, and candidates chosen by boosted trees.

Base spans (e-mail, IP, card, phone) match a pattern and a check. Generators with high recall
also propose looser spans, which may overlap them and each other. Boosted trees judge a
candidate by its format and context alone (never by the checks); they learn from candidates
that do and don't meet a base span. Those that meet none are redacted too when the score
reaches a threshold at which held-out candidates keep ``LEAST_PRECISION``.

DataFrame functions only. Features are coded in few levels, so the corpus boils down to at most
``6 * 4 * 2 * 4 * 4 * 3 * 2`` cells of counts (times two folds); trees are grown on these cells.

Patterns run in linear time: what starts a match is tried once per run of characters (a match
starts at the start of such a run or where the last match ended, which is what leftmost
matching gives), and repeats are possessive where nothing can be given back.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import staged

LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

LOOSE_MAIL = (
    rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)*+"
)
LOOSE_NUMBER = r"\+?[0-9](?:[\x20().-]{0,3}[0-9]){6,}+"
CUES = r"(?i)(tel|phone|fone|fon|call|fax|mail|e-mail|card|carte|tarjeta|karte|ip|host)\W{0,3}$"

FEATURES = ("digits", "breaks", "plus", "dots", "before", "after", "mail")
LEVELS = (6, 4, 2, 4, 4, 3, 2)
TREES = 24
RATE = 0.3
LEAST_PRECISION = 0.97
FOLDS = 5
#: Array sums are taken this many at a time, so that very many matches in a text stay cheap.
CHUNK = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _running(numbers: Column, first: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What the first 1, 2, ... entries of an array of longs (a variable) combine to."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / CHUNK).cast("int"))
    none = F.array().cast("array<bigint>")

    def step(state: Column, x: Column) -> Column:
        return _bound(
            combine(state["total"], x),
            lambda t: F.struct(t.alias("total"), F.concat(state["some"], F.array(t)).alias("some")),
        )

    def chunk(state: Column, k: Column) -> Column:
        start = F.struct(state["total"].alias("total"), none.alias("some"))
        own = F.aggregate(F.slice(numbers, k * CHUNK + 1, F.lit(CHUNK)), start, step)
        return _bound(
            own,
            lambda o: F.struct(o["total"].alias("total"), F.concat(state["all"], F.array(o["some"])).alias("all")),
        )

    start = F.struct(first.cast("bigint").alias("total"), F.array().cast("array<array<bigint>>").alias("all"))
    return F.when(F.size(numbers) > 0, F.flatten(F.aggregate(chunks, start, chunk)["all"])).otherwise(none)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found, before, after>> of all matches; code points, end exclusive."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>")

    def placed(cut: Column) -> Column:
        found, pieces = cut["found"], cut["pieces"]
        sizes = F.zip_with(
            F.slice(pieces, F.lit(1), F.size(found)),
            found,
            lambda p, m: (F.length(p) + F.length(m)).cast("bigint"),
        )
        ends = _bound(sizes, lambda n: _running(n, F.lit(0), lambda t, x: t + x))
        ended = F.zip_with(found, ends, lambda m, e: F.struct(m.alias("found"), e.alias("end")))
        around = F.zip_with(
            F.slice(pieces, F.lit(1), F.size(found)),
            F.slice(pieces, F.lit(2), F.size(found)),
            lambda p, q: F.struct(F.right(p, F.lit(16)).alias("before"), F.left(q, F.lit(1)).alias("after")),
        )
        return F.zip_with(
            ended,
            around,
            lambda x, y: F.struct(
                (x["end"] - F.length(x["found"])).alias("start"),
                x["end"].alias("end"),
                x["found"].alias("found"),
                y["before"].alias("before"),
                y["after"].alias("after"),
            ),
        )

    cut = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("pieces")
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), _bound(cut, placed)).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _is_ip(found: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        # As texts of three digits, numbers compare as numbers do.
        return (F.length(plain) <= 3) & (F.lpad(plain, 3, "0") <= "255")

    return F.forall(F.split(found, r"\."), small)


def _is_card(found: Column) -> Column:
    digits = _digits(found)

    def value(d: Column, i: Column) -> Column:
        n = F.ascii(d) - 48
        return F.when(i % 2 == 1, F.when(n > 4, n * 2 - 9).otherwise(n * 2)).otherwise(n)

    values = F.transform(F.split(F.reverse(digits), ""), value)
    total = F.aggregate(values, F.lit(0), lambda s, x: s + x)
    return F.length(digits).between(12, 19) & (total % 10 == 0)


def _is_phone(found: Column) -> Column:
    return F.length(_digits(found)).between(9, 15)


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind, array<struct<start, kind, end>>: what passes its check, failing matches dropped."""
    checks = {"email": (EMAIL, None), "ip": (IP, _is_ip), "card": (CARD, _is_card), "phone": (PHONE, _is_phone)}

    def kept(kind: str) -> Column:
        pattern, check = checks[kind]
        found = matches(text, pattern)
        if check:
            found = F.filter(found, lambda m: check(m["found"]))
        number = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), number, m["end"].alias("end")))

    return {kind: kept(kind) for kind in KINDS}


def _level(value: Column, limits: tuple[int, ...]) -> Column:
    """How many of the limits the value reaches."""
    return sum(((value >= n).cast("int") for n in limits), F.lit(0))


def candidates(text: Column) -> Column:
    """array<struct<start, end, features...>>: every loose number and loose address."""

    def coded(mail: int):
        def one(m: Column) -> Column:
            found = m["found"]
            digits = F.length(_digits(found))
            dots = F.length(F.regexp_replace(found, r"[^.]", ""))
            breaks = F.length(F.regexp_replace(found, r"[^\x20()\[\]-]", ""))
            before = (
                F.when(F.regexp_like(m["before"], F.lit(CUES)), 3)
                .when(F.regexp_like(m["before"], F.lit(r"[\"'=:/]$")), 2)
                .when(F.regexp_like(m["before"], F.lit(r"[\x20\n]$")), 1)
                .otherwise(0)
            )
            after = (
                F.when(F.regexp_like(m["after"], F.lit(r"[A-Za-z0-9@]")), 2)
                .when(F.regexp_like(m["after"], F.lit(r"[\x20\n]")) | (m["after"] == ""), 0)
                .otherwise(1)
            )
            return F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                _level(digits, (7, 9, 12, 16, 20)).alias("digits"),
                _level(breaks, (1, 2, 4)).alias("breaks"),
                F.startswith(found, F.lit("+")).cast("int").alias("plus"),
                _level(dots, (1, 3, 4)).alias("dots"),
                before.alias("before"),
                after.alias("after"),
                F.lit(mail).alias("mail"),
            )

        return one

    return F.concat(
        F.transform(matches(text, LOOSE_NUMBER), coded(0)), F.transform(matches(text, LOOSE_MAIL), coded(1))
    )


@dataclass(frozen=True)
class Trees:
    """Boosted trees of two levels: (feature, limit, low side, high side), sides (feature, limit, low, high)."""

    start: float
    trees: tuple[tuple, ...]
    threshold: float

    def score(self, row: dict | Column):
        column = isinstance(row, Column)

        def branch(node: tuple):
            if len(node) == 1:
                return F.lit(node[0]) if column else node[0]
            name, limit, low, high = node
            if column:
                return F.when(row[name] < limit, branch(low)).otherwise(branch(high))
            return branch(low) if row[name] < limit else branch(high)

        total = F.lit(self.start) if column else self.start
        for tree in self.trees:
            total = total + branch(tree)
        return total


def _best_split(cells: list[tuple], which: list[int]) -> tuple | None:
    """(gain, feature number, limit) over cells (codes, weight, gradient sum, curvature sum)."""
    best = None
    for f, levels in enumerate(LEVELS):
        g = [0.0] * levels
        h = [0.0] * levels
        for i in which:
            codes, grad, bend = cells[i]
            g[codes[f]] += grad
            h[codes[f]] += bend
        total_g, total_h = sum(g), sum(h)
        left_g = left_h = 0.0
        for limit in range(1, levels):
            left_g += g[limit - 1]
            left_h += h[limit - 1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, limit)
    return best if best and best[0] > 1e-9 else None


def grow(rows: list[tuple[tuple[int, ...], int, int, bool]]) -> Trees:
    """Fit on cells (codes, count, positives, held out); held-out cells set the threshold."""
    fit = [r for r in rows if not r[3]]
    n, good = sum(r[1] for r in fit), sum(r[2] for r in fit)
    if not n or not good or good == n:
        return Trees(0.0, (), math.inf)
    start = math.log(good / (n - good))
    score = [start] * len(fit)
    trees = []

    def tree(cells: list[tuple], which: list[int], depth: int) -> tuple:
        split = _best_split(cells, which) if depth and len(which) > 1 else None
        if split is None:
            return (RATE * sum(cells[i][1] for i in which) / (sum(cells[i][2] for i in which) + 1),)
        _, f, limit = split
        low = [i for i in which if cells[i][0][f] < limit]
        high = [i for i in which if cells[i][0][f] >= limit]
        if not low or not high:
            return tree(cells, which, 0)
        return (FEATURES[f], limit, tree(cells, low, depth - 1), tree(cells, high, depth - 1))

    for _ in range(TREES):
        cells = []
        for (codes, count, yes, _), s in zip(fit, score, strict=True):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            cells.append((codes, yes - count * p, count * p * (1 - p)))
        grown = tree(cells, list(range(len(cells))), 2)
        trees.append(grown)
        one = Trees(0.0, (grown,), 0.0)
        score = [s + one.score(dict(zip(FEATURES, r[0], strict=True))) for s, r in zip(score, fit, strict=True)]
    model = Trees(start, tuple(trees), 0.0)
    held = sorted(
        ((model.score(dict(zip(FEATURES, r[0], strict=True))), r[1], r[2]) for r in rows if r[3]), reverse=True
    )
    threshold, count, yes = math.inf, 0, 0
    for i, (s, n, k) in enumerate(held):
        count, yes = count + n, yes + k
        if (i + 1 == len(held) or held[i + 1][0] < s) and yes >= LEAST_PRECISION * count:
            threshold = s - 1e-9
    return Trees(start, tuple(trees), threshold)


def _marked(base: Column, loose: Column) -> Column:
    """The loose candidates by start, with ``known``: whether they overlap a base span.

    Both are sorted together; the furthest end of base spans so far, and the next start of one
    to come, tell it in one pass each way.
    """

    def entry(loosely: bool):
        def one(c: Column) -> Column:
            fields = [c[f].alias(f) if loosely else F.lit(0).alias(f) for f in FEATURES]
            return F.struct(c["start"].alias("start"), F.lit(loosely).alias("loose"), c["end"].alias("end"), *fields)

        return one

    def mark(rows: Column) -> Column:
        far = F.transform(rows, lambda r: F.when(~r["loose"], r["end"]))
        near = F.reverse(F.transform(rows, lambda r: F.when(~r["loose"], r["start"])))
        none = F.lit(None)
        so_far = _bound(far, lambda n: _running(n, none, lambda t, x: F.greatest(t, x)))
        to_come = F.reverse(_bound(near, lambda n: _running(n, none, lambda t, x: F.least(t, x))))
        sides = F.zip_with(so_far, to_come, lambda a, b: F.struct(a.alias("far"), b.alias("near")))
        joined = F.zip_with(
            rows,
            sides,
            lambda r, s: F.struct(
                r["start"].alias("start"),
                r["end"].alias("end"),
                r["loose"].alias("loose"),
                *(r[f].alias(f) for f in FEATURES),
                (F.coalesce(s["far"] > r["start"], F.lit(False)) | F.coalesce(s["near"] < r["end"], F.lit(False))).alias("known"),
            ),
        )
        return F.filter(joined, lambda r: r["loose"])

    return _bound(F.array_sort(F.concat(F.transform(base, entry(False)), F.transform(loose, entry(True)))), mark)


def detect(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (doc_id, email, ip, card, phone, base, loose, fold), and the cells of its candidates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = F.struct(*(c.alias(k) for k, c in base_spans(F.col("text")).items()), candidates(F.col("text")).alias("_loose"))
    rows = rows.select("doc_id", F.inline(F.array(found)))
    base = F.array_sort(F.concat(*KINDS))
    rows = rows.select("doc_id", *KINDS, F.inline(F.array(F.struct(base.alias("base"), F.col("_loose")))))
    rows = rows.select("doc_id", *KINDS, "base", _marked(F.col("base"), F.col("_loose")).alias("loose"))
    rows = staged(rows, "pii")
    fold = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(FOLDS)) == 0
    loose = rows.select(fold.alias("held"), F.explode("loose").alias("c")).select(
        "held", *(F.col("c")[f].alias(f) for f in (*FEATURES, "known"))
    )
    cells = loose.groupBy("held", *FEATURES).agg(
        F.count("*").alias("n"), F.sum(F.col("known").cast("long")).alias("yes")
    )
    return rows, cells


def fit_trees(cells: DataFrame) -> Trees:
    """Bounded: one row per cell of coded features and fold."""
    found = sorted(
        (tuple(r[f] for f in FEATURES), r["n"], r["yes"], r["held"]) for r in cells.collect()
    )
    return grow(found)


def _added(loose: Column, trees: Trees) -> Column:
    """Chosen candidates that meet no base span, as spans of the kind after the base ones."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    if math.isinf(trees.threshold):
        return none
    chosen = F.filter(loose, lambda c: ~c["known"] & (trees.score(c) >= trees.threshold))
    return F.transform(
        chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), c["end"].alias("end"))
    )


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "other")))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    Null texts count as empty; repeated rows and null ids stay; other columns are not read. A
    table without candidates, or whose candidates all look alike, gets base spans only.
    """
    rows, cells = detect(docs)
    trees = fit_trees(cells)
    spans = F.array_sort(F.array_distinct(F.concat("base", _added(F.col("loose"), trees))))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of ``find_private`` in ``text`` replaced by ``[kind]``.

    Spans that overlap become one, named after the first. Null texts stay null.
    """
    _, cells = detect(docs)
    trees = fit_trees(cells)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = base_spans(text)
    base = F.array_sort(F.concat(*(spans[k] for k in KINDS)))
    own = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    found = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in own.items()),
        F.inline(F.array(F.struct(base.alias("_base"), candidates(text).alias("_loose")))),
    )
    kept = list(own.values())
    found = found.select(*kept, "_base", F.inline(F.array(F.struct(_marked(F.col("_base"), F.col("_loose")).alias("_marks")))))
    every = F.array_sort(F.concat("_base", _added(F.col("_marks"), trees)))
    found = found.select(*kept, F.inline(F.array(F.struct(every.alias("_spans")))))
    body = F.col(own["text"])
    names = F.array(*(F.lit(f"[{k}]") for k in (*KINDS, "other")))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(body, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        new = s["start"] >= state["at"]
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(new, F.concat(state["out"], F.array(gap, F.element_at(names, s["kind"] + 1))))
            .otherwise(state["out"])
            .alias("out"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def finish(state: Column) -> Column:
        rest = F.substring(body, (state["at"] + 1).cast("int"), F.length(body))
        return F.concat(F.array_join(state["out"], ""), rest)

    clean = F.when(F.size("_spans") == 0, body).otherwise(F.aggregate("_spans", start, step, finish))
    return found.select(*(clean.alias("text") if c == "text" else F.col(n).alias(c) for c, n in own.items()))
