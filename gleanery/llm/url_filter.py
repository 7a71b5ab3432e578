"""URL filters: suffix rules first, a character language-model ratio for the rest.

Two variable-order Markov models (contexts of 0, 1 and 2 characters, each smoothed by the next
shorter) are counted from the URLs the rules accept and reject. A URL no rule fits is allowed when the mean
log-likelihood difference per character reaches a threshold, calibrated on judged URLs that
were kept out of the counts. DataFrame functions only.

The alphabet has 42 symbols, so the table of log ratios has exactly 42**3 rows: its size does
not grow with the data, and it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import staged

#: (verdict, host, path): a rule fits its host, all subdomains, and paths that start with its own.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Start, end and other symbols, then those that stand for themselves.
ALPHABET = "^$*abcdefghijklmnopqrstuvwxyz0123456789./-"
SMOOTHING = 4.0
FOLDS = 5
BINS = 400
RANGE = 4.0

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url and for one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(domain + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def _grams(text: Column) -> Column:
    """Codes of all symbol triples of ``^^text$``; each is a character after its two before."""
    others = ALPHABET[3:].replace("-", r"\-").replace(".", r"\.")
    plain = F.regexp_replace(text, f"[^{others}]", "*")
    marks = F.split(F.concat(F.lit("^^"), plain, F.lit("$")), "")
    codes = F.transform(marks, lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    size = len(ALPHABET)
    return F.zip_with(
        F.zip_with(
            F.slice(codes, F.lit(1), F.size(codes) - 2),
            F.slice(codes, F.lit(2), F.size(codes) - 2),
            lambda a, b: a * size + b,
        ),
        F.slice(codes, F.lit(3), F.size(codes) - 2),
        lambda ab, c: ab * size + c,
    )


def log_ratios(judged: DataFrame) -> DataFrame:
    """(gram, ratio) for every triple, from rows (gram, accepted)."""
    size = len(ALPHABET)
    seen = judged.groupBy("gram").agg(
        F.sum(F.col("accepted").cast("long")).alias("n_a"), F.sum((~F.col("accepted")).cast("long")).alias("n_r")
    )
    every = judged.sparkSession.range(size**3).select(F.col("id").cast("int").alias("gram"))
    full = every.join(seen, "gram", "left").fillna(0, ["n_a", "n_r"])
    a, b, c = F.floor(F.col("gram") / size**2), F.floor(F.col("gram") / size) % size, F.col("gram") % size
    full = full.withColumns({"a": a, "b": b, "c": c})
    ones = full.groupBy("c").agg(F.sum("n_a").alias("a1"), F.sum("n_r").alias("r1"))
    pairs = full.groupBy("b", "c").agg(F.sum("n_a").alias("a2"), F.sum("n_r").alias("r2"))
    after_one = full.groupBy("b").agg(F.sum("n_a").alias("ta2"), F.sum("n_r").alias("tr2"))
    after_two = full.groupBy("a", "b").agg(F.sum("n_a").alias("ta3"), F.sum("n_r").alias("tr3"))
    total = full.agg(F.sum("n_a").alias("ta1"), F.sum("n_r").alias("tr1")).first()
    rows = full.join(ones, "c").join(pairs, ["b", "c"]).join(after_one, "b").join(after_two, ["a", "b"])

    def chance(of: str) -> Column:
        one = (F.col(f"{of}1") + 1.0) / (float(total[f"t{of}1"] or 0) + size)
        two = (F.col(f"{of}2") + SMOOTHING * one) / (F.col(f"t{of}2") + SMOOTHING)
        return (F.col(f"n_{of}") + SMOOTHING * two) / (F.col(f"t{of}3") + SMOOTHING)

    return rows.select("gram", (F.log(chance("a")) - F.log(chance("r"))).alias("ratio"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) for every row of ``pages``.

    ``ratio`` is the mean log-likelihood difference per character, for rows with a rule too.
    Null urls and urls without ``://`` have an empty host and path and are judged as such.
    Repeated rows and null ids stay; other columns are not read; an empty table gives no rows.
    Where the rules accept or reject nothing at all, the threshold is 0.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select(
        F.monotonically_increasing_id().alias("_row"),
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        verdict.alias("by_rule"),
        F.pmod(F.xxhash64(F.lit(3), "host", "path"), F.lit(FOLDS)).alias("_fold"),
    )
    parsed = staged(parsed, "urls")
    text = F.concat(F.col("host"), F.col("path"))
    grams = parsed.select("_row", "by_rule", "_fold", F.explode(_grams(text)).alias("gram"))
    judged = grams.filter("by_rule is not null and _fold > 0").select(
        "gram", (F.col("by_rule") == "allow").alias("accepted")
    )
    # 42**3 rows whatever the input.
    ratios = F.broadcast(staged(log_ratios(judged), "url-ratios"))
    means = grams.join(ratios, "gram").groupBy("_row").agg(F.avg("ratio").alias("ratio"))
    scored = staged(parsed.join(means, "_row"), "url-scores")

    bin_of = F.floor((F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), "ratio")) + RANGE) / (2 * RANGE) * BINS)
    counts = scored.filter("by_rule is not null and _fold = 0").groupBy(bin_of.alias("bin"))
    counts = counts.agg(
        F.sum((F.col("by_rule") == "allow").cast("long")).alias("good"),
        F.sum((F.col("by_rule") == "block").cast("long")).alias("bad"),
    )
    # At most BINS + 1 rows.
    threshold = calibrated([(r["bin"], r["good"], r["bad"]) for r in counts.collect()])
    own = F.when(F.col("ratio") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "ratio"
    )


def calibrated(counts: list[tuple[int, int, int]]) -> float:
    """The middle of the bin borders with the best mean of the two classes' right shares; 0 if a class is empty."""
    good, bad = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not good or not bad:
        return 0.0
    best, first, last = -1.0, 0, 0
    kept_good, kept_bad = good, bad
    found = {b: (g, r) for b, g, r in counts}
    for b in range(BINS + 1):
        share = kept_good / good + (bad - kept_bad) / bad
        if share > best:
            best, first = share, b
        if share == best:
            last = b
        g, r = found.get(b, (0, 0))
        kept_good, kept_bad = kept_good - g, kept_bad - r
    return (first + last) / 2 / BINS * 2 * RANGE - RANGE
