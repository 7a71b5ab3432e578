"""URL table jobs: canonical form, keys, hosts, policy verdicts and source references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from gleanery.functions import urls as U
from gleanery.functions.text import quoted, strip
from gleanery.operators.lookup import lookup
from gleanery.operators.once import computed_once
from gleanery.operators.ordered import order_rows, running
from gleanery.policy import PROBED_HOST, Policy

# Fixed value: the wording of the refusal.
BLOCKED_NOTE = (
    "is blocked by default (no browser automation / scraping ingestion for this platform). "
    "Use manual paste, webhook, or share-sheet export instead."
)
# Longer lists are merged as a table instead of being written into the plan.
INLINE_DOMAINS = 200
# Hosts and domains beyond which their order is cut into chunks of about this size.
CHUNK_HOSTS = 100_000
# Over so many keys rows without a key of their own are spread.
SETTLED_KEYS = 4096


def _with_url(df: DataFrame, url: str) -> DataFrame:
    return computed_once(df, {"_url": U.split_url(F.col(url))})


def canonicalize_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``normalized_url``: same page, same text."""
    return _with_url(df, url).withColumn("normalized_url", U.canonical(F.col("_url"))).drop("_url")


def assign_content_ids(df: DataFrame, normalized: str = "normalized_url") -> DataFrame:
    """Add ``content_id``, the key of everything else."""
    return df.withColumn("content_id", U.content_id(F.col(normalized)))


def extract_hosts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``domain`` (its last two labels)."""
    return (
        _with_url(df, url)
        .withColumn("host", U.host(F.col("_url")))
        .withColumn("domain", U.domain(F.col("host")))
        .drop("_url")
    )


def match_domains(df: DataFrame, domains: tuple[str, ...] | DataFrame, host: str = "host") -> DataFrame:
    """Add ``listed``: the host is a listed domain or lies under one.

    A written list is matched inside the row. A table of domains (column ``domain``) is
    merged with the distinct hosts in the order of their labels, see ``listed_hosts``. A row
    without a host is not listed, either way.
    """
    if not isinstance(domains, DataFrame):
        if len(domains) <= INLINE_DOMAINS:
            listed = F.coalesce(U.in_domains(F.col(host), domains), F.lit(False))
            return df.withColumn("listed", listed)
        spark = df.sparkSession
        domains = spark.createDataFrame([(d,) for d in domains], "domain STRING")
    listed = listed_hosts(df.select(F.col(host).alias("_host")), domains.select("domain")).withColumn("listed", F.lit(True))
    # A host can own a large share of all rows.
    keyed = df.withColumn("_host", F.col(host))
    marked = lookup(keyed, listed, ["_host"], _hashable(df))
    return marked.withColumn("listed", F.coalesce("listed", F.lit(False))).select(*df.columns, "listed")


def listed_hosts(hosts: DataFrame, domains: DataFrame, chunk_rows: int = CHUNK_HOSTS) -> DataFrame:
    """The distinct hosts (_host) that are, or lie under, one of the domains.

    Names are sorted by their labels from the last to the first, so what lies under a domain
    follows it without a gap. A host is listed when the furthest end of all domains before it lies
    beyond it. Nothing is joined on a suffix: half of all hosts may share one.
    """

    def backwards(name: str) -> Column:
        return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))

    name = hosts.filter("_host IS NOT NULL").distinct().select("_host", backwards("_host").alias("_key"), F.lit(1).alias("_kind"))
    starts = domains.filter("domain IS NOT NULL").distinct().select(backwards("domain").alias("_key")).withColumn("_kind", F.lit(0))
    # No name goes on with the last of all characters, so this is where the domain's names end.
    end = F.when(F.col("_kind") == 0, F.concat("_key", F.lit("\U0010ffff")))
    rows = name.unionByName(starts, allowMissingColumns=True).withColumn("_all", F.lit(0))
    walked = running(order_rows(rows, ["_all"], ["_key", "_kind"], chunk_rows), maxs={"_end": end}).rows()
    return walked.filter((F.col("_kind") == 1) & (F.col("_end") > F.col("_key"))).select("_host")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]


def flag_private_hosts(df: DataFrame, host: str = "host") -> DataFrame:
    """Add ``is_private``: a literal address that is not on the public internet."""
    return df.withColumn("is_private", U.is_local(F.col(host)))


def _verdict(u: Column, host: Column, policy: Policy) -> Column:
    """Name of the first check the URL fails, or ok."""
    blocked = U.in_domains(U.domain(host), policy.blocked_domains)
    allowed = U.in_domains(host, policy.allowed_domains)
    if not policy.allowed_domains:
        allowed = F.lit(True)
    return (
        F.when(u["text"] == "", "empty")
        .when(~U.is_web(u), "malformed")
        .when(blocked, "blocked")
        .when(~allowed, "unlisted")
        .otherwise("ok")
    )


def _with_host(df: DataFrame, url: str) -> DataFrame:
    return computed_once(_with_url(df, url), {"_host": U.host(F.col("_url"))})


def validate_urls(df: DataFrame, policy: Policy, url: str = "url") -> DataFrame:
    """Add ``ok, normalized_url, content_id, reason, blocked`` for each URL."""
    return _validated(_with_host(df, url), policy).drop("_url", "_host")


def judge_urls(
    df: DataFrame, policy: Policy, probes: DataFrame | None = None, url: str = "url"
) -> DataFrame:
    """``validate_urls`` and ``classify_urls`` in one, taking the URL apart once."""
    judged = _classified(_validated(_with_host(df, url), policy), policy).drop("_url", "_host")
    return classify_by_probe(judged, probes, url)


def _validated(hosted: DataFrame, policy: Policy) -> DataFrame:
    hosted = computed_once(hosted, {"_canonical": U.canonical(F.col("_url"))})
    staged = computed_once(
        hosted, {"_verdict": _verdict(F.col("_url"), F.col("_host"), policy)}
    )
    verdict, domain = F.col("_verdict"), U.domain(F.col("_host"))
    shaped = ~verdict.isin("empty", "malformed")
    named = F.concat(F.lit("domain '"), domain, F.lit("' "))
    reason = (
        F.when(verdict == "empty", F.lit("empty URL"))
        .when(verdict == "malformed", F.concat(F.lit("not a valid http(s) URL: "), quoted(F.col("_url.text"))))
        .when(verdict == "blocked", F.concat(named, F.lit(BLOCKED_NOTE)))
        .when(verdict == "unlisted", F.concat(named, F.lit("is not in the configured allow-list")))
    )
    return staged.withColumns(
        {
            "ok": verdict == "ok",
            "normalized_url": F.when(shaped, F.col("_canonical")).otherwise(F.lit("")),
            "content_id": F.when(shaped, U.content_id(F.col("_canonical"))).otherwise(F.lit("")),
            "reason": reason,
            "blocked": verdict == "blocked",
        }
    ).drop("_verdict", "_canonical")


def classify_urls(
    df: DataFrame, policy: Policy, probes: DataFrame | None = None, url: str = "url"
) -> DataFrame:
    """Add ``kind``: media, text, or null when nothing may capture the URL."""
    known = _classified(_with_host(df, url), policy).drop("_url", "_host")
    return classify_by_probe(known, probes, url)


def _classified(hosted: DataFrame, policy: Policy) -> DataFrame:
    """Add ``kind``, with the value probe where the URL alone cannot tell."""
    host = F.col("_host")
    refused = (
        U.in_domains(host, policy.text_blocked_domains) | (host == "localhost") | U.is_local(host)
    )
    kind = (
        F.when(~U.is_web(F.col("_url")), F.lit(None).cast("string"))
        .when(
            U.in_domains(host, policy.allowed_domains),
            F.when(host == PROBED_HOST, F.lit("probe")).otherwise(F.lit("media")),
        )
        .when(refused, F.lit(None).cast("string"))
        .otherwise(F.lit("text"))
    )
    return computed_once(hosted, {"kind": kind})


def classify_by_probe(
    df: DataFrame, probes: DataFrame | None, url: str = "url", kind: str = "kind"
) -> DataFrame:
    """Settle ``kind = 'probe'``: media if the probe table says so, text in all other cases.

    ``probes`` has one row (url, probe_ok) per probed URL.
    """
    open_kind = F.coalesce(F.col(kind) == "probe", F.lit(False))
    if probes is None:
        return df.withColumn(kind, F.when(open_kind, F.lit("text")).otherwise(F.col(kind)))
    found = probes.filter("probe_ok").select(strip(F.col("url")).alias("_probed")).distinct()
    # Rows that are settled already get keys that meet nothing, dealt by a hash, so that one join
    # serves all rows and no key holds them.
    settled = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*_hashable(df)), F.lit(SETTLED_KEYS)).cast("string"))
    keyed = df.withColumn("_probed", F.when(open_kind, strip(F.col(url))).otherwise(settled))
    joined = keyed.join(found.withColumn("_video", F.lit(True)), "_probed", "left")
    told = F.when(F.col("_video"), "media").otherwise("text")
    return joined.withColumn(kind, F.when(open_kind, told).otherwise(F.col(kind))).select(*df.columns)


def extract_source_refs(df: DataFrame, url: str = "url") -> DataFrame:
    """Add what the URL itself names: repository parts, page id, file id, carousel index."""
    staged = _with_url(df, url)
    u, raw = F.col("_url"), F.col(url)
    parts = F.filter(F.split(u["path"], "/"), lambda p: p != "")
    repo = F.size(parts) >= 2
    blob = (F.size(parts) > 3) & (F.get(parts, F.lit(2)) == "blob")
    rest = F.array_join(F.slice(parts, F.lit(5), F.greatest(F.size(parts) - 4, F.lit(0))), "/")
    uuid = (
        r"([0-9a-fA-F]{8})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{4})-?([0-9a-fA-F]{12})"
    )
    index = F.filter(U.query_pairs(u["query"]), lambda p: p["key"] == "img_index")
    return staged.withColumns(
        {
            "owner": F.when(repo, F.get(parts, F.lit(0))),
            "repo": F.when(repo, F.get(parts, F.lit(1))),
            "ref": F.when(blob, F.get(parts, F.lit(3))),
            "file_path": F.when(blob, F.nullif(rest, F.lit(""))),
            "page_id": F.when(
                raw.rlike(uuid),
                F.lower(F.concat_ws("-", *(F.regexp_extract(raw, uuid, g) for g in range(1, 6)))),
            ),
            "file_id": F.nullif(
                F.regexp_extract(raw, r"(?U)(?:/file/d/|[?&]id=)([\w-]{6,})", 1), F.lit("")
            ),
            "img_index": strip(F.get(index, F.lit(0))["value"]).try_cast("int"),
        }
    ).drop("_url")
