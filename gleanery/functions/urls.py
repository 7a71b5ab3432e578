"""URL columns. Splitting follows RFC 3986 appendix B, so odd hosts and paths survive."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import strip
from gleanery.policy import TRACKING_KEYS

URL_SHAPE = (
    r"\A(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?\z"
)

# IPv4 ranges that are not public, and the two public addresses inside them.
LOCAL_RANGES = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
)
PUBLIC_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")


def split_url(c: Column) -> Column:
    """Struct of the stripped text and its scheme, netloc, path (no ;params) and query."""
    text = F.regexp_replace(strip(c), r"[\t\r\n]", "")

    def part(group: int) -> Column:
        return F.regexp_extract(text, URL_SHAPE, group)

    return F.struct(
        strip(c).alias("text"),
        F.lower(part(1)).alias("scheme"),
        part(2).alias("netloc"),
        F.regexp_replace(part(3), r";[^/]*\z", "").alias("path"),
        part(4).alias("query"),
    )


def decode_form(c: Column) -> Column:
    """Form decoding; a stray percent sign stays as it is."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def encode_form(c: Column) -> Column:
    """Form encoding that leaves the tilde alone and escapes the asterisk."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """Array of (key, value) in URL order; parameters without a value are left out."""
    valued = F.filter(F.split(query, "&"), lambda p: p.rlike(r"=[\s\S]"))
    return F.transform(
        valued,
        lambda p: F.struct(
            decode_form(F.substring_index(p, "=", 1)).alias("key"),
            decode_form(F.regexp_replace(p, r"\A[^=]*=", "")).alias("value"),
        ),
    )


def canonical(u: Column) -> Column:
    """Canonical text of a split URL."""
    netloc = F.regexp_replace(F.lower(u["netloc"]), r"\Awww\.", "")
    path = F.regexp_replace(u["path"], r"/+\z", "")
    kept = F.filter(query_pairs(u["query"]), lambda p: ~F.lower(p["key"]).isin(*TRACKING_KEYS))
    query = F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda p: F.concat(encode_form(p["key"]), F.lit("="), encode_form(p["value"])),
        ),
        "&",
    )
    return F.concat(
        F.coalesce(F.nullif(u["scheme"], F.lit("")), F.lit("https")),
        F.lit(":"),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def content_id(normalized: Column) -> Column:
    return F.substring(F.sha2(normalized, 256), 1, 16)


def host(u: Column) -> Column:
    """Lower-case host without user info, port and one leading www. (IPv6 keeps brackets)."""
    place = F.regexp_replace(F.lower(u["netloc"]), r"\A.*@", "")
    bare = F.regexp_extract(place, r"\A(\[[^\]]*\]|[^:]*)", 1)
    return F.regexp_replace(bare, r"\Awww\.", "")


def domain(h: Column) -> Column:
    return F.substring_index(h, ".", -2)


def is_web(u: Column) -> Column:
    return u["scheme"].isin("http", "https") & (u["netloc"] != "")


def ip_number(h: Column) -> Column:
    """The host as a 32-bit number, null unless it is a plain dotted IPv4 address."""
    octets = F.transform(F.split(h, r"\."), lambda o: o.try_cast("long"))
    plain = h.rlike(r"\A(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})\z")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o)
    return F.when(plain & ~F.exists(octets, lambda o: o > 255), number)


def is_local(h: Column) -> Column:
    """Literal address that is not public; bracketed IPv6 literals are never public."""
    number = ip_number(h)
    spans = [ipaddress.ip_network(r) for r in LOCAL_RANGES]
    inside = reduce(
        lambda a, b: a | b,
        (number.between(int(n.network_address), int(n.broadcast_address)) for n in spans),
    )
    public = number.isin(*(int(ipaddress.ip_address(a)) for a in PUBLIC_EXCEPTIONS))
    return F.coalesce(inside & ~public, F.lit(False)) | h.startswith("[")


def host_suffixes(h: Column) -> Column:
    """Every domain a list entry could name for this host: a.b.c, b.c, c."""
    labels = F.split(h, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def in_domains(h: Column, domains: tuple[str, ...]) -> Column:
    """Suffix match against a short list that travels with the plan."""
    if not domains:
        return F.lit(False)
    return F.arrays_overlap(host_suffixes(h), F.array(*(F.lit(d) for d in domains)))
