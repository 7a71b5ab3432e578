"""URL columns against a plain Python account of the same rules."""

import hashlib
import ipaddress
import random
from urllib.parse import parse_qsl, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from gleanery.operators import urls
from gleanery.policy import TRACKING_KEYS, Policy

CASES = [
    "https://Example.com/A/b/",
    "HTTP://www.Example.com:8080//x//",
    "https://www.www.example.com",
    "https://example.com/p;a=1/q;b=2",
    "https://example.com/p?b=2&a=1&a=0",
    "https://example.com/p?utm_source=x&UTM_Medium=y&fbclid=1&is=3&s=4&keep=5",
    "https://example.com/p?x=%zz&y=%41+b&z=a%20b*~&w=%E2%82%AC&bad=%ff",
    "https://example.com/p?empty=&noeq&=v&a==b&q=a=b",
    "https://example.com/p?a=1#frag?x=1",
    "https://example.com?a=1",
    "https://example.com",
    "  https://exa_mple.com/a|b c  ",
    "https://exämple.com/ü",
    "https://user:pw@example.com/x",
    "http://m.example.com/x",
    "https://example.com/a\tb",
    "https://example.com/%7Efoo/",
    "https://example.com/p?a=1;b=2",
]


def canonical(url: str) -> str:
    parsed = urlparse(url.strip())
    host = parsed.netloc.lower().removeprefix("www.")
    kept = sorted((k, v) for k, v in parse_qsl(parsed.query) if k.lower() not in TRACKING_KEYS)
    query = urlencode(kept)
    return f"{parsed.scheme.lower()}://{host}{parsed.path.rstrip('/')}" + (f"?{query}" if query else "")


def test_canonical_urls_and_ids(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "url STRING")
    rows = urls.assign_content_ids(urls.canonicalize_urls(df)).collect()
    for r in rows:
        want = canonical(r.url)
        assert r.normalized_url == want, r.url
        assert r.content_id == hashlib.sha256(want.encode()).hexdigest()[:16]


def test_canonical_is_idempotent(spark):
    # One leading www. goes per pass, so a host with two of them is left out here.
    df = spark.createDataFrame([(u,) for u in CASES if "www.www" not in u], "url STRING")
    once = urls.canonicalize_urls(df).select(F.col("normalized_url").alias("url"))
    assert urls.canonicalize_urls(once).filter("url <> normalized_url").count() == 0


@pytest.mark.parametrize("extra", ["fbclid=z", "mibextid=q", "gclid=1", "mc_cid=1&mc_eid=2", "is=abc"])
def test_tracking_keys_do_not_change_the_page(spark, extra):
    df = spark.createDataFrame([("https://github.com/a/b",), (f"https://github.com/a/b?{extra}",)], "url STRING")
    assert urls.canonicalize_urls(df).select("normalized_url").distinct().count() == 1


def verdicts(spark, cases, policy):
    df = spark.createDataFrame([(u,) for u in cases], "url STRING")
    return {r.url: r for r in urls.classify_urls(urls.validate_urls(df, policy), policy).collect()}


def test_verdicts(spark):
    policy = Policy(allowed_domains=("youtube.com", "drive.google.com"), blocked_domains=("bad.com", "a.b.com"))
    got = verdicts(
        spark,
        [
            "",
            "not a url",
            "it's",
            'it\'s "x"',
            "HTTPS://m.YouTube.com/x",
            "https://docs.google.com/d",
            "https://x.bad.com/",
            "https://a.b.com/",
            "https://notyoutube.com/",
        ],
        policy,
    )
    assert got[""].reason == "empty URL"
    assert got["not a url"].reason == "not a valid http(s) URL: 'not a url'"
    assert got["it's"].reason == 'not a valid http(s) URL: "it\'s"'
    assert got['it\'s "x"'].reason == "not a valid http(s) URL: 'it\\'s \"x\"'"
    assert got["HTTPS://m.YouTube.com/x"].ok and got["HTTPS://m.YouTube.com/x"].kind == "media"
    assert not got["https://docs.google.com/d"].ok and got["https://docs.google.com/d"].kind == "text"
    assert got["https://x.bad.com/"].blocked
    assert not got["https://a.b.com/"].blocked  # only two labels are compared
    assert not got["https://notyoutube.com/"].ok


def test_kinds_and_probe(spark):
    policy = Policy(text_blocked_domains=("no.com", "vimeo.com"))
    cases = {
        "https://youtu.be/x": "media",
        "https://vimeo.com/1": "media",
        "https://blog.example.com": "text",
        "https://x.no.com": None,
        "ftp://example.com": None,
        "http://127.0.0.1:11434/": None,
        "http://localhost:11434/": None,
        "http://[::1]:80/": None,
        "http://u:p@10.0.0.1/": None,
        "https://drive.google.com/file/d/abcdef1/view": "text",
    }
    got = verdicts(spark, cases, policy)
    assert {u: r.kind for u, r in got.items()} == cases
    df = spark.createDataFrame([("https://drive.google.com/a",), ("https://drive.google.com/b",)], "url STRING")
    probes = spark.createDataFrame([("https://drive.google.com/a", True), ("https://drive.google.com/b", False)], "url STRING, probe_ok BOOLEAN")
    kinds = {r.url[-1]: r.kind for r in urls.classify_urls(df, policy, probes).collect()}
    assert kinds == {"a": "media", "b": "text"}


def test_private_addresses_match_the_standard_library(spark):
    hosts = [f"{a}.{b}.{c}.{d}" for a in (0, 1, 10, 100, 127, 169, 172, 192, 198, 203, 224, 255)
             for b in (0, 16, 18, 31, 32, 51, 64, 88, 168, 254) for c in (0, 1, 2, 100, 113) for d in (9, 10, 255)]
    odd = ["1.2.3", "01.2.3.4", "256.1.1.1", "1.2.3.4.5", "example.com", "1..2.3"]
    df = spark.createDataFrame([(h,) for h in hosts + odd], "host STRING")
    for r in urls.flag_private_hosts(df).collect():
        try:
            ip = ipaddress.ip_address(r.host)
            want = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast
        except ValueError:
            want = False
        assert r.is_private == want, r.host


def test_domain_table_and_list_agree(spark):
    hosts = spark.createDataFrame([("a.b.com",), ("b.com",), ("ab.com",), ("c.org",), ("x.y.c.org",)], "host STRING")
    domains = ("b.com", "y.c.org")
    inline = urls.match_domains(hosts, domains).collect()
    table = urls.match_domains(hosts, spark.createDataFrame([(d,) for d in domains], "domain STRING")).collect()
    assert {(r.host, r.listed) for r in inline} == {(r.host, r.listed) for r in table}
    assert {r.host for r in inline if r.listed} == {"a.b.com", "b.com", "x.y.c.org"}


@pytest.mark.parametrize("chunk_rows", [25, 100_000])
def test_sorted_merge_lists_what_suffixes_list(spark, chunk_rows):
    """Half the hosts under one suffix, domains inside others, odd names; in chunks and at once."""
    rng = random.Random(4)
    labels = ["a", "b", "ab", "a-b", "x1", "é", "", "com"]
    names = {".".join(rng.choices(labels, k=rng.randrange(1, 5))) for _ in range(150)}
    names |= {f"h{i}.deep.big.com" for i in range(150)}
    domains = set(rng.sample(sorted(names), 20)) | {"big.com", "deep.big.com", "m", "b-a.com"}
    hosts = spark.createDataFrame([(n,) for n in sorted(names)] * 2 + [(None,)], "_host STRING")
    table = spark.createDataFrame([(d,) for d in sorted(domains)] * 2 + [(None,)], "domain STRING")
    got = sorted(r._host for r in urls.listed_hosts(hosts, table, chunk_rows).collect())
    assert got == sorted(n for n in names if any(n == d or n.endswith("." + d) for d in domains))


def test_source_refs(spark):
    df = spark.createDataFrame(
        [
            ("https://github.com/o/r/blob/main/docs/a.md",),
            ("https://github.com/o/r/blob/main",),
            ("https://github.com/o",),
            ("https://x.notion.site/T-0123456789ABCDEF0123456789abcdef?x=1",),
            ("https://drive.google.com/open?id=abc-12_3&img_index=7",),
            ("https://instagram.com/p/x?img_index=q",),
        ],
        "url STRING",
    )
    got = [tuple(r)[1:] for r in urls.extract_source_refs(df).collect()]
    assert got[0][:4] == ("o", "r", "main", "docs/a.md")
    assert got[1][:4] == ("o", "r", "main", None)
    assert got[2][:4] == (None, None, None, None)
    assert got[3][4] == "01234567-89ab-cdef-0123-456789abcdef"
    assert got[4][5:] == ("abc-12_3", 7)
    assert got[5][6] is None


@pytest.mark.parametrize("more", [0, 199, 200, 400])
def test_hosts_that_are_null_are_not_listed(spark, more):
    domains = ("a.org", *(f"d{i}.net" for i in range(more)))
    df = spark.createDataFrame([(None,), ("x.a.org",), ("b.org",)], "host STRING")
    assert [r.listed for r in urls.match_domains(df, domains).orderBy("host").collect()] == [False, False, True]
