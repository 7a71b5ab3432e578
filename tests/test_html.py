"""Main text of awkward pages, against texts written out by hand."""

import time

import pytest

from gleanery.operators.captures import extract_main_text

CASES = [
    ('<body><div class="ad"><div>x</div>BUY</div><p>after</p></body>', "after"),
    ("a<!-- <nav> --> b<nav>x<nav>y</nav>z</nav>c", "a b c"),
    ('d<script>if (a<b) "<script>"</script>e<style>q', "d e"),
    ("<p>1 < 2 and 3 > 2</p><header\n>h</header >t", "1 < 2 and 3 > 2\nt"),
    ("<nav>never closed <p>text", ""),
    ("text <!-- never closed <p>x", "text"),
    ("caf&eacute; &larr; &#0000000065; &#x41; &pound;5 &amp;lt; &bogus; &#99999999; A&B", "café ← A A £5 &lt; &bogus; � A&B"),
    ("<main>one</main><p>two", "one"),
    ("no tags", "no tags"),
    ("", ""),
    (None, ""),
]


def test_texts(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, html string")
    got = {r.i: r.text for r in extract_main_text(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(CASES)}


@pytest.mark.parametrize("piece", ['<div class="ad">', "<script>", "<!-- ", "<nav>", "<p "])
def test_time_grows_with_the_page_only(spark, piece):
    def seconds(times):
        df = spark.createDataFrame([(piece * times + "x",)], "html string")
        began = time.perf_counter()
        extract_main_text(df).collect()
        return time.perf_counter() - began

    seconds(10)
    # Four times the page: a quadratic walk would take sixteen times as long.
    assert seconds(40_000) < 9 * max(0.5, seconds(10_000))
