import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanery.operators import answers, captures, repos
from gleanery.policy import Policy

GOOD = {"title": "T", "summary": "S"}


def parse_all(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, text STRING")
    return answers.parse_enrichments(df).orderBy("i").collect()


@pytest.mark.parametrize("wrap", ["{0}", "```json\n{0}\n```", "```\n{0}\n```", "Sure! {0} bye", "  {0}\n"])
def test_record_is_found(spark, wrap):
    row = parse_all(spark, [wrap.replace("{0}", json.dumps({**GOOD, "tags": ["a"], "x": 1}))])[0]
    assert (row.title, row.summary, row.tags, row.tools_mentioned, row.high_signal, row.error) == ("T", "S", ["a"], [], False, None)


def test_contract(spark):
    bad = [
        {"summary": "S"},
        {**GOOD, "title": 1},
        {**GOOD, "title": None},
        {**GOOD, "tags": None},
        {**GOOD, "tags": ["a", 1]},
        {**GOOD, "tags": ["a", None]},
        {**GOOD, "tags": "a"},
        {**GOOD, "high_signal": None},
        {**GOOD, "high_signal": 2},
        {**GOOD, "high_signal": "maybe"},
        {**GOOD, "skill_candidate_reason": 3},
        [GOOD],
        5,
    ]
    rows = parse_all(spark, [json.dumps(b) for b in bad[:-1]] + ["5", "nothing", "{broken", "a } b {"])
    assert [r.error is not None for r in rows] == [True] * len(rows)
    assert all(r.title is None for r in rows)


def test_booleans(spark):
    values = {True: True, "yes": True, "ON": True, 1: True, "0": False, "n": False, 0: False}
    rows = parse_all(spark, [json.dumps({**GOOD, "high_signal": v}) for v in ("true_", *values)])
    assert rows[0].error
    raw = [True, "yes", "ON", 1, "0", "n", 0]
    got = parse_all(spark, [json.dumps({**GOOD, "high_signal": v}) for v in raw])
    assert [r.high_signal for r in got] == [True, True, True, True, False, False, False]
    assert parse_all(spark, [json.dumps({**GOOD, "skill_candidate_reason": None})])[0].error is None


def test_reasoning(spark):
    texts = ["<think>a</think> x </think>  done ", "<think>cut", " plain "]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    assert [r.text for r in answers.strip_reasoning(df).collect()] == ["done", "", "plain"]


def test_prompts(spark):
    df = spark.createDataFrame([("text", "U", "see {{source_url}}"), ("media", "V", "m")], "content_kind STRING, url STRING, text STRING")
    templates = {"text": f" fixed \n{answers.CACHE_BOUNDARY}\n{{{{source_url}}}}: {{{{transcript}}}} ", "media": " no marker {{transcript}}"}
    rows = answers.render_prompts(df, templates, {"source_url": F.col("url"), "transcript": F.col("text")}).collect()
    assert (rows[0].static_prefix, rows[0].prompt) == ("fixed", "U: see {{source_url}}")
    assert (rows[1].static_prefix, rows[1].prompt) == ("", " no marker m")


def test_requests(spark):
    names = ["anthropic", "ollama", "groq", "gemini", "cerebras"]
    df = spark.createDataFrame([(p, "S", "P") for p in names] + [("anthropic", "", "P")], "provider STRING, static_prefix STRING, prompt STRING")
    made = [json.loads(r.request) for r in answers.build_model_requests(df, "m", 7, json_mode=True).collect()]
    assert made[0]["system"] == [{"type": "text", "text": "S", "cache_control": {"type": "ephemeral"}}]
    assert made[0]["messages"] == [{"role": "user", "content": "P"}]
    assert made[1] == {"model": "m", "prompt": "S\n\nP", "stream": False, "options": {"num_predict": 7, "num_ctx": 16384}}
    assert made[2]["response_format"] == {"type": "json_object"} and made[2]["messages"][0]["content"] == "S\n\nP"
    assert made[3]["generationConfig"] == {"maxOutputTokens": 7, "response_mime_type": "application/json"}
    assert "system" not in made[5]


def test_answers(spark):
    rows = [
        ("anthropic", {"content": [{"type": "text", "text": "a"}, {"type": "x"}, {"type": "text", "text": "b"}]}, "ab"),
        ("anthropic", {"content": []}, None),
        ("ollama", {"response": "r"}, "r"),
        ("groq", {"choices": [{"message": {"content": "<think>z</think> g"}}]}, "g"),
        ("groq", {"choices": [{"message": {"content": "<think>z"}}]}, None),
        ("cerebras", {"choices": []}, None),
        ("gemini", {"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}}]}, "xy"),
        ("gemini", {"candidates": [{"finishReason": "MAX_TOKENS"}]}, None),
    ]
    df = spark.createDataFrame([(p, json.dumps(d)) for p, d, _ in rows], "provider STRING, payload STRING")
    got = answers.read_model_responses(df).collect()
    assert [r.text for r in got] == [t for _, _, t in rows]
    assert got[-1].error == answers.EXHAUSTED and got[1].error.startswith("Claude API response had no text content")


def test_waits(spark):
    rows = [(429, "7", 0), (429, "Wed, 21 Oct 2026 07:28:00 GMT", 0), (429, None, 2), (429, "3600", 0), (429, "1", 3), (200, None, 0), (429, "-1", 0)]
    df = spark.createDataFrame([(s, {} if h is None else {"retry-after": h}, a) for s, h, a in rows], "status INT, headers MAP<STRING,STRING>, attempt INT")
    got = [(r.wait_seconds, r.action) for r in answers.rate_limit_waits(df).collect()]
    assert got == [(7.0, "retry"), (5.0, "retry"), (20.0, "retry"), (3600.0, "give_up"), (1.0, "give_up"), (None, "ok"), (0.0, "retry")]


def test_refusals(spark):
    refused = [
        "My apologies, can not open your picture",
        "Sadly I can’t really read the blurry screenshots here",
        "The model was not able to identify either photo",
        "To go on, please attach both pictures",
        "PLEASE now upload a photo",
    ]
    fine = ["Someone who cannot dance takes a picture of the stage.", "The post invites readers to send in photos."]
    df = spark.createDataFrame([(t,) for t in refused + fine], "text STRING")
    assert [r.refused for r in answers.flag_refusals(df).collect()] == [True] * 5 + [False] * 2


def test_model_errors_stay_with_their_row(spark):
    def make():
        def model(rows: pd.DataFrame) -> pd.DataFrame:
            if (rows["n"] % 5 == 2).any():
                raise ValueError("" if len(rows) > 1 else f"bad {rows['n'].iloc[0]}")
            return pd.DataFrame({"double": rows["n"] * 2})

        return model

    df = spark.range(20).select(F.col("id").cast("string").alias("content_id"), F.col("id").alias("n"))
    rows = answers.apply_model(df, make, "double LONG").collect()
    assert len(rows) == 20
    for r in rows:
        n = int(r.content_id)
        assert (r.double, r.error) == ((None, f"bad {n}") if n % 5 == 2 else (2 * n, None))


def test_links(spark):
    text = '[a](./x.md) ![i](/y.png "t") [h](https://z) [s](#s) [![b](bad.svg)](ci) [m](mailto:q) [e](./) end'
    df = spark.createDataFrame([("o", "r", None, text)], "owner STRING, repo STRING, default_branch STRING, text STRING")
    page, raw = "https://github.com/o/r/blob/main/", "https://raw.githubusercontent.com/o/r/main/"
    assert repos.absolutize_links(df).first().text == (
        f'[a]({page}x.md) ![i]({raw}y.png "t") [h](https://z) [s](#s) [![b]({page}bad.svg)](ci) [m](mailto:q) [e]({page}) end'
    )


def test_gates_and_routes(spark):
    long = "word " * 200
    rows = {
        "ok": long + "just a moment, please log in",
        "bot": "Just a Moment... " + long,
        "login": "Please LOG IN " + long,
        "shell": long + "please enable javascript",
        "short": "tiny",
        "both": "please enable javascript. Checking your browser " + long,
    }
    df = spark.createDataFrame(list(rows.items()), "url STRING, text STRING")
    gated = captures.gate_captures(df)
    assert {r.url: r.gate for r in gated.collect()} == {
        "ok": "ok", "bot": "bot_challenge", "login": "login_wall", "shell": "app_shell", "short": "app_shell", "both": "bot_challenge",
    }
    routes = {r.url: r.route for r in captures.route_captures(gated, Policy()).collect()}
    assert routes["shell"] == "needs_render" and routes["bot"] == "failed" and routes["ok"] == "captured"
    off = {r.url: (r.route, r.error) for r in captures.route_captures(gated, Policy(render_fallback=False)).collect()}
    assert off["short"][0] == "failed" and "'short'" in off["short"][1]


def test_main_text(spark):
    html = (
        "<html><head><title>x</title><style>p{}</style></head><body><nav>menu</nav><!-- c --><article><h1>T &amp; U</h1>"
        '<script>var a="</p>";</script><p>one&nbsp; two<br>three &#8217; &#x41; &#0; &lt;b&gt;</p><div class="ad">buy</div>'
        "<noscript>Please enable JavaScript</noscript> tail</article><footer>f</footer></body>"
    )
    pages = spark.createDataFrame([(html,), ("<p>no root",), (None,), ("<body><main>m<p>unclosed",)], "html STRING")
    got = [r.text for r in captures.extract_main_text(pages).collect()]
    assert got[0] == "T & U\none two\nthree ’ A � <b>\nPlease enable JavaScript\ntail"
    assert got[1:] == ["no root", "", "m\nunclosed"]


def test_the_last_of_repeated_keys_counts(spark):
    text = '{"title": "first", "summary": "s", "title": "last", "tags": ["a"], "tags": ["b", "c"]}'
    row = answers.parse_enrichments(spark.createDataFrame([(text,)], "text STRING")).first()
    assert (row.error, row.title, row.tags) == (None, "last", ["b", "c"])
