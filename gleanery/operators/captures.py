"""Text captures: main text of pages, screening, routing and fetched documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls as U
from gleanery.functions.html import main_region, to_lines, without_noise, without_tags
from gleanery.functions.text import contains_any, quoted, strip
from gleanery.operators.once import computed_once
from gleanery.policy import (
    BLOCK_PAGE_DOMAINS,
    CODE_DOMAINS,
    FILE_DOMAINS,
    GALLERY_DOMAINS,
    Policy,
)

# Phrases that give away a page without content of its own.
SHELL_MARKERS = ("javascript must be enabled", "please enable javascript")
LOGIN_MARKERS = (
    "log in to continue",
    "sign in to continue",
    "log in to view this page",
    "please log in",
    "please sign in",
)
CHALLENGE_MARKERS = (
    "checking your browser",
    "just a moment",
    "verification successful",
    "enable javascript and cookies to continue",
    "attention required",
)
SHORTEST_PAGE = 60
OPENING = 600

# Fixed value: the wording of the error.
BINARY_NOTE = (
    " is a binary format (PDF/PPTX/DOCX/etc.) - not supported yet, "
    "only plain text/markdown/HTML files are read"
)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page; each step is computed once, whatever reads it."""
    clean = computed_once(pages, {"_clean": without_noise(F.coalesce(F.col(html), F.lit("")))})
    region = computed_once(clean, {"_region": main_region(F.col("_clean"))}).drop("_clean")
    bare = computed_once(region, {"_bare": without_tags(F.col("_region"))}).drop("_region")
    return computed_once(bare, {out: to_lines(F.col("_bare"))}).drop("_bare")


def gate_captures(captures: DataFrame, text: str = "text") -> DataFrame:
    """Add ``gate``: bot_challenge, login_wall, app_shell or ok.

    A challenge or login page says so at its top, so only the opening is searched for it;
    the enable-script notes count anywhere.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    opening = F.lower(F.substring(body, 1, OPENING))
    shell = (F.length(body) < SHORTEST_PAGE) | contains_any(F.lower(body), SHELL_MARKERS)
    gate = (
        F.when(contains_any(opening, CHALLENGE_MARKERS), "bot_challenge")
        .when(contains_any(opening, LOGIN_MARKERS), "login_wall")
        .when(shell, "app_shell")
        .otherwise("ok")
    )
    return computed_once(captures, {"gate": gate})


# The wording of the failures below.
def _gate_error(url: Column, rendered: bool) -> Column:
    page = F.concat(F.lit("page "), quoted(url))
    empty = (
        " produced no usable text even after rendering"
        if rendered
        else " produced no usable text and the browser-render fallback is disabled"
    )
    return (
        F.when(
            F.col("gate") == "bot_challenge",
            F.concat(page, F.lit(" is behind a bot-detection challenge, which is not bypassed")),
        )
        .when(
            F.col("gate") == "login_wall",
            F.concat(page, F.lit(" requires login - no credentials are used")),
        )
        .when(F.col("gate") == "app_shell", F.concat(page, F.lit(empty)))
    )


def route_captures(gated: DataFrame, policy: Policy, rendered: bool = False) -> DataFrame:
    """Add ``route`` (captured, needs_render, failed) and the ``error`` of failed rows.

    Rendered pages get no second chance.
    """
    retry = policy.render_fallback and not rendered
    render = (F.col("gate") == "app_shell") & F.lit(retry)
    route = (
        F.when(F.col("gate") == "ok", "captured").when(render, "needs_render").otherwise("failed")
    )
    return gated.withColumn("route", route).withColumn(
        "error", F.when(F.col("route") == "failed", _gate_error(F.col("url"), rendered))
    )


def merge_captures(plain: DataFrame, rendered: DataFrame) -> DataFrame:
    """Fill pages the plain pass could not read with their rendered form, if there is one.

    Both sides are (content_id, text, route, error); a page still waiting keeps its route.
    """
    later = rendered.select(
        "content_id",
        F.col("text").alias("_text"),
        F.col("route").alias("_route"),
        F.col("error").alias("_error"),
    )
    swap = (F.col("route") == "needs_render") & F.col("_route").isNotNull()
    return (
        plain.join(later, "content_id", "left")
        .withColumns(
            {
                "backend": F.when(swap, "playwright-render").otherwise("html-fetch"),
                "text": F.when(swap, F.col("_text")).otherwise(F.col("text")),
                "error": F.when(swap, F.col("_error")).otherwise(F.col("error")),
                "route": F.when(swap, F.col("_route")).otherwise(F.col("route")),
            }
        )
        .drop("_text", "_route", "_error")
    )


def decode_documents(responses: DataFrame, body: str = "body") -> DataFrame:
    """Add ``text`` and ``error`` for fetched files: UTF-8 text as is, HTML exports as main text."""
    readable = F.is_valid_utf8(F.col(body).cast("string"))
    decoded = computed_once(
        responses, {"_plain": F.when(readable, F.col(body).cast("string"))}
    )
    opening = F.lower(F.substring(strip(F.col("_plain")), 1, 15))
    html = opening.startswith("<!doctype html") | opening.startswith("<html")
    paged = extract_main_text(
        decoded.withColumn("_html", F.when(html, F.col("_plain"))), "_html", "_extracted"
    )
    text = F.when(F.col("_html").isNotNull(), F.nullif("_extracted", F.lit(""))).otherwise(
        strip(F.col("_plain"))
    )
    name = F.concat(F.lit("file "), quoted(F.col("url")))
    error = F.when(F.col("_plain").isNull(), F.concat(name, F.lit(BINARY_NOTE))).when(
        text.isNull(), F.concat(name, F.lit(" produced no usable text"))
    )
    return paged.withColumns({"text": text, "error": error}).drop("_plain", "_html", "_extracted")


def classify_fetch_outcome(responses: DataFrame) -> DataFrame:
    """Add ``outcome`` (ok, rate_limited, not_found, http_error) and ``error`` per response.

    ``source_type`` is repo, blocks, file or html. Repository answers tell a spent quota and
    a missing repository apart; any 4xx/5xx fails there and for blocks, anything but 200 for
    files and pages.
    """
    repo = F.col("source_type") == "repo"
    strict = F.col("source_type").isin("file", "html")
    failed = F.when(strict, F.col("status") != 200).otherwise(F.col("status") >= 400)
    spent = repo & (F.col("status") == 403) & (F.try_element_at("headers", F.lit("x-ratelimit-remaining")) == "0")
    outcome = (
        F.when(F.coalesce(spent, F.lit(False)), "rate_limited")
        .when(repo & (F.col("status") == 404), "not_found")
        .when(failed, "http_error")
        .otherwise("ok")
    )
    url = quoted(F.col("url"))
    reset = F.coalesce(F.try_element_at("headers", F.lit("x-ratelimit-reset")), F.lit("unknown"))
    error = (
        F.when(
            F.col("outcome") == "rate_limited",
            F.concat(F.lit("API rate limit exceeded fetching "), url, F.lit("; resets at epoch "), reset),
        )
        .when(
            F.col("outcome") == "not_found",
            F.concat(F.lit("404 for "), url, F.lit(" - private or nonexistent")),
        )
        .when(
            F.col("outcome") == "http_error",
            F.concat(F.col("source_type"), F.lit(" "), url, F.lit(" returned HTTP "), F.col("status").cast("string")),
        )
    )
    return responses.withColumn("outcome", outcome).withColumn("error", error)


def dispatch_sources(items: DataFrame, url: str = "url", kind: str = "content_kind") -> DataFrame:
    """Add ``route`` and ``backend``: how each item is captured, by host and kind."""
    staged = items.withColumn("_host", U.host(U.split_url(F.col(url))))
    host = F.col("_host")
    text_route = (
        F.when(U.in_domains(host, CODE_DOMAINS), "repo")
        .when(U.in_domains(host, BLOCK_PAGE_DOMAINS), "blocks")
        .when(U.in_domains(host, FILE_DOMAINS), "file")
        .otherwise("html")
    )
    media_route = F.when(U.in_domains(host, GALLERY_DOMAINS), "gallery").otherwise("video")
    backends = F.create_map(
        *(
            F.lit(v)
            for pair in (
                ("repo", "github-api"),
                ("blocks", "notion-api"),
                ("file", "drive-download"),
                ("html", "html-fetch"),
            )
            for v in pair
        )
    )
    return (
        staged.withColumn("route", F.when(F.col(kind) == "text", text_route).otherwise(media_route))
        .withColumn("backend", F.try_element_at(backends, F.col("route")))
        .drop("_host")
    )
