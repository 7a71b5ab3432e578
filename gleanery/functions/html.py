"""HTML to main text as a chain of native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import decode_entities, strip

# Elements that never hold main text.
DROPPED_ELEMENTS = ("script", "style", "nav", "footer", "aside", "header")
AD_ELEMENTS = ("div", "section", "span", "p", "aside", "ins")
# Elements that start a new line.
BLOCK_ELEMENTS = (
    "address|article|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|form|h1|h2|h3|h4|h5|h6|"
    "hr|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul|noscript|br"
)
#: Pieces walked with one small list; a page of n pieces costs n steps, not n * n.
CHUNK = 256

ROOTS = ("article", "main", "body")


def root_pattern(tag: str) -> str:
    """Content of the first such element, up to its close or the end of the page."""
    return rf"(?is)<{tag}\b[^<>]*>(.*?)(?:</{tag}\s*>|\z)"


# A tag ends at its bracket or where the next begins, so no tag is searched twice.
LINE_BREAKS = rf"(?i)</?(?:{BLOCK_ELEMENTS})\b[^<>]*>"
TAGS = r"<[!/?a-zA-Z][^<>]*>"


def without_noise(html: Column) -> Column:
    """Comments, dropped elements and ads become one blank each, with all they hold.

    The page is cut at each tag that may matter and walked once. Inside a dropped element only tags of its own
    name count, up for an opening and down for a closing one; it ends at depth 0, or with
    the page when it is never closed. Scripts and styles hold no tags.
    """

    def facts(piece: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, r"\A</?([a-zA-Z][a-zA-Z0-9]*)", 1))
        closing = F.startswith(piece, F.lit("</"))
        ad = F.regexp_like(piece, F.lit(r"(?i)\A<[^<>]*\bclass\s*=\s*[\"']?ad[\"']?[\s>]"))
        noise = name.isin(*DROPPED_ELEMENTS) | (name.isin(*AD_ELEMENTS) & ad)
        return F.struct(
            piece.alias("piece"),
            F.when(F.startswith(piece, F.lit("<!--")), F.lit("!")).otherwise(name).alias("name"),
            closing.alias("closing"),
            (noise & ~closing).alias("noise"),
            (F.instr(piece, "-->") + 3).alias("over"),
            (F.instr(piece, ">") + 1).alias("after"),
        )

    def step(state: Column, x: Column) -> Column:
        rest = F.length(x["piece"])
        ended = F.concat(F.lit(" "), F.substring(x["piece"], x["over"], rest))
        closed = F.concat(F.lit(" "), F.when(x["after"] > 1, F.substring(x["piece"], x["after"], rest)).otherwise(""))
        inside, depth = state["inside"], state["depth"]
        own = (inside == x["name"]) & (inside != "!")
        change = F.when(~own, 0).when(x["closing"], -1).when(inside.isin("script", "style"), 0).otherwise(1)
        comment = F.when(inside == "!", True).otherwise((inside == "") & (x["name"] == "!"))
        done = own & (depth + change == 0)
        now = (
            F.when(comment, F.when(x["over"] > 3, F.lit("")).otherwise("!"))
            .when(inside != "", F.when(done, F.lit("")).otherwise(inside))
            .when(x["noise"], x["name"])
            .otherwise("")
        )
        shown = (
            F.when(comment, F.when(x["over"] > 3, ended).otherwise(""))
            .when(inside != "", F.when(done, closed).otherwise(""))
            .when(x["noise"], F.lit(""))
            .otherwise(x["piece"])
        )
        level = F.when(inside != "", depth + change).when(x["noise"], 1).otherwise(0)
        return F.struct(
            now.alias("inside"), level.cast("int").alias("depth"), F.concat(state["out"], F.array(shown)).alias("out")
        )

    nothing = F.array().cast("array<string>")
    # One entry, so that the cut page is a variable of the walk and not cut again at each step.
    def cut(names: tuple[str, ...]) -> Column:
        return F.split(html, rf"(?i)(?=<(?:!--|/?(?:{'|'.join(names)})\b))")

    # Pages without an ad are cut at fewer tags.
    with_ads = F.regexp_like(html, F.lit(r"(?i)\bclass\s*=\s*[\"']?ad[\"']?[\s>]"))
    page = F.array(F.when(with_ads, cut((*DROPPED_ELEMENTS, *AD_ELEMENTS))).otherwise(cut(DROPPED_ELEMENTS)))
    return F.transform(page, lambda pieces: _walk(pieces, facts, step, nothing))[0]


def _walk(pieces: Column, facts: Callable, step: Callable, nothing: Column) -> Column:
    def chunk(state: Column, k: Column) -> Column:
        part = F.transform(F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK)), facts)
        start = F.struct(state["inside"].alias("inside"), state["depth"].alias("depth"), nothing.alias("out"))
        walked = F.aggregate(part, start, step)
        return F.struct(
            walked["inside"].alias("inside"),
            walked["depth"].alias("depth"),
            F.concat(state["out"], F.array(F.array_join(walked["out"], ""))).alias("out"),
        )

    chunks = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int"))
    start = F.struct(F.lit("").alias("inside"), F.lit(0).alias("depth"), nothing.alias("out"))
    return F.array_join(F.aggregate(chunks, start, chunk)["out"], "")


def main_region(html: Column) -> Column:
    """The article, else the main element, else the body, else everything."""
    region = html
    for tag in reversed(ROOTS):
        there = html.rlike(rf"(?i)<{tag}\b[^<>]*>")
        region = F.when(there, F.regexp_extract(html, root_pattern(tag), 1)).otherwise(region)
    return region


def without_tags(html: Column) -> Column:
    """Block-level tags become line ends, other tags nothing."""
    return F.regexp_replace(F.regexp_replace(html, LINE_BREAKS, "\n"), TAGS, "")


def to_lines(text: Column) -> Column:
    """Entities decoded, blanks collapsed, empty lines dropped."""
    text = decode_entities(text)
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    return strip(F.regexp_replace(text, r" ?\n[ \n]*", "\n"))
