"""Repository captures: API answers to one text, with links that work outside the repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import filled, strip

# Shape of a markdown link or image, and the hosts relative targets lead to.
MARKDOWN_LINK = r'(?U)(!?)\[([^\]]*)\]\(([^)\s]+)((?:\s+"[^"]*")?)\)'
PAGE_HOST = "https://github.com"
RAW_HOST = "https://raw.githubusercontent.com"


def absolute_links(text: Column, owner: Column, repo: Column, ref: Column) -> Column:
    """Rewrite relative link and image targets; absolute, anchor and mail targets stay.

    The text is cut at its links, each link is rebuilt, and the pieces go back in order, so
    links are found left to right without overlap.
    """
    where = F.concat(F.lit("/"), owner, F.lit("/"), repo)

    def rebuilt(link: Column) -> Column:
        bang, label, target, title = (F.regexp_extract(link, MARKDOWN_LINK, g) for g in range(1, 5))
        clean = F.regexp_replace(F.regexp_replace(target, r"\A\./", ""), r"\A/", "")
        page = F.concat(F.lit(PAGE_HOST), where, F.lit("/blob/"), ref, F.lit("/"), clean)
        raw = F.concat(F.lit(RAW_HOST), where, F.lit("/"), ref, F.lit("/"), clean)
        full = F.when(bang == "!", raw).otherwise(page)
        moved = F.concat(bang, F.lit("["), label, F.lit("]("), full, title, F.lit(")"))
        return F.when(target.rlike(r"\A(?:https?://|#|mailto:)"), link).otherwise(moved)

    between = F.split(text, MARKDOWN_LINK, -1)
    links = F.transform(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), 0), rebuilt)
    pieces = F.zip_with(between, links, lambda b, n: F.concat(b, F.coalesce(n, F.lit(""))))
    return F.when(text.contains("]("), F.array_join(pieces, "")).otherwise(text)


def absolutize_links(captures: DataFrame, text: str = "text") -> DataFrame:
    """Rewrite the links of captured files (columns owner, repo, default_branch)."""
    branch = F.coalesce(F.nullif("default_branch", F.lit("")), F.lit("main"))
    return captures.withColumn(
        text, absolute_links(F.col(text), F.col("owner"), F.col("repo"), branch)
    )


def file_text(payload: Column) -> Column:
    """Text of a contents answer; base64 bodies are line-wrapped and may hold bad bytes."""
    content = F.try_variant_get(payload, "$.content", "string")
    based = (F.try_variant_get(payload, "$.encoding", "string") == "base64") & filled(content)
    binary = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    decoded = F.make_valid_utf8(binary.cast("string"))
    return F.when(based, decoded).otherwise(F.coalesce(content, F.lit("")))


def assemble_repo_captures(meta: DataFrame, contents: DataFrame) -> DataFrame:
    """One capture per repository item from its two API answers.

    ``meta`` is (content_id, owner, repo, file_path, payload), ``contents`` is
    (content_id, payload); payloads are JSON text.
    """
    about = meta.withColumn("_meta", F.try_parse_json("payload")).drop("payload")
    body = contents.select("content_id", F.try_parse_json("payload").alias("_file"))
    joined = about.join(body, "content_id")

    def field(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col("_meta"), path, kind)

    branch = F.coalesce(F.nullif(field("$.default_branch"), F.lit("")), F.lit("main"))
    staged = joined.withColumn("_text", file_text(F.col("_file")))
    linked = staged.withColumn(
        "_linked", absolute_links(F.col("_text"), F.col("owner"), F.col("repo"), branch)
    )
    name = F.concat(F.lit("# "), F.col("owner"), F.lit("/"), F.col("repo"))
    heading = F.when(
        filled(F.col("file_path")), F.concat(name, F.lit(" - "), F.col("file_path"))
    ).otherwise(name)
    facts = F.concat(
        F.lit("Stars: "),
        F.coalesce(field("$.stargazers_count", "long").cast("string"), F.lit("0")),
        F.lit(" | Language: "),
        F.coalesce(F.nullif(field("$.language"), F.lit("")), F.lit("unknown")),
        F.lit(" | Topics: "),
        F.coalesce(F.array_join(field("$.topics", "array<string>"), ", "), F.lit("")),
    )
    text = F.concat_ws(
        "\n", heading, F.coalesce(field("$.description"), F.lit("")), facts, F.lit(""), F.col("_linked")
    )
    return linked.select(
        "content_id",
        strip(text).alias("text"),
        F.lit("text").alias("content_kind"),
        F.lit(None).cast("string").alias("language"),
        F.lit("github-api").alias("backend"),
        F.lit(None).cast("double").alias("duration_seconds"),
        F.lit(None).cast("string").alias("error"),
    )
