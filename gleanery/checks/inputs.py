"""The engine's tables derived from the given ones (pages, events, documents, conversations).

Every derivation is per row or a keyed aggregate, so its work grows with the given tables.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import iso_utc
from gleanery.operators.urls import assign_content_ids, canonicalize_urls
from gleanery.policy import MEDIA_DOMAINS, STATUSES, Policy

AS_OF = datetime(2026, 2, 1, tzinfo=UTC)
POLICY = Policy(
    allowed_domains=(*MEDIA_DOMAINS, "example.net"),
    blocked_domains=("example.org", "three.labels.example.com"),
    text_blocked_domains=("cheap-pills.example.com",),
    max_attempts=2,
    call_intervals={"click": 600.0, "view": 1.5, "error": 0.0, "purchase": 2000.0},
)
STAGES = ("downloaded", "transcribed", "enriched", "note_written")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(ts: str | Column) -> Column:
    """Times leave a query as text, so no session setting can shift them."""
    return iso_utc(F.col(ts) if isinstance(ts, str) else ts)


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def words(c: Column) -> Column:
    return c.cast("string")


def start_plus(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(1767225600) + seconds)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four submissions per page: its URL, two spellings of it, and one odd one."""
    pages = table(spark, sf_dir, "pages")
    pid, url = F.col("page_id"), F.col("url")
    respelled = F.replace(
        F.replace(url, F.lit("https://"), F.lit("HTTPS://")), F.lit("http://"), F.lit("http://www.")
    )
    tracked = text(
        F.substring_index(url, "#", 1),
        F.when(url.contains("?"), "&").otherwise("?"),
        "fbclid=",
        words(pid % 7),
        "&b=2&a=%201+x~*&empty=&c;d=%C3%A9",
    )
    n = words(pid)
    odd = (
        F.when(pid % 10 == 0, text("not a url ", n))
        .when(pid % 10 == 1, text("ftp://files.example.net/", n))
        .when(pid % 10 == 2, text("http://127.0.0.1:11434/", n))
        .when(pid % 10 == 3, text("  http://localhost:8080/", n, "  "))
        .when(pid % 10 == 4, text("http://192.168.1.", words(pid % 256), "/x"))
        .when(pid % 10 == 5, text("https://github.com/own", words(pid % 13), "/repo", n, "/blob/main/docs/a b.md"))
        .when(pid % 10 == 6, text("https://www.notion.so/Some-Title-", F.md5(n), "?pvs=4"))
        .when(pid % 10 == 7, text("https://drive.google.com/file/d/file_", n, "-x/view?usp=sharing"))
        .when(pid % 10 == 8, text("https://m.youtube.com/watch?v=", n, "&si=abc"))
        .otherwise(text("https://www.instagram.com/p/", n, "/?img_index=", words(pid % 4)))
    )
    variants = F.array(
        *(
            F.struct(F.lit(i).cast("long").alias("v"), u.alias("url"))
            for i, u in enumerate((url, respelled, tracked, odd))
        )
    )
    return pages.select("page_id", F.explode(variants).alias("s")).select(
        (pid * 4 + F.col("s.v")).alias("seq"),
        F.col("s.url").alias("url"),
        F.when(pid % 2 == 0, "queue_file").otherwise("webhook").alias("source"),
        start_plus((pid * 7 + F.col("s.v") * 3) % 11).alias("submitted_at"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe answers for the ambiguous host: every other probed file is a video."""
    urls = submissions(spark, sf_dir).filter(F.col("url").contains("drive.google.com"))
    return urls.select("url", (F.col("seq") % 8 == 3).alias("probe_ok"))


def _pick(values: tuple[str | None, ...], index: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows for the even pages, spread over all statuses and stages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").filter("page_id % 2 = 0")
    keyed = assign_content_ids(canonicalize_urls(pages))
    first = keyed.groupBy("content_id").agg(
        F.min_by(F.struct("page_id", "url", "normalized_url"), "page_id").alias("p")
    )
    rows = first.select("content_id", "p.*", F.floor(F.col("p.page_id") / 2).alias("k"))
    k = F.col("k")
    status = _pick(STATUSES, k % 9)
    done = F.col("status") == "done"
    nothing = F.lit(None).cast("string")
    return (
        rows.withColumn("status", status)
        .withColumns(
            {
                "source": F.lit("queue_file"),
                "content_kind": F.when(k % 3 == 0, "media").otherwise("text"),
                "added_at": start_plus(k * 60),
                "updated_at": start_plus(k * 60 + 3600),
                "error": F.when(F.col("status").startswith("failed"), text("e", words(k % 3))),
                "note_path": F.when(done, text("vault/d", words(k % 4), "/note-", words(k), ".md")),
                "skill_path": F.when(done & (k % 4 == 0), text("skills/s", words(k), "/SKILL.md")),
                "attempt_count": (k % 5).cast("int"),
                "next_retry_at": F.when(
                    F.col("status") == "failed",
                    F.timestamp_seconds(F.lit(int(AS_OF.timestamp())) + (k % 7 - 3) * 3600),
                ),
                "last_completed_stage": _pick((None, *STAGES), k % 5),
                "skill_error": nothing,
            }
        )
        .drop("page_id", "k")
        .select(
            "content_id",
            "url",
            "normalized_url",
            "source",
            "status",
            "content_kind",
            "added_at",
            "updated_at",
            "error",
            "note_path",
            "skill_path",
            "attempt_count",
            "next_retry_at",
            "last_completed_stage",
            "skill_error",
        )
    )


def id_number(content_id: str = "content_id") -> Column:
    """A small number read off an id, to vary rows by."""
    return F.conv(F.substring(F.col(content_id), 1, 4), 16, 10).cast("long")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an attempt log: an item per user, a manual retry on some sign-ups."""
    k = F.get_json_object("props", "$.k").cast("long")
    reset = (F.col("event_type") == "signup") & (F.col("k") < 20)
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", k)
        .select(
            text("item-", words(F.col("user_id"))).alias("content_id"),
            F.col("event_id").alias("attempt_id"),
            F.col("ts").cast("timestamp").alias("attempt_ts"),
            F.when(reset, "reset").otherwise("attempt").alias("kind"),
            (~F.col("event_type").isin("error", "click")).alias("ok"),
            F.when(F.col("event_type").isin("error", "click"), text("e", words(F.col("k") % 3))).alias("error"),
        )
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("provider"),
        F.col("ts").cast("timestamp").alias("arrived_at"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as clips of one item."""
    turn = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        words(F.col("conv_id")).alias("content_id"),
        turn.alias("clip_no"),
        "text",
        F.when(F.col("role") == "assistant", "en").otherwise("").alias("language"),
        text("backend-", F.col("role")).alias("backend"),
        F.when(turn % 3 > 0, (turn % 3) * F.lit(0.5)).alias("duration_seconds"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each turn as the segments of a clip."""
    lines = F.posexplode(F.split("text", "\n"))
    return (
        table(spark, sf_dir, "conversations")
        .select(words(F.col("conv_id")).alias("content_id"), F.col("turn").alias("clip_no"), lines.alias("seg_no", "line"))
        .select("content_id", "clip_no", "seg_no", text("  ", F.col("line"), " ").alias("text"))
    )


SUFFIXES = (".mp4", ".jpg", ".MOV", ".png", ".mp3", ".txt", ".webm", ".jpeg")


def media_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as downloaded files of every kind."""
    conv, turn = F.col("conv_id"), F.col("turn")
    kind = conv * 5 + turn * F.when(conv % 3 == 0, 2).otherwise(1)
    path = text("tmp/", words(conv), "/", F.lpad(words(turn), 6, "0"), _pick(SUFFIXES, kind % 8))
    return table(spark, sf_dir, "conversations").select(
        words(conv).alias("content_id"),
        path.alias("path"),
        F.when((conv + turn) % 4 == 0, F.lit(True)).when((conv + turn) % 4 < 3, F.lit(False)).alias("has_audio"),
        F.when(conv % 4 > 0, text(path, ".frame.jpg")).alias("frame_path"),
    )


def title_of(c: Column) -> Column:
    """The first twelve words of a text on one line."""
    flat = F.regexp_replace(c, r"\s+", " ")
    return F.array_join(F.slice(F.split(flat, " "), 1, 12), " ")


def _escaped(c: Column) -> Column:
    out = c
    for raw, shown_as in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(shown_as))
    return out


def enrichment_json(doc_id: Column, body: Column, lang: Column) -> Column:
    """A model's record for a document; some break the contract in different ways."""
    n = words(doc_id)
    return text(
        '{"title": ',
        F.when(doc_id % 17 == 5, n).otherwise(text('"', _escaped(title_of(body)), '"')),
        ', "summary": "',
        _escaped(body),
        '"',
        F.when(doc_id % 19 == 3, text(', "tags": null'))
        .when(doc_id % 19 == 4, text(', "tags": ["a", ', n, "]"))
        .when(doc_id % 19 == 5, text(', "tags": []'))
        .when(doc_id % 19 == 6, text(""))
        .otherwise(text(', "tags": ["', lang, '", "t', words(doc_id % 5), '"]')),
        ', "key_takeaways": ["keep ',
        n,
        '"]',
        F.when(doc_id % 11 == 0, ', "high_signal": true')
        .when(doc_id % 11 == 1, ', "high_signal": "yes"')
        .when(doc_id % 11 == 2, ', "high_signal": 1')
        .when(doc_id % 11 == 3, ', "high_signal": 2')
        .when(doc_id % 11 == 4, ', "high_signal": "off"')
        .otherwise(""),
        F.when(doc_id % 3 == 0, text(', "skill_candidate_reason": "why ', n, '"')).otherwise(""),
        ', "extra": {"x": [1, 2]}}',
    )


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model texts for all documents: plain, fenced, wrapped in prose, after reasoning, broken."""
    doc_id = F.col("doc_id")
    record = enrichment_json(doc_id, F.col("text"), F.col("lang"))
    wrapped = (
        F.when(doc_id % 6 == 1, text("```json\n", F.col("record"), "\n```"))
        .when(doc_id % 6 == 2, text("Here it is: ", F.col("record"), " Done."))
        .when(doc_id % 6 == 3, text("<think>hm {", words(doc_id), "</think>\n", F.col("record")))
        .when(doc_id % 6 == 4, text("  ", F.col("record"), "\n"))
        .when(doc_id % 30 == 5, text("no record ", words(doc_id), " {here"))
        .when(doc_id % 30 == 11, text("<think>cut off ", F.col("record")))
        .when(doc_id % 30 == 17, text("[1, 2]"))
        .otherwise(F.col("record"))
    )
    return (
        table(spark, sf_dir, "documents")
        .withColumn("record", record)
        .select(words(doc_id).alias("content_id"), "doc_id", wrapped.alias("text"))
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as finished items: enrichment fields, source and text."""
    doc_id = F.col("doc_id")
    no_words = F.array().cast("array<string>")
    return table(spark, sf_dir, "documents").select(
        words(doc_id).alias("content_id"),
        text("https://example.com/doc/", words(doc_id)).alias("source_url"),
        F.timestamp_micros(F.lit(1767225600000000) + doc_id * 1500000).alias("created_at"),
        title_of(F.col("text")).alias("title"),
        text("About ", F.col("lang"), ' "', words(doc_id), '"').alias("summary"),
        F.array(F.col("lang"), text("n", words(doc_id % 5))).alias("tags"),
        F.when(doc_id % 2 == 0, F.array(F.col("source"))).otherwise(no_words).alias("tools_mentioned"),
        F.when(doc_id % 3 == 0, no_words)
        .otherwise(F.array(text("first ", words(doc_id)), F.lit("second")))
        .alias("key_takeaways"),
        (doc_id % 4 == 0).alias("high_signal"),
        F.when(doc_id % 8 == 0, text("reason ", words(doc_id)))
        .when(doc_id % 8 == 4, "")
        .alias("skill_candidate_reason"),
        "text",
    )


def naming(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items to name (few titles, so most clash) and the files already in their folders."""
    doc_id = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    first_word = F.substring_index(title_of(F.col("text")), " ", 1)
    named = docs.select(
        words(doc_id).alias("content_id"),
        F.when(doc_id % 50 == 7, "***").otherwise(text(first_word, " ", F.col("lang"))).alias("title"),
        start_plus((doc_id * 37) % 101).alias("added_at"),
        text("d", words(doc_id % 2), "/").alias("folder"),
    )
    present = docs.filter("doc_id % 5 = 0").select(
        text("d", words(doc_id % 2), "/").alias("folder"),
        text(
            F.regexp_replace(F.lower(text(first_word, " ", F.col("lang"))), "[^a-z0-9]+", "-"),
            F.when(doc_id % 3 == 0, "").otherwise(text("-", words(doc_id % 7 + 2))),
            ".md",
        ).alias("note_name"),
        F.when(doc_id % 4 > 0, text("other-", words(doc_id))).alias("owner"),
    )
    kept = present.groupBy("folder", "note_name").agg(F.max("owner").alias("owner"))
    return named, kept


def gated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a challenge, a login wall, an app shell or an incidental phrase put in."""
    pid = F.col("page_id")
    notice = (
        F.when(pid % 10 == 3, "<p>Just a moment...</p>")
        .when(pid % 10 == 4, "<p>Please log in to go on.</p>")
        .when(pid % 10 == 5, "<noscript>Please enable JavaScript to see this page.</noscript>")
        .otherwise("")
    )
    html = F.replace(F.col("html"), F.lit("<article>"), F.concat(F.lit("<article>"), notice))
    late = F.replace(html, F.lit("</article>"), F.lit("<p>just a moment, please log in</p></article>"))
    shell = F.when(pid % 10 == 6, "<html><body><div id=root></div></body></html>").otherwise(late)
    return table(spark, sf_dir, "pages").select(words(pid).alias("content_id"), "page_id", "url", shell.alias("html"))


BLOCK_TYPES = ("text", "text", "image", "collection_view", "bulleted_list", "text", "pdf")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document as a block page: line i hangs under line (i - 1) div 2.

    Line 1 also links back to its page, as pages with mentions do.
    """
    n = F.col("n")
    lines = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
        .select(
            text("p", words(F.col("doc_id"))).alias("page_id"),
            "doc_id",
            n,
            F.col("line").alias("title"),
            _pick(BLOCK_TYPES, n % 7).alias("type"),
        )
    )
    page = F.col("page_id")

    def block(i: Column) -> Column:
        return F.when(i == 0, page).otherwise(text(page, "-", words(i)))

    parent = F.when(n > 0, block(F.floor((n - 1) / 2)))
    tree = lines.select(
        "page_id",
        parent.alias("parent_id"),
        F.when(n == 0, F.lit(0)).otherwise((n - 1) % 2 + 1).cast("int").alias("pos"),
        block(n).alias("block_id"),
        F.when(n == 0, "page").otherwise(F.col("type")).alias("type"),
        F.when((n == 0) & (F.col("doc_id") % 9 == 0), "").otherwise(F.col("title")).alias("title"),
    )
    # A link back to the page itself from line 1; the walk must not follow it.
    back = lines.filter("n = 1").select(
        "page_id",
        block(F.lit(1)).alias("parent_id"),
        F.lit(0).alias("pos"),
        page.alias("block_id"),
        F.lit("page").alias("type"),
        F.lit("").alias("title"),
    )
    return tree.unionByName(back)
