"""Model calls as tables: prompts, requests, answers, and the typed records in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.functions.text import quoted, strip
from gleanery.operators.once import computed_once
from gleanery.schemas import parse

# Marker between the shared and the per-call part of a prompt.
CACHE_BOUNDARY = "<!-- CACHE:BOUNDARY -->"
# Tags around inline reasoning.
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
# Retry rule after a rate-limit answer.
RATE_LIMITED = 429
WAIT_RETRIES = 3
BASE_WAIT = 5.0
LONGEST_WAIT = 60.0
# Ways a vision model says it did not see the pictures.
REFUSAL = (
    r"(?i)\b(?:cannot|can ?not|can't|unable to|not able to|don't have the ability to)\s+"
    r"(?:\w+\s+){0,2}"
    r"(?:view|see|access|open|display|process|read|analyze|interpret|identify|look at)\s+"
    r"(?:\w+\s+){0,3}"
    r"(?:image|photo|picture|screenshot)s?\b"
)
ASKS_FOR_IMAGES = (
    r"(?i)\bplease\s+(?:\w+\s+){0,2}"
    r"(?:provide|share|send|attach|upload|paste)\s+"
    r"(?:\w+\s+){0,3}"
    r"(?:image|photo|picture|screenshot)s?\b"
)
# Strings a boolean field may hold.
TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off")

CHAT_PROVIDERS = ("groq", "cerebras")
# What spent quotas say.
EXHAUSTED = (
    "Gemini response had no text content: max_tokens was exhausted (likely by the model's "
    "internal 'thinking' before any answer text) - try raising max_tokens."
)


def bullets(items: Column) -> Column:
    """One dash line per item, or the placeholder line."""
    lines = F.transform(items, lambda t: F.concat(F.lit("- "), t))
    return F.when(F.size(items) > 0, F.array_join(lines, "\n")).otherwise("- (none)")


def fill_and_split(template: Column, values: dict[str, Column]) -> tuple[Column, Column]:
    """Fill the slots in order; parts before and after the cache boundary."""
    filled_in = template
    for name, value in values.items():
        filled_in = F.replace(filled_in, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    at = F.locate(CACHE_BOUNDARY, filled_in)
    before = strip(F.substring(filled_in, F.lit(1), at - 1))
    after = strip(F.substring(filled_in, at + len(CACHE_BOUNDARY), F.length(filled_in)))
    return (
        F.when(at == 0, F.lit("")).otherwise(before),
        F.when(at == 0, filled_in).otherwise(after),
    )


def render_prompts(captures: DataFrame, prompts: dict[str, str], values: dict[str, Column]) -> DataFrame:
    """Add ``static_prefix`` and ``prompt``; ``prompts`` holds the template per content kind.

    Templates are a handful of texts a person writes, so they travel inside the plan.
    """
    template = F.lit(None).cast("string")
    for kind, text in prompts.items():
        template = F.when(F.col("content_kind") == kind, F.lit(text)).otherwise(template)
    rendered = captures.withColumn("_template", template)
    prefix, prompt = fill_and_split(F.col("_template"), values)
    return rendered.withColumns({"static_prefix": prefix, "prompt": prompt}).drop("_template")


def render_skill_prompts(items: DataFrame, template: str) -> DataFrame:
    """Prompts for skill texts from title, summary, reason, takeaways and transcript."""
    prefix, prompt = fill_and_split(
        F.lit(template),
        {
            "title": F.col("title"),
            "summary": F.col("summary"),
            "skill_candidate_reason": F.col("skill_candidate_reason"),
            "key_takeaways": bullets(F.col("key_takeaways")),
            "transcript": F.col("text"),
        },
    )
    return items.withColumns({"static_prefix": prefix, "prompt": prompt})


def render_image_prompts(media: DataFrame, template: str) -> DataFrame:
    """One prompt per picture post (rows of group_media), telling the number of pictures."""
    posts = media.filter("media_type = 'image'").groupBy("content_id").agg(
        F.count("*").alias("image_count")
    )
    prefix, prompt = fill_and_split(
        F.lit(template), {"image_count": F.col("image_count").cast("string")}
    )
    return posts.withColumns({"static_prefix": prefix, "prompt": prompt})


def build_model_requests(
    prompts: DataFrame, model: str, max_tokens: int, json_mode: bool = False, context: int = 16384
) -> DataFrame:
    """Add ``request``, the JSON body for the row's ``provider``."""
    shared, prompt = F.col("static_prefix"), F.col("prompt")
    joined = F.when(shared != "", F.concat(shared, F.lit("\n\n"), prompt)).otherwise(prompt)

    def messages(text: Column) -> Column:
        one = F.struct(F.lit("user").alias("role"), text.alias("content"))
        return F.array(one).alias("messages")

    head = [F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens")]
    cached = F.array(
        F.struct(
            F.lit("text").alias("type"),
            shared.alias("text"),
            F.struct(F.lit("ephemeral").alias("type")).alias("cache_control"),
        )
    )
    system = F.when(shared != "", cached).alias("system")
    json_only = F.struct(F.lit("json_object").alias("type"))
    chat_tail = [json_only.alias("response_format")] if json_mode else []
    config = [F.lit(max_tokens).alias("maxOutputTokens")]
    if json_mode:
        config.append(F.lit("application/json").alias("response_mime_type"))
    options = F.struct(F.lit(max_tokens).alias("num_predict"), F.lit(context).alias("num_ctx"))
    parts = F.array(F.struct(F.array(F.struct(joined.alias("text"))).alias("parts")))
    body = (
        F.when(F.col("provider") == "anthropic", F.to_json(F.struct(*head, messages(prompt), system)))
        .when(
            F.col("provider") == "ollama",
            F.to_json(
                F.struct(
                    head[0],
                    joined.alias("prompt"),
                    F.lit(False).alias("stream"),
                    options.alias("options"),
                )
            ),
        )
        .when(
            F.col("provider").isin(*CHAT_PROVIDERS),
            F.to_json(F.struct(*head, messages(joined), *chat_tail)),
        )
        .when(
            F.col("provider") == "gemini",
            F.to_json(
                F.struct(parts.alias("contents"), F.struct(*config).alias("generationConfig"))
            ),
        )
    )
    return prompts.withColumn("request", body)


def without_reasoning(text: Column) -> Column:
    """The answer after the last closing think tag; nothing if reasoning was cut off."""
    return (
        F.when(text.contains(THINK_CLOSE), strip(F.substring_index(text, THINK_CLOSE, -1)))
        .when(text.contains(THINK_OPEN), F.lit(""))
        .otherwise(strip(text))
    )


def strip_reasoning(responses: DataFrame, text: str = "text") -> DataFrame:
    return responses.withColumn(text, without_reasoning(F.col(text)))


def read_model_responses(responses: DataFrame) -> DataFrame:
    """Add ``text`` and ``error`` for answers (content_id, provider, payload as JSON text)."""
    staged = computed_once(responses, {"_doc": F.try_parse_json("payload")})
    doc, provider = F.col("_doc"), F.col("provider")

    def joined_texts(path: str, only_text_blocks: bool) -> Column:
        parts = F.try_variant_get(doc, path, "array<variant>")
        if only_text_blocks:
            parts = F.filter(parts, lambda p: F.try_variant_get(p, "$.type", "string") == "text")
        texts = F.transform(
            parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))
        )
        return F.when(F.size(texts) > 0, F.array_join(texts, ""))

    chat = F.try_variant_get(doc, "$.choices[0].message.content", "string")
    text = (
        F.when(provider == "anthropic", joined_texts("$.content", True))
        .when(provider == "ollama", F.try_variant_get(doc, "$.response", "string"))
        .when(provider == "groq", without_reasoning(chat))
        .when(provider == "cerebras", chat)
        .when(provider == "gemini", joined_texts("$.candidates[0].content.parts", False))
    )
    labels = {
        "anthropic": "Claude API",
        "ollama": "Ollama",
        "groq": "Groq API",
        "cerebras": "Cerebras API",
        "gemini": "Gemini API",
    }
    label = F.lit("Model")
    for name, shown in labels.items():
        label = F.when(provider == name, shown).otherwise(label)
    # Only the block-list provider may answer with an empty but present text.
    empty = F.col("text").isNull() | ((provider != "anthropic") & (F.col("text") == ""))
    reason = F.try_variant_get(doc, "$.candidates[0].finishReason", "string")
    exhausted = (provider == "gemini") & F.coalesce(reason == "MAX_TOKENS", F.lit(False))
    nothing = F.concat(label, F.lit(" response had no text content: "), F.col("payload"))
    read = computed_once(staged, {"text": text})
    error = F.when(empty & exhausted, F.lit(EXHAUSTED)).when(empty, nothing)
    return (
        read.withColumn("error", error)
        .withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
        .drop("_doc")
    )


def rate_limit_waits(responses: DataFrame) -> DataFrame:
    """Add ``wait_seconds`` and ``action`` (ok, retry, give_up) for answers (status, headers, attempt).

    ``attempt`` counts from 0. A wait that is too long is not slept through.
    """
    told = strip(F.coalesce(F.try_element_at("headers", F.lit("retry-after")), F.lit("")))
    number = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
    asked = F.when(told.rlike(number), told.try_cast("double"))
    doubling = F.lit(BASE_WAIT) * F.pow(F.lit(2.0), F.col("attempt"))
    wait = F.when(asked.isNull(), doubling).otherwise(F.greatest(asked, F.lit(0.0)))
    limited = F.col("status") == RATE_LIMITED
    stop = (F.col("wait_seconds") > LONGEST_WAIT) | (F.col("attempt") >= WAIT_RETRIES)
    return responses.withColumn("wait_seconds", F.when(limited, wait)).withColumn(
        "action", F.when(~limited, "ok").when(stop, "give_up").otherwise("retry")
    )


def flag_refusals(answers: DataFrame, text: str = "text") -> DataFrame:
    """Add ``refused`` and the ``error`` quoting its opening."""
    plain = F.translate(strip(F.col(text)), "‘’", "''")
    refused = F.coalesce(plain.rlike(REFUSAL) | plain.rlike(ASKS_FOR_IMAGES), F.lit(False))
    opening = quoted(F.substring(strip(F.col(text)), 1, 200))
    note = F.lit(
        "the vision model refused to describe the image(s) rather than returning a description: "
    )
    return answers.withColumn("refused", refused).withColumn(
        "error", F.when(F.col("refused"), F.concat(note, opening))
    )


def parse_enrichments(answers: DataFrame, text: str = "text") -> DataFrame:
    """Add the enrichment fields and ``error`` from model texts.

    Code fences go first, then the text must be JSON, or hold JSON between its outermost
    braces. Types are strict: a number is not a title, a null is not a list. Of a repeated key
    the last value counts (this sets the session's option for duplicate keys in JSON).
    """
    answers.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    bare = strip(F.col(text))
    unfenced = F.regexp_replace(bare, r"(?m)^```(?:json)?\s*|\s*```$", "")
    body = F.when(bare.contains("```"), strip(unfenced)).otherwise(bare)
    staged = computed_once(answers, {"_body": body})
    inner = F.nullif(F.regexp_extract("_body", r"(?s)\{.*\}", 0), F.lit(""))
    staged = computed_once(staged, {"_whole": F.try_parse_json("_body")})
    staged = computed_once(
        staged,
        {"_doc": F.coalesce("_whole", F.when(F.col("_whole").isNull(), F.try_parse_json(inner)))},
    )
    doc = F.col("_doc")

    def shape(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))

    def absent(path: str) -> Column:
        return F.try_variant_get(doc, path, "variant").isNull()

    def words(path: str) -> Column:
        return F.try_variant_get(doc, path, "array<string>")

    def bad_list(path: str) -> Column:
        typed = shape(path).isin("ARRAY<STRING>", "ARRAY<VOID>")
        hole = F.coalesce(F.exists(words(path), lambda w: w.isNull()), F.lit(False))
        return ~absent(path) & (~typed | hole)

    signal = F.lower(F.try_variant_get(doc, "$.high_signal", "string"))
    numeric = F.try_variant_get(doc, "$.high_signal", "double")
    kind = shape("$.high_signal")
    is_word = kind.isin("STRING", "BOOLEAN")
    is_number = ~kind.isin("STRING", "BOOLEAN", "VOID") & numeric.isNotNull()
    flag = (
        F.when(absent("$.high_signal"), F.lit(False))
        .when((is_word & signal.isin(*TRUE_WORDS)) | (is_number & (numeric == 1)), F.lit(True))
        .when((is_word & signal.isin(*FALSE_WORDS)) | (is_number & (numeric == 0)), F.lit(False))
    )
    reason_ok = absent("$.skill_candidate_reason") | shape("$.skill_candidate_reason").isin("STRING", "VOID")
    problem = (
        F.when(doc.isNull(), F.concat(F.lit("Could not parse JSON from model output: "), quoted(F.col(text))))
        .when(~F.schema_of_variant(doc).startswith("OBJECT"), F.lit("model output is not a JSON object"))
        .when(absent("$.title") | (shape("$.title") != "STRING"), F.lit("title: not a string"))
        .when(absent("$.summary") | (shape("$.summary") != "STRING"), F.lit("summary: not a string"))
        .when(bad_list("$.tags"), F.lit("tags: not a list of strings"))
        .when(bad_list("$.tools_mentioned"), F.lit("tools_mentioned: not a list of strings"))
        .when(bad_list("$.key_takeaways"), F.lit("key_takeaways: not a list of strings"))
        .when(flag.isNull(), F.lit("high_signal: not a boolean"))
        .when(~reason_ok, F.lit("skill_candidate_reason: not a string"))
    )
    checked = computed_once(staged, {"error": problem})
    good = F.col("error").isNull()
    values = {
        "title": F.try_variant_get(doc, "$.title", "string"),
        "summary": F.try_variant_get(doc, "$.summary", "string"),
        "tags": F.coalesce(words("$.tags"), F.array().cast("array<string>")),
        "tools_mentioned": F.coalesce(words("$.tools_mentioned"), F.array().cast("array<string>")),
        "key_takeaways": F.coalesce(words("$.key_takeaways"), F.array().cast("array<string>")),
        "high_signal": flag,
        "skill_candidate_reason": F.try_variant_get(doc, "$.skill_candidate_reason", "string"),
    }
    return checked.withColumns({n: F.when(good, c) for n, c in values.items()}).drop(
        "_body", "_whole", "_doc"
    )


BatchFunction = Callable[[pd.DataFrame], pd.DataFrame]


def apply_model(
    items: DataFrame, make_model: Callable[[], BatchFunction], schema: str, key: str = "content_id"
) -> DataFrame:
    """Run a user's model over rows: (key, fields of ``schema``, error).

    ``make_model`` runs once per partition and returns a function from a pandas batch to a
    pandas batch with one row per input row. A batch that raises is halved and tried again,
    so an exception becomes the error of the row that caused it and of no other.
    """
    fields = [f.name for f in parse(schema)]
    key_type = items.schema[key].dataType
    out = T.StructType([T.StructField(key, key_type), *parse(schema), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()

        def attempt(rows: pd.DataFrame) -> pd.DataFrame:
            made = model(rows).reset_index(drop=True)
            if len(made) != len(rows):
                raise ValueError(f"model returned {len(made)} rows for {len(rows)}")
            made = made[fields].copy()
            made.insert(0, key, rows[key].to_numpy())
            made["error"] = None
            return made

        def failed(row: pd.DataFrame, exc: Exception) -> pd.DataFrame:
            values = {key: row[key].to_numpy(), **{f: [None] for f in fields}}
            return pd.DataFrame({**values, "error": [str(exc) or repr(exc)]})

        for batch in batches:
            waiting = [batch] if len(batch) else []
            while waiting:
                rows = waiting.pop()
                try:
                    yield attempt(rows)
                except Exception as exc:  # noqa: BLE001 - the row at fault keeps its error
                    if len(rows) == 1:
                        yield failed(rows, exc)
                    else:
                        half = len(rows) // 2
                        waiting += [rows.iloc[half:], rows.iloc[:half]]

    return items.mapInPandas(run, out)

