"""Text inbox, attention log, artifacts, media listings, notes, skills, logs and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.text import iso_utc, strip
from gleanery.schemas import LOGS, parse
from gleanery.sources.keyed_log import KeyedLog

NOTES = "content_id STRING, note_path STRING, content STRING"
FRONT_MATTER = r"\A---\n([\s\S]*?)\n---\n"


def _inbox_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, split of the file, and number inside the split."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
    )
    return spark.read.text(path).select(place.alias("seq"), strip(F.col("value")).alias("url"))


def _is_entry() -> Column:
    return (F.col("url") != "") & ~F.col("url").startswith("#")


def read_submissions(spark: SparkSession, path: str, source: str = "queue_file") -> DataFrame:
    """URLs of a line inbox; ``seq`` is the line's place and orders like the file does.

    Large files are read in splits: a split's lines keep their order, and splits order by
    their offset.
    """
    return _inbox_lines(spark, path).filter(_is_entry()).select(
        "seq", "url", F.lit(source).alias("source"), F.lit(None).cast("timestamp").alias("submitted_at")
    )


def remaining_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Comments and blank lines, which stay in the inbox after it is drained."""
    return _inbox_lines(spark, path).filter(~_is_entry())


def stream_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submission events {url} landing as JSON files."""
    events = spark.readStream.schema("seq LONG, url STRING, submitted_at TIMESTAMP").json(path)
    # A bare {url} takes its place and time from the file it came in.
    return events.select(
        F.coalesce("seq", "_metadata.file_block_start").alias("seq"),
        "url",
        F.coalesce("submitted_at", "_metadata.file_modification_time").alias("submitted_at"),
        F.lit("webhook").alias("source"),
    )


def parse_attention(lines: DataFrame, line: str = "value") -> DataFrame:
    """Attention rows (ts, url, reason, line); a line with no readable time has none."""
    parts = F.split(F.col(line), "\t", 3)
    return lines.select(
        F.try_to_timestamp(F.get(parts, F.lit(0))).alias("ts"),
        F.get(parts, F.lit(1)).alias("url"),
        F.get(parts, F.lit(2)).alias("reason"),
        F.col(line).alias("line"),
    )


def read_attention(spark: SparkSession, path: str) -> DataFrame:
    return parse_attention(spark.read.text(path))


def attention_lines(rows: DataFrame) -> DataFrame:
    """The log line of each attention row (ts, url, reason)."""
    return rows.select(F.concat_ws("\t", iso_utc(F.col("ts")), "url", "reason").alias("value"))


def append_attention(rows: DataFrame, path: str) -> None:
    attention_lines(rows).write.mode("append").text(path)


def write_artifacts(rows: DataFrame, path: str) -> None:
    """Replace a stage's output table, keyed by content_id."""
    rows.write.mode("overwrite").parquet(path)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def parse_artifacts(files: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Stage outputs kept as JSON text; one that cannot be read counts as missing.

    ``files`` is (content_id, value). ``title STRING NOT NULL`` style requirements are left
    to the caller; here a row must parse and hold at least one field.
    """
    fields = parse(schema)
    opened = files.withColumn("_doc", F.from_json(value, fields, {"mode": "PERMISSIVE"}))
    some = F.coalesce(*(F.col("_doc")[f.name].cast("string") for f in fields))
    whole = F.try_parse_json(F.col(value)).isNotNull()
    return opened.filter(whole & some.isNotNull()).select("content_id", "_doc.*")


def list_media(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root/<content_id>/`` as rows; the bytes are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    )
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    owner = F.regexp_extract("path", rf"\Q{base}\E/([^/]+)/", 1)
    return files.select(
        owner.alias("content_id"),
        "path",
        F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1)).alias("suffix"),
        F.col("modificationTime").alias("modified_at"),
        "length",
    )


def notes_log(spark: SparkSession, path: str) -> KeyedLog:
    """The notes table under a path, by ``note_path``."""
    return KeyedLog(spark, path, NOTES, "note_path")


def write_notes(notes: DataFrame, path: str) -> int:
    """Add notes (content_id, note_path, content) to the notes table and return its new version.

    A note replaces the one at its path; all others stay and are not written again. Of several
    texts for a path in one call the largest (content_id, content) counts.
    """
    last = notes.groupBy("note_path").agg(F.max(F.struct("content_id", "content")).alias("_n"))
    log = notes_log(notes.sparkSession, path)
    version = log.add(last.select("_n.content_id", "note_path", "_n.content"), "notes", log.manifest()[0] + 1)
    log.compact()
    return version


def read_notes_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest notes table, or None when there is none."""
    log = notes_log(spark, path)
    return log.read() if log.manifest()[0] else None


def parse_notes(notes: DataFrame, content: str = "content") -> DataFrame:
    """Add ``owner`` and ``title`` from front matter; both null when there is none."""
    block = F.regexp_extract(F.col(content), FRONT_MATTER, 1)

    def value(name: str) -> Column:
        raw = F.regexp_extract(block, rf"(?m)^{name}:[ ]*(.*)$", 1)
        quoted = F.try_variant_get(F.try_parse_json(raw), "$", "string")
        plain = F.regexp_replace(strip(raw), r"\A'(.*)'\z", "$1")
        return F.nullif(F.coalesce(F.when(raw.startswith('"'), quoted), plain), F.lit(""))

    return notes.withColumns({"owner": value("content_id"), "title": value("title")})


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes kept as one file each: (note_path, content, owner, title)."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\Afile:/+", "/")
    return parse_notes(files.select(path.alias("note_path"), F.col("value").alias("content")))


def write_skills(skills: DataFrame, path: str) -> None:
    """Replace the skills table; the last text per path is kept."""
    from gleanery.operators.publish import last_skill_per_path

    last_skill_per_path(skills).write.mode("overwrite").parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(parse(LOGS)).json(path)


def parse_logs(lines: DataFrame, line: str = "value") -> DataFrame:
    return lines.select(F.from_json(line, parse(LOGS)).alias("_log")).select("_log.*")


def render_logs(logs: DataFrame) -> DataFrame:
    """Log rows as JSON lines; what a row does not have is not written."""
    fields = [
        iso_utc(F.col("timestamp")).alias("timestamp"),
        "level",
        "logger",
        "message",
        F.when(F.size("context") > 0, F.col("context")).alias("context"),
        "exc_info",
    ]
    return logs.select(F.to_json(F.struct(*fields)).alias("value"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages: (content_id, url, status, headers, body)."""
    return spark.read.parquet(path)

