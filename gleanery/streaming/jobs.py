"""Streaming forms: continuous registration, retry timers, and health kept current."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gleanery.durable import durable
from gleanery.operators.attempts import replay_attempts
from gleanery.operators.ordered import HOT_ROWS, order_rows, running
from gleanery.operators.registry import first_submission, register_first, screen_submissions
from gleanery.policy import FAILED_STATUSES, TERMINAL_STATUSES, Policy
from gleanery.sources.keyed_log import KeyedLog
from gleanery.sources.storage import read_state, state_log, write_batch

ATTEMPT = ("content_id", "attempt_id", "attempt_ts", "kind", "ok", "error")
ITEMS = "content_id STRING, attempt_count INT, error STRING, due_at TIMESTAMP, gave_up BOOLEAN"
CLOCK = "name STRING, at TIMESTAMP"
BEFORE_ALL = "0001-01-01 00:00:00"


def current_state(spark: SparkSession, state_path: str, added_path: str) -> DataFrame:
    """The state plus what streaming registration added to it."""
    base = read_state(spark, state_path)
    fresh = read_state(spark, added_path).join(base.select("content_id"), "content_id", "left_anti")
    return base.unionByName(fresh.select(*base.columns))


def query_id(spark: SparkSession) -> str:
    """The id of the streaming query that runs the current batch; kept by its checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def stream_register(
    stream: DataFrame,
    state_path: str,
    added_path: str,
    attention_path: str,
    policy: Policy,
    as_of: datetime | None = None,
) -> DataStreamWriter:
    """Register a stream of submissions; every micro-batch adds only its new keys.

    State and additions are tables cut into buckets by key: a batch opens only the buckets its own
    keys fall into and writes its new rows, and additions are folded together now and then, so
    a batch costs the same however many came before. A batch that is delivered again is looked up
    without its own output and replaces it, so a key is registered once for ever. Output is
    named by the query's id and the batch's number: a new checkpoint never overwrites an old one's.
    """

    def register(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = query_id(spark)
        added = state_log(spark, added_path)
        first = first_submission(screen_submissions(batch, policy)).persist()
        try:
            buckets = added.touched(first)
            known = state_log(spark, state_path).read(buckets).select("content_id")
            known = known.unionByName(added.read(buckets, skip=(run, number)).select("content_id"))
            added.add(register_first(first, known, as_of or datetime.now(UTC)).rows, run, number)
        finally:
            first.unpersist()
        # The refused rows are read back, so both tables tell the same story.
        refused = added.changes(run, number).filter("status = 'blocked'")
        refused = refused.select(
            F.col("added_at").alias("ts"),
            "url",
            F.coalesce("error", F.lit("validation failed")).alias("reason"),
        )
        write_batch(refused, attention_path, number, run)
        added.compact()

    return stream.writeStream.foreachBatch(register)


def clock(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of ``clock`` rows to union with attempts, so that backoffs end while nothing arrives."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return ticks.select(
        F.lit(None).cast("string").alias("content_id"),
        F.lit(None).cast("long").alias("attempt_id"),
        F.col("timestamp").alias("attempt_ts"),
        F.lit("clock").alias("kind"),
        F.lit(None).cast("boolean").alias("ok"),
        F.lit(None).cast("string").alias("error"),
    )


def _resumed(items: DataFrame) -> DataFrame:
    """Items as the failures in a row they stand for, before all attempts of a batch."""
    tries = F.when(F.col("attempt_count") > 0, F.sequence(F.lit(1), F.col("attempt_count")))
    each = items.select("content_id", "error", "due_at", "attempt_count", F.explode(tries).alias("i"))
    return each.select(
        "content_id",
        (F.col("i") - F.col("attempt_count") - 1).cast("long").alias("attempt_id"),
        F.lit(BEFORE_ALL).cast("timestamp").alias("attempt_ts"),
        F.lit("attempt").alias("kind"),
        F.lit(False).alias("ok"),
        "error",
        F.when(F.col("i") == F.col("attempt_count"), F.col("due_at")).alias("_due"),
        F.lit(True).alias("_old"),
    )


def follow_retries(
    attempts: DataFrame, items: DataFrame, until: str | None, policy: Policy, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """What attempts do to waiting items: (events, changed items).

    ``items`` are the earlier ones the attempts touch and all whose backoff ends by ``until``, the
    latest time seen (as text). A retry is an event when its backoff ends before the item's next attempt; one
    that still waits after the last attempt is an event once ``until`` has reached its end.
    """
    fresh = attempts.select(*ATTEMPT, F.lit(None).cast("timestamp").alias("_due"), F.lit(False).alias("_old"))
    rows = fresh.unionByName(_resumed(items.join(attempts.select("content_id").distinct(), "content_id", "left_semi")))
    replayed = replay_attempts(rows, policy, hot_rows)
    due = F.when(F.col("_old"), F.col("_due")).otherwise(F.col("next_retry_at"))
    failing = F.col("status").isin("failed", "failed_permanent")
    told = replayed.select(
        "content_id", "attempt_id", "attempt_ts", "_old", "status", due.alias("due_at"),
        F.when(failing, F.col("attempt_count")).otherwise(0).alias("attempt_count"), F.when(failing, F.col("error")).alias("error"),
    )
    facts = F.struct("due_at", "attempt_count", "error")
    ordered = order_rows(durable(told), ["content_id"], ["attempt_ts", "attempt_id"], hot_rows)
    walked = running(ordered, previous={"_before": facts}).rows()
    ended = walked.filter(F.col("_before.due_at") <= F.col("attempt_ts")).select("content_id", "_before.*")
    gave_up = walked.filter(~F.col("_old") & (F.col("status") == "failed_permanent")).select(
        "content_id", F.lit("gave_up").alias("event"), "attempt_count", F.col("attempt_ts").alias("at"), "error"
    )
    place = F.struct("attempt_ts", "attempt_id")
    last = ordered.rows().groupBy("content_id").agg(F.max_by(F.struct("attempt_count", "error", "due_at", "status"), place).alias("_l"))
    touched = last.select("content_id", "_l.attempt_count", "_l.error", "_l.due_at", (F.col("_l.status") == "failed_permanent").alias("gave_up"))
    others = items.join(attempts.select("content_id").distinct(), "content_id", "left_anti")
    after = touched.unionByName(others.select(*touched.columns))
    over = F.coalesce(F.col("due_at") <= F.lit(until).cast("timestamp"), F.lit(False))
    ended = ended.unionByName(after.filter(over).select(*ended.columns))
    retries = ended.select("content_id", F.lit("retry").alias("event"), "attempt_count", F.col("due_at").alias("at"), "error")
    return gave_up.unionByName(retries), after.withColumn("due_at", F.when(~over, F.col("due_at")))


def stream_retries(attempts: DataFrame, policy: Policy, folder: str, hot_rows: int = HOT_ROWS) -> DataStreamWriter:
    """Retry events of an attempt stream: an item again when its backoff ends, or given up.

    ``attempts`` is (content_id, attempt_id, attempt_ts, kind, ok, error); ``kind`` is 'attempt',
    'reset' or 'clock'. Time is what the rows say: the latest ``attempt_ts`` seen, so a log
    replayed in order gives the same events in one micro-batch or many; union ``clock`` rows where
    backoffs must end while nothing else arrives. What an item carries on is four values
    in a table under ``folder``, of which a batch opens the buckets of its own items, and the waiting
    items whose time has come. An item's rows are put in order by Spark, in chunks where one item owns
    very many, never in one frame. Events are under ``folder``/events, by run and batch.
    """

    def follow(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = query_id(spark)
        log, times = (KeyedLog(spark, f"{folder}/{n}", s, k) for n, s, k in (("items", ITEMS, "content_id"), ("clock", CLOCK, "name")))
        rows = batch.filter("kind <> 'clock'").select(*ATTEMPT)
        seen = times.read(skip=(run, number)).select("at").unionByName(batch.select(F.col("attempt_ts").alias("at")))
        latest = seen.agg(F.max("at").alias("at"), F.max("at").cast("string").alias("text")).first()
        earlier = log.read(skip=(run, number))
        touched = F.coalesce(log.bucket_of().isin(log.touched(rows)), F.lit(False))
        ends = F.col("due_at") <= F.lit(latest.text).cast("timestamp")
        items = durable(
            earlier.filter(touched).join(rows.select("content_id").distinct(), "content_id", "left_semi")
            .unionByName(earlier.filter(ends).join(rows.select("content_id").distinct(), "content_id", "left_anti"))
        )
        events, changed = follow_retries(rows, items, latest.text, policy, hot_rows)
        write_batch(events, f"{folder}/events", number, run)
        log.add(changed, run, number)
        times.add(spark.createDataFrame([("latest",)], "name STRING").withColumn("at", F.lit(latest.text).cast("timestamp")), run, number)
        log.compact()
        times.compact()

    return attempts.writeStream.foreachBatch(follow)


def drain(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a query over everything available now, then stop."""
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)


def health_changes(changes: DataFrame) -> DataFrame:
    """Health of all changes so far: every row takes its old status away and adds its new one.

    ``changes`` is (content_id, old_status, new_status, changed_at), see ``status_changes``. The last
    success is the latest one the feed has told of; sending the item back doesn't undo it.
    """
    sides = F.array(
        F.struct(F.col("old_status").alias("s"), F.lit(-1).cast("long").alias("w")),
        F.struct(F.col("new_status").alias("s"), F.lit(1).cast("long").alias("w")),
    )
    success = F.when(F.col("new_status") == "done", F.col("changed_at")).alias("success")
    each = changes.select(success, F.explode(sides).alias("e")).filter("e.s IS NOT NULL")

    def weight(counts) -> Column:
        return F.coalesce(F.sum(F.when(counts, F.col("e.w"))), F.lit(0))

    return each.agg(
        F.lit("ok").alias("status"),
        weight(~F.col("e.s").isin(*TERMINAL_STATUSES)).alias("queue_depth"),
        weight(F.col("e.s").isin(*FAILED_STATUSES)).alias("failed_count"),
        F.max("success").alias("last_success_at"),
    )


def stream_health(changes: DataFrame, out_path: str) -> DataStreamWriter:
    """Health after every micro-batch of a change feed, without reading the state table.

    The engine's own streaming aggregate keeps the counts; a batch costs what it brings.
    """

    def publish(batch: DataFrame, number: int) -> None:
        write_batch(batch, out_path, number, query_id(batch.sparkSession))

    return health_changes(changes).writeStream.outputMode("complete").foreachBatch(publish)
