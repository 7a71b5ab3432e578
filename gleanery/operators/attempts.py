"""Attempt logs: retry replay, attention lines and call spacing as ordered scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators.ordered import HOT_ROWS, order_rows, running
from gleanery.policy import Policy


def backoff_until(start: Column, attempts: Column, policy: Policy) -> Column:
    """Time of the next try after the given number of failures in a row."""
    schedule = F.array(*(F.lit(m) for m in policy.backoff_minutes))
    minutes = F.element_at(schedule, F.least(attempts.cast("int"), F.lit(len(policy.backoff_minutes))))
    return start + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def replay_attempts(attempts: DataFrame, policy: Policy, hot_rows: int = HOT_ROWS) -> DataFrame:
    """State after every attempt of a log (content_id, attempt_ts, attempt_id, kind, ok, error).

    ``kind`` is 'attempt' or 'reset' (a manual retry). Rows logged after an item became
    permanent and before its next reset never ran, so they are left out. Adds
    ``attempt_count, status, next_retry_at, previous_error``.
    """
    reset = F.col("kind") == "reset"
    failure = ~reset & ~F.col("ok")
    marked = attempts.withColumns({"_reset": reset, "_fail": failure})
    rows = order_rows(marked, ["content_id"], ["attempt_ts", "attempt_id"], hot_rows)
    one = {n: F.when(F.col(n), 1).otherwise(0) for n in ("_fail", "_reset")}
    rows = running(
        rows,
        sums={"_fails": one["_fail"], "_life": one["_reset"]},
        previous={"previous_error": F.when(F.col("_fail"), F.col("error"))},
    )
    # Failures in a row: failures so far less those up to the last success or reset.
    rows = running(rows, maxs={"_settled": F.when(~F.col("_fail"), F.col("_fails"))})
    streak = F.col("_fails") - F.coalesce(F.col("_settled"), F.lit(0))
    gave_up = F.col("_fail") & (streak >= policy.max_attempts)
    rows = running(rows, maxs_before={"_dead_life": F.when(gave_up, F.col("_life"))})
    alive = F.coalesce(F.col("_dead_life") < F.col("_life"), F.lit(True))
    status = (
        F.when(F.col("_reset"), "pending")
        .when(~F.col("_fail"), "done")
        .when(gave_up, "failed_permanent")
        .otherwise("failed")
    )
    return (
        rows.rows()
        .filter(alive)
        .withColumns(
            {
                "attempt_count": streak.cast("int"),
                "status": status,
                "next_retry_at": F.when(
                    F.col("_fail") & ~gave_up, backoff_until(F.col("attempt_ts"), streak, policy)
                ),
            }
        )
        .drop("_fail", "_reset", "_fails", "_life", "_settled", "_dead_life")
    )


def failure_reason(status: Column, attempts: Column, error: Column) -> Column:
    """Attention text of one failure."""
    gone = F.concat(
        F.lit("giving up after "),
        attempts.cast("string"),
        F.lit(" attempts (permanent failure): "),
        error,
    )
    return F.when(status == "failed_permanent", gone).otherwise(
        F.concat(F.lit("processing failed: "), error)
    )


def attention_events(replayed: DataFrame) -> DataFrame:
    """Attention rows of a replayed log: on a new error text, and always when giving up."""
    permanent = F.col("status") == "failed_permanent"
    changed = (F.col("status") == "failed") & ~F.col("error").eqNullSafe(F.col("previous_error"))
    return replayed.filter(permanent | changed).select(
        "content_id",
        "attempt_id",
        F.col("attempt_ts").alias("ts"),
        failure_reason(F.col("status"), F.col("attempt_count"), F.col("error")).alias("reason"),
    )


def throttle_schedule(calls: DataFrame, policy: Policy, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Start of each call when starts of one provider keep their minimum distance.

    ``calls`` is (call_id, provider, arrived_at). With distance d and calls numbered i in
    arrival order, start_i = max over j <= i of (arrival_j - j*d) + i*d. Whole microseconds
    keep it exact. A provider easily owns most calls, hence the chunked scan.
    """
    spacing = {p: round(s * 1_000_000) for p, s in policy.call_intervals.items() if s > 0}
    gap = F.lit(0).cast("long")
    for provider, micros in spacing.items():
        gap = F.when(F.col("provider") == provider, F.lit(micros).cast("long")).otherwise(gap)
    timed = calls.withColumns({"_gap": gap, "_at": F.unix_micros("arrived_at")})
    rows = order_rows(timed, ["provider"], ["arrived_at", "call_id"], hot_rows)
    rows = running(rows, sums={"_nth": F.lit(1)})
    rows = running(rows, maxs={"_free": F.col("_at") - F.col("_nth") * F.col("_gap")})
    start = F.when(F.col("_gap") > 0, F.col("_free") + F.col("_nth") * F.col("_gap")).otherwise(F.col("_at"))
    return (
        rows.rows()
        .withColumn("start_us", start)
        .withColumn("wait_us", F.col("start_us") - F.col("_at"))
        .withColumn("starts_at", F.timestamp_micros("start_us"))
        .drop("_gap", "_at", "_nth", "_free")
    )
