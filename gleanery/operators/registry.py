"""Registering submissions against the state table, and changing that table set-wise."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import iso_utc
from gleanery.operators.lookup import lookup
from gleanery.operators.once import computed_once
from gleanery.operators.urls import judge_urls
from gleanery.policy import REFUSED_STATUSES, TERMINAL_STATUSES, Policy
from gleanery.schemas import STATE, parse


@dataclass(frozen=True)
class Registration:
    """Rows to add to the state, and the attention lines that go with the refused ones."""

    rows: DataFrame
    attention: DataFrame


def screen_submissions(
    submissions: DataFrame, policy: Policy, probes: DataFrame | None = None
) -> DataFrame:
    """Verdict, kind and state key of every submission.

    The key is the content id, or the URL itself when it is malformed.
    """
    judged = judge_urls(submissions, policy, probes)
    as_text = ~F.col("ok") & ~F.col("blocked") & F.coalesce(F.col("kind") == "text", F.lit(False))
    return computed_once(
        judged,
        {
            "accepted": F.col("ok") | as_text,
            "content_id": F.when(F.col("content_id") != "", F.col("content_id")).otherwise(F.col("url")),
            "content_kind": F.when(F.col("ok") | as_text, F.coalesce("kind", F.lit("media"))).otherwise("media"),
        },
    )


def first_submission(submissions: DataFrame) -> DataFrame:
    """The earliest row per content id (``submitted_at``, then ``seq``).

    An aggregate rather than a window: copies of a hot URL collapse before the shuffle.
    """
    rest = [c for c in submissions.columns if c != "content_id"]
    first = F.min_by(F.struct(*rest), F.struct("submitted_at", "seq")).alias("_first")
    return submissions.groupBy("content_id").agg(first).select("content_id", "_first.*")


def register_urls(
    submissions: DataFrame,
    state: DataFrame,
    policy: Policy,
    as_of: datetime,
    probes: DataFrame | None = None,
) -> Registration:
    """New state rows for keys the state does not hold yet. Running it again adds nothing."""
    return register_first(first_submission(screen_submissions(submissions, policy, probes)), state, as_of)


def register_first(first: DataFrame, state: DataFrame, as_of: datetime) -> Registration:
    """``register_urls`` of submissions that are screened already, one per key."""
    fresh = first.join(state.select("content_id"), "content_id", "left_anti")
    now = F.lit(as_of).cast("timestamp")
    known = {
        "status": F.when(F.col("accepted"), "pending").otherwise("blocked"),
        "added_at": now,
        "updated_at": now,
        "error": F.when(~F.col("accepted"), F.col("reason")),
        "attempt_count": F.lit(0),
    }
    rows = fresh.select(
        *(
            known.get(f.name, F.col(f.name) if f.name in fresh.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in parse(STATE)
        )
    )
    attention = fresh.filter(~F.col("accepted")).select(
        now.alias("ts"), "url", F.coalesce("reason", F.lit("validation failed")).alias("reason")
    )
    return Registration(rows, attention)


def resolve_submissions(
    submissions: DataFrame,
    state: DataFrame,
    policy: Policy,
    probes: DataFrame | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Every submission with the state row it maps to, new or old."""
    keyed = screen_submissions(submissions, policy, probes).select(
        "seq", F.col("url").alias("submitted_url"), "content_id"
    )
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    return lookup(keyed, state, ["content_id"], ["seq"], **options)


def newly_registered(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` whose key ``before`` does not have."""
    return after.join(before.select("content_id"), "content_id", "left_anti")


def last_per_key(changes: DataFrame, order: Column | None = None, key: str = "content_id") -> DataFrame:
    """The row of each key that comes last by ``order``; rows that still tie go by their content."""
    rest = [c for c in changes.columns if c != key]
    place = F.to_json(F.struct(*rest)) if order is None else F.struct(order, F.to_json(F.struct(*rest)))
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_last"))
    return last.select(key, "_last.*")


def upsert_state(
    state: DataFrame, changes: DataFrame, as_of: datetime, order: Column | None = None
) -> DataFrame:
    """Replace rows by key, add unknown keys, stamp what changed.

    Of several changes to a key the last by ``order`` counts (by default the column
    ``updated_at``). An anti join keeps the untouched rows, so a small change set is broadcast
    by Spark's own size check and the state itself is not shuffled.
    """
    last = last_per_key(changes, F.col("updated_at") if order is None else order)
    kept = state.join(last.select("content_id"), "content_id", "left_anti")
    stamped = last.withColumn("updated_at", F.lit(as_of).cast("timestamp"))
    return kept.unionByName(stamped.select(*state.columns))


def update_state_where(
    state: DataFrame, where: Column, assign: dict[str, Column], as_of: datetime | None = None
) -> DataFrame:
    """Set columns on the rows a condition selects; one pass, no shuffle."""
    hit = F.coalesce(where, F.lit(False))
    if as_of is not None:
        assign = {**assign, "updated_at": F.lit(as_of).cast("timestamp")}
    return state.withColumns({n: F.when(hit, c).otherwise(F.col(n)) for n, c in assign.items()})


def submission_responses(resolved: DataFrame, as_of: datetime) -> DataFrame:
    """Answer per submission: accepted, whether a run would do anything, and why not."""
    now = F.lit(as_of).cast("timestamp")
    waiting = (F.col("status") == "failed") & F.coalesce(F.col("next_retry_at") > now, F.lit(False))
    backoff = F.concat(
        F.lit("still waiting on retry backoff until "),
        iso_utc(F.col("next_retry_at")),
        F.lit(" (last error: "),
        F.coalesce("error", F.lit("None")),
        F.lit(")"),
    )
    return resolved.select(
        "seq",
        "content_id",
        "status",
        (~F.col("status").isin(*REFUSED_STATUSES)).alias("accepted"),
        (~F.col("status").isin(*TERMINAL_STATUSES) & ~waiting).alias("should_run"),
        F.when(waiting, backoff).otherwise(F.col("error")).alias("reason"),
    )
