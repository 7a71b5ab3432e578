"""Retry replay and call spacing against row-by-row simulations."""

import random
from datetime import datetime, timedelta

import pytest

from gleanery.operators import attempts
from gleanery.policy import Policy

START = datetime(2026, 1, 1)


def log(n=600):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        item = "hot" if i % 3 else f"item-{i % 7}"
        kind = "reset" if rng.random() < 0.1 else "attempt"
        ok = kind == "attempt" and rng.random() < 0.3
        error = None if ok or kind == "reset" else f"e{rng.randint(0, 1)}"
        rows.append((item, i, START + timedelta(seconds=i), kind, ok, error))
    return rows


def simulate(rows, policy):
    out, told, items = [], [], {}
    for item, i, ts, kind, ok, error in rows:
        count, dead, last = items.get(item, (0, False, None))
        if kind == "reset":
            items[item] = (0, False, None)
            out.append((item, i, "pending", 0, None))
            continue
        if dead:
            continue
        if ok:
            items[item] = (0, False, None)
            out.append((item, i, "done", 0, None))
            continue
        count += 1
        dead = count >= policy.max_attempts
        minutes = policy.backoff_minutes[min(count, len(policy.backoff_minutes)) - 1]
        status = "failed_permanent" if dead else "failed"
        out.append((item, i, status, count, None if dead else ts + timedelta(minutes=minutes)))
        if dead:
            told.append((item, i, f"giving up after {count} attempts (permanent failure): {error}"))
        elif error != last:
            told.append((item, i, f"processing failed: {error}"))
        items[item] = (count, dead, error)
    return out, told


@pytest.mark.parametrize("hot_rows", [10_000, 25])
@pytest.mark.parametrize("max_attempts", [2, 4])
def test_replay(spark, hot_rows, max_attempts):
    policy = Policy(max_attempts=max_attempts, backoff_minutes=(1, 5))
    rows = log()
    df = spark.createDataFrame(
        rows, "content_id STRING, attempt_id LONG, attempt_ts TIMESTAMP, kind STRING, ok BOOLEAN, error STRING"
    ).repartition(4)
    replayed = attempts.replay_attempts(df, policy, hot_rows)
    want, told = simulate(rows, policy)
    got = replayed.select("content_id", "attempt_id", "status", "attempt_count", "next_retry_at").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])
    lines = attempts.attention_events(replayed).select("content_id", "attempt_id", "reason").collect()
    assert sorted(map(tuple, lines)) == sorted(told)


@pytest.mark.parametrize("hot_rows", [10_000, 25])
def test_throttle(spark, hot_rows):
    rng = random.Random(9)
    policy = Policy(call_intervals={"a": 1.5, "b": 0.0})
    at, rows = START, []
    for i in range(300):
        at += timedelta(milliseconds=rng.randint(0, 2000))
        rows.append((i, rng.choice("aaab"), at))
    df = spark.createDataFrame(rows, "call_id LONG, provider STRING, arrived_at TIMESTAMP")
    got = {r.call_id: r.wait_us for r in attempts.throttle_schedule(df, policy, hot_rows).collect()}
    last, want = {}, {}
    for i, provider, arrived in rows:
        gap = timedelta(seconds=policy.call_intervals[provider])
        start = max(arrived, last[provider] + gap) if provider in last and gap else arrived
        last[provider] = start
        want[i] = (start - arrived) // timedelta(microseconds=1)
    assert got == want
