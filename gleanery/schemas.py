"""Declared schemas of the engine's tables, and conforming older rows to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUBMISSIONS = "seq LONG, url STRING, source STRING, submitted_at TIMESTAMP"
STATE = (
    "content_id STRING, url STRING, normalized_url STRING, source STRING, status STRING, "
    "content_kind STRING, added_at TIMESTAMP, updated_at TIMESTAMP, error STRING, "
    "note_path STRING, skill_path STRING, attempt_count INT, next_retry_at TIMESTAMP, "
    "last_completed_stage STRING, skill_error STRING"
)
ATTENTION = "ts TIMESTAMP, url STRING, reason STRING, line STRING"
ENRICHMENT = (
    "title STRING, summary STRING, tags ARRAY<STRING>, tools_mentioned ARRAY<STRING>, "
    "key_takeaways ARRAY<STRING>, high_signal BOOLEAN, skill_candidate_reason STRING"
)
CAPTURE = (
    "content_id STRING, text STRING, content_kind STRING, language STRING, backend STRING, "
    "duration_seconds DOUBLE"
)
LOGS = (
    "timestamp TIMESTAMP, level STRING, logger STRING, message STRING, "
    "context MAP<STRING, STRING>, exc_info STRING"
)

STATE_DEFAULTS = {"content_kind": "media", "attempt_count": 0}


def parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform_state(df: DataFrame) -> DataFrame:
    """Bring rows written by any earlier version to the current state columns."""
    present = set(df.columns)
    columns = []
    for f in parse(STATE):
        value = F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)
        if f.name in STATE_DEFAULTS:
            value = F.coalesce(value, F.lit(STATE_DEFAULTS[f.name]))
        columns.append(value.alias(f.name))
    return df.select(*columns)
