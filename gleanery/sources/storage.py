"""The state table and batches of streams as plain Parquet folders."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.registry import last_per_key
from gleanery.schemas import STATE, conform_state, parse
from gleanery.sources.keyed_log import BUCKETS, KeyedLog


def state_log(spark: SparkSession, path: str, buckets: int = BUCKETS) -> KeyedLog:
    """The state table under a path: a base and the changes since, by ``content_id``."""
    return KeyedLog(spark, path, STATE, "content_id", buckets)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state as of the latest version; a missing table is an empty one."""
    return conform_state(state_log(spark, path).read())


def write_state(state: DataFrame, path: str) -> int:
    """Make these rows the whole table and return its new version.

    Readers see it once the manifest names it, so a lost writer leaves the old one.
    """
    return state_log(state.sparkSession, path).replace(conform_state(state))


def write_state_changes(
    changes: DataFrame, path: str, as_of: datetime, order: Column | None = None, run: str = "upsert", batch: int | None = None
) -> int:
    """Add changed rows to the state and return its new version; no other row is written again.

    Of several changes to a key the last by ``order`` counts (by default ``updated_at``); what
    changed is stamped. Reading gives what ``upsert_state`` of the table and the changes gives.
    A batch number that is given again replaces its rows.
    """
    log = state_log(changes.sparkSession, path)
    last = last_per_key(changes, F.col("updated_at") if order is None else order)
    stamped = conform_state(last.withColumn("updated_at", F.lit(as_of).cast("timestamp")))
    version = log.add(stamped, run, log.manifest()[0] + 1 if batch is None else batch)
    log.compact()
    return version


def read_state_json(spark: SparkSession, path: str, one_document: bool = True) -> DataFrame:
    """State kept as JSON documents {"items": {content_id: record}}.

    A file that is one document over many lines is one task's work, so that form is the
    import of a small table; documents of one line each are read in splits.
    """
    record = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in parse(STATE))
    reader = spark.read.schema(f"items MAP<STRING, STRUCT<{record}>>")
    try:
        document = reader.option("multiLine", one_document).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], parse(STATE))
        raise
    items = document.select(F.explode("items").alias("key", "record"))
    return conform_state(items.select("record.*"))


def export_state_json(state: DataFrame, path: str) -> None:
    """Write one document {"items": {content_id: record}} a line and item; read it with
    ``read_state_json(..., one_document=False)``."""
    item = F.map_from_arrays(F.array("content_id"), F.array(F.struct(*state.columns)))
    state.select(F.to_json(F.struct(item.alias("items"))).alias("value")).write.mode("overwrite").text(path)


def write_batch(rows: DataFrame, path: str, number: int, run: str = "none") -> str:
    """Write one numbered batch of a run and return its folder; doing it again replaces it."""
    folder = f"{path}/run={run}/batch={number}"
    rows.write.mode("overwrite").parquet(folder)
    return folder


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed batches, with ``run`` and ``batch``, or None when there are none.

    One scan of the folder tree: Spark lists it in parallel, and readers that name a run or batch
    open only its files.
    """
    try:
        found = spark.read.option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found
