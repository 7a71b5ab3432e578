"""Cutting lineage so that a lost executor never changes a result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, or a private one on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can read")
    return tempfile.mkdtemp(prefix="gleanery-")


def durable(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet into the shared folder and go on from there.

    Readers get column pruning and sizes, and a plan that knows nothing of what came before: kept
    facts about earlier columns would make the plans of loops grow with every round.
    """
    path = f"{shared_dir(df.sparkSession)}/gleanery/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
