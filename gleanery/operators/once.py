"""Columns that are expensive to compute and read by several later steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and projections read but do not recompute.

    Spark copies a column's expression into every filter above it, which repeats a chain of
    pattern replacements many times over. A one-row generator is a step it does not copy
    through; it stays inside the generated code and adds no shuffle.
    """
    row = F.struct(*(c.alias(n) for n, c in columns.items()))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
