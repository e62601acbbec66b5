"""Keyed table edits as set operations; keys are unique in their table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it doesn't have."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of ``table`` whose key they don't have."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def overlay_merge(base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """Entries of both; the overlay's wins."""
    value = next(c for c in base.columns if c != key)
    over = overlay.select(key, F.col(value).alias("__over"))
    return base.join(over, key, "full").select(key, F.coalesce("__over", value).alias(value))
