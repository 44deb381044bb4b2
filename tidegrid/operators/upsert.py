"""Upserts without MERGE: the result of writing new rows over, or beside, existing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``. Ranked by the group limit Spark applies before the shuffle."""
    return rows.withColumn("rank_in_key", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rank_in_key = 1").drop("rank_in_key")


def overwrite(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows (the last per key) replace existing ones of their key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(keep_last(new, keys, order))


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows (the last per key) are added where their key does not exist."""
    return existing.unionByName(keep_last(new.join(existing.select(*keys).distinct(), keys, "left_anti"), keys, order))
