"""As-of and band joins without gathering a key in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.skew import salted_join


def asof_backward(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, block_seconds: int = 86400 * 7) -> DataFrame:
    """``left`` with the value of the last ``right`` row of the same key strictly before it, NULL if there is none.

    A key's rows are cut into blocks of time; within a block a window finds the last value, across blocks the last value of
    each block is carried on (one row per block), so a key with a third of all rows is never sorted in one task. Rows of
    ``right`` at the very time of a left row do not count; NULL keys and times find nothing; equal times: largest value.
    """
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    a = left.select("*", F.lit(0).alias("side"), F.lit(None).cast(right.schema[value].dataType).alias("found"))
    b = right.select(F.col(key), F.col(ts), F.lit(1).alias("side"), F.col(value).alias("found"))
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("block", F.floor(seconds / block_seconds))
    within = Window.partitionBy(key, "block").orderBy(ts, "side", "found").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last("found", ignorenulls=True).over(within))
    ends = b.withColumn("block", F.floor(seconds / block_seconds)).groupBy(key, "block").agg(F.max_by("found", F.struct(F.col(ts), F.col("found"))).alias("end"))
    have = rows.select(key, "block").distinct().join(ends, [key, "block"], "left")
    carried = have.withColumn("before", F.last("end", ignorenulls=True).over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("end")
    return rows.where("side = 0").join(carried, [key, "block"], "left").withColumn(value, F.coalesce("near", "before")).drop("side", "found", "near", "before", "block")


def band_width(pct: float) -> float:
    """Width of log-price buckets such that a price within ``pct`` percent of a target is in its bucket or a neighbour."""
    return -math.log(1 - pct / 100)


def band_join(targets: DataFrame, items: DataFrame, keys: list[str], prices: list[tuple[str, str]], pct: float) -> DataFrame:
    """Pairs of equal keys of which each item price lies within ``pct`` percent of the target's, bounds included.

    ``prices``: (target column, item column) each. An equi-join on the log-price buckets of up to three of them, each target
    standing in its own and the neighbouring ones; then the exact bands. Hot buckets are spread (``skew``). Missing and
    non-positive prices match nothing.
    """
    width = band_width(pct)
    buckets = [f"bucket_{i}" for i in range(min(len(prices), 3))]

    def bucket(p: str) -> Column:
        return F.floor(F.ln(F.col(p)) / width)

    t = targets.where(" and ".join(f"{a} > 0" for a, _ in prices))
    i = items.where(" and ".join(f"{b} > 0" for _, b in prices))
    for name, (a, b) in zip(buckets, prices, strict=False):
        t = t.withColumn(name, F.explode(F.array(*[bucket(a) + d for d in (-1, 0, 1)])))
        i = i.withColumn(name, bucket(b))
    met = salted_join(i, t, [*keys, *buckets])
    for a, b in prices:
        met = met.where(F.abs(F.col(b) - F.col(a)) <= F.col(a) * F.lit(pct / 100))
    return met.drop(*buckets)


def hamming_one(left: DataFrame, right: DataFrame, left_code: str, right_code: str) -> DataFrame:
    """Pairs of codes of equal length that differ in at most one place: an equi-join on (place, code without that place)."""

    def holes(df: DataFrame, code: str) -> DataFrame:
        n = F.length(code)
        at = F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
        df = df.withColumn("hole", at)
        return df.withColumn("around", F.concat(F.substring(code, F.lit(1), F.col("hole") - 1), F.lit("?"), F.substring(code, F.col("hole") + 1, F.length(code))))

    return holes(left, left_code).join(holes(right, right_code), ["hole", "around"]).drop("hole", "around").distinct()
