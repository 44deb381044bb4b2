"""Joining rows to one row per key when a key may hold a third of all rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: A key is hot above this share of the rows; so there are at most 1 / HOT_SHARE hot keys, which bounds what is broadcast.
HOT_SHARE = 0.01


def hot_keys(rows: DataFrame, keys: list[str], share: float = HOT_SHARE) -> list[tuple]:
    """The keys that hold at least ``share`` of the rows: at most ``1 / share``. One job, counted over all rows, map-side first."""
    seen = Observation()
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("rows"))
    # no more than 1 / share keys can hold such a share, so they are among the most frequent ones
    top = counts.orderBy(F.desc("n")).limit(math.ceil(1 / share)).collect()
    total = seen.get["rows"] or 0 if top else 0
    return [tuple(r[k] for k in keys) for r in top if r["n"] >= total * share]


def join_unique(rows: DataFrame, unique: DataFrame, keys: list[str], how: str = "left", share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined to ``unique``, which has one row per key (``how``: left, inner or left_anti).

    Rows of hot keys meet a broadcast of at most ``1 / share`` rows and are not shuffled; the rest is shuffled by key.
    NULL keys match nothing.
    """
    hot = hot_keys(rows, keys, share)
    if not hot:
        return rows.join(unique, keys, how)

    def one(key: tuple) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, key, strict=True)])

    is_hot = reduce(lambda a, b: a | b, [one(h) for h in hot])
    few = unique.where(is_hot)
    return rows.where(~is_hot).join(unique.where(~is_hot), keys, how).unionByName(rows.where(is_hot).join(F.broadcast(few), keys, how))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], salts: int = 16, share: float = HOT_SHARE) -> DataFrame:
    """Inner equi-join in which a hot key of ``many`` is spread over ``salts`` tasks, where the rows of ``few`` are repeated.

    Rows of ``many`` are spread by a hash of all their columns. NULL keys match nothing.
    """
    hot = hot_keys(many, keys, share)
    if not hot:
        return many.join(few, keys)
    is_hot = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(keys, key, strict=True)]) for key in hot])
    left = many.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(*many.columns), F.lit(salts))).otherwise(0).cast("int"))
    right = few.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "salt"]).drop("salt")
