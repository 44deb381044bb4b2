"""Distances between words within a bound, and density clusters (DBSCAN) over them, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.series import cost_table, mindist
from tidegrid.operators.components import linked
from tidegrid.operators.skew import salted_join
from tidegrid.session import written


def near_words(words: DataFrame, word: int, k: int, eps: float, variant: str = "cluster") -> DataFrame:
    """(a, b, dist) of the different words of ``words`` (distinct, ``word`` letters of an alphabet of ``k``) within ``eps``, a < b.

    A place whose letters are equal or neighbours is cheap; any other costs at least the table's least dear entry, so only
    ``most`` places can be dear, and of ``most`` + 1 segments one has cheap places only. Words meet by that segment, one side
    with each letter also as its neighbours. Bounds so wide that all places could be dear are refused.
    """
    costs = cost_table(k, variant)
    dear = min(c for i, c in enumerate(costs) if abs(i // k - i % k) > 1)
    most = int(eps * eps * word / dear + 1e-9)
    if most >= word:
        raise ValueError(f"within {eps} every two words of {word} letters may be near; no candidate can be left out")
    parts = most + 1
    cuts = [word * i // parts for i in range(parts + 1)]

    def letter(i: int) -> Column:
        return F.ascii(F.substring("w", i + 1, 1)) - 97

    def keys(spread: bool) -> Column:
        out = []
        for p in range(parts):
            made = F.array(F.lit(f"{p}:"))
            for i in range(cuts[p], cuts[p + 1]):
                here = F.array(*[letter(i) + d for d in ((-1, 0, 1) if spread else (0,))])
                made = F.flatten(F.transform(made, _extend(here)))
            out.append(made)
        return F.explode(F.flatten(F.array(*out))).alias("key")

    left = words.select(F.col("w").alias("a"), keys(True))
    right = words.select(F.col("w").alias("b"), keys(False))
    met = salted_join(right, left, ["key"]).where("a < b").select("a", "b").distinct()
    return met.withColumn("dist", mindist(F.col("a"), F.col("b"), word, k, variant)).where(F.col("dist") <= eps)


def _extend(here: Column):
    return lambda s: F.transform(here, lambda x: F.concat(s, x.cast("string"), F.lit(",")))


def dbscan(rows: DataFrame, row_id: str, code: str, word: int, k: int, eps: float, least: int) -> DataFrame:
    """(id, cluster) by density over the words' cluster distance: -1 for noise; a cluster is named by its smallest core word's
    place in order. A row is core if ``least`` rows, itself among them, lie within ``eps``; others join the nearest core word's
    cluster (ties: the first word). Equal words are one node with a weight. NULL and shorter words are noise.
    """
    words = written(rows.where(F.length(code) >= word).groupBy(F.substring(code, 1, word).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("node")), "words")
    near = written(near_words(words, word, k, eps), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    weight = both.join(words.select(F.col("w").alias("b"), "n"), "b").groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("others"))
    core = written(words.join(weight, "w", "left").where(F.col("n") + F.coalesce("others", F.lit(0)) >= least).select("w", "node"), "core")
    ca, cb = core.select(F.col("w").alias("a"), F.col("node").alias("na")), core.select(F.col("w").alias("b"), F.col("node").alias("nb"))
    label = linked(near.join(ca, "a").join(cb, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), F.col("dist").alias("away")))
    own = core.join(label, "node", "left").select("w", F.coalesce("cluster", "node").alias("cluster"))
    border = both.join(own.select(F.col("w").alias("b"), "cluster"), "b").join(core.select(F.col("w").alias("a")), "a", "left_anti").groupBy(F.col("a").alias("w")).agg(F.min_by("cluster", F.struct("dist", "b")).alias("cluster"))
    return rows.select(F.col(row_id).alias("id"), F.substring(code, 1, word).alias("w")).join(own.unionByName(border), "w", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
