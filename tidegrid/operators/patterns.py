"""Outcome patterns of codes: statistics, rankings, libraries, fusion and cluster profiles, and positions within groups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.odds import ratio

C = F.col



def purest() -> list[Column]:
    """Order of the purest patterns first."""
    return [C("purity").desc(), C("total").desc(), C("pattern")]


def dominant(home: str = "home", draw: str = "draw", away: str = "away") -> Column:
    """The most frequent outcome; of equal ones home before draw before away."""
    return F.when((C(home) >= C(draw)) & (C(home) >= C(away)), "home").when(C(draw) >= C(away), "draw").otherwise("away")


def pattern_stats(rows: DataFrame, keys: list[str], pattern: str, outcome: str, support: int, purity: float) -> DataFrame:
    """Per key and pattern: total, home, draw, away, purity and dominant outcome, for those with support and purity enough."""
    counted = rows.groupBy(*keys, C(pattern).alias("pattern")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(C(outcome) == o).alias(o) for o in ("home", "draw", "away")]).where(C("total") >= support)
    return counted.withColumn("purity", F.greatest("home", "draw", "away") / C("total")).withColumn("dominant", dominant()).where(C("purity") >= purity)


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``r``: the place in ``order`` within the keys. Spark keeps only a group's first rows before it shuffles if r is limited."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def strategy_summary(stats: DataFrame, keys: list[str], top: int = 20, pure: float = 0.7) -> DataFrame:
    """Of the supported patterns: their number and rows, mean purity and coverage of the ``top`` purest, number and coverage of pure ones."""
    first = C("r") <= top
    s = ranked(stats, keys, purest()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_patterns"), F.sum("total").alias("supported"), F.avg(F.when(first, C("purity"))).alias("top_purity"), F.sum(F.when(first, C("total")).otherwise(0)).alias("top_total"),
        F.count_if(C("purity") >= pure).alias("n_pure"), F.sum(F.when(C("purity") >= pure, C("total")).otherwise(0)).alias("pure_total"),
    )
    return s.withColumn("top_coverage", ratio(C("top_total"), C("supported"))).withColumn("pure_coverage", ratio(C("pure_total"), C("supported")))


def best_strategy(summary: DataFrame, strategy: str) -> DataFrame:
    """The strategy with the highest mean purity x coverage x log(1 + number of pure patterns); of equal ones the smallest."""
    score = C("top_purity") * C("top_coverage") * F.log1p("n_pure")
    judged = summary.select(strategy, F.round(score, 6).alias("score"))
    return judged.orderBy(C("score").desc(), strategy).limit(1)


def two_levels(rows: DataFrame, keys: list[str], coarse: str, fine: str, outcome: str, support: int, pure: float, fine_purity: float) -> DataFrame:
    """Pure coarse patterns, and fine patterns of the rows whose coarse pattern has support but is not pure."""
    top = pattern_stats(rows, keys, coarse, outcome, support, 0.0)
    mixed = top.where(C("purity") < pure).select(*keys, C("pattern").alias(coarse))
    below = pattern_stats(rows.join(mixed, [*keys, coarse], "left_semi"), keys, fine, outcome, support, fine_purity)
    return top.where(C("purity") >= pure).withColumn("level", F.lit("coarse")).unionByName(below.withColumn("level", F.lit("fine")))


def fusion(a: DataFrame, b: DataFrame, key: str, says: str, outcome: str) -> DataFrame:
    """What two libraries say of the matches both have: per kind of agreement the matches and the right predictions."""
    both = a.select(key, C(outcome).alias("truth"), C(says).alias("pa")).join(b.select(key, C(says).alias("pb")), key)
    kind = F.when(C("pa").isNull() & C("pb").isNull(), "both_low").when(C("pa").isNull() | C("pb").isNull(), "single_high").when(C("pa") == C("pb"), "both_high").otherwise("disagree")
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("pa", "pb") == C("truth")).alias("right_ones"))


def cluster_profile(rows: DataFrame, cluster: list[str], code: str, prices: list[str], prefix: int = 8, top: int = 5) -> DataFrame:
    """Per cluster: size, its ``top`` most frequent prefixes (``prefix:count``; of equal ones the first in order) and the mean of each price that is not 0."""
    sizes = rows.groupBy(*cluster).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.nullif(C(p).cast("double"), F.lit(0.0))), 9).alias(f"mean_{p}") for p in prices])
    heads = rows.groupBy(*cluster, F.substring(code, 1, prefix).alias("head")).agg(F.count(F.lit(1)).alias("k"))
    best = ranked(heads, cluster, [C("k").desc(), C("head")]).where(C("r") <= top)
    named = best.groupBy(*cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "head", "k"))), lambda x: F.concat(x["head"], F.lit(":"), x["k"].cast("string"))), " ").alias("prefixes"))
    return sizes.join(named, cluster)


def prefix_rates(rows: DataFrame, code: str, outcome: str, prefix: int = 8, least: int = 10) -> DataFrame:
    """Outcome rates of prefixes with ``least`` rows; all rows count, also those without a result."""
    t = rows.groupBy(F.substring(code, 1, prefix).alias("prefix")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(C(outcome) == o).alias(o) for o in ("home", "draw", "away")]).where(C("total") >= least)
    return t.select("prefix", "total", *[F.round(C(o) / C("total"), 6).alias(a) for o, a in (("home", "win_rate"), ("draw", "draw_rate"), ("away", "loss_rate"))])


def length_percentiles(lengths: DataFrame, keys: list[str], n: str) -> DataFrame:
    """25th, 50th, 75th and 90th percentile (linear), mean and longest. Lengths are counted first: there are few different ones."""
    counted = lengths.where(C(n).isNotNull()).groupBy(*keys, n).agg(F.count(F.lit(1)).alias("times"))
    p = F.percentile(n, F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.9)]), C("times"))
    got = counted.groupBy(*keys).agg(p.alias("p"), (F.sum(C(n) * C("times")) / F.sum("times")).alias("mean"), F.max(n).alias("longest"))
    return got.select(*keys, *[F.get("p", F.lit(i)).alias(a) for i, a in enumerate(("p25", "p50", "p75", "p90"))], "mean", "longest")


def recommended(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Word size by the median length (6 under 15, 10 over 30, else 8), alphabet 4, resampled length at least 32."""
    word = F.when(C("p50") < 15, 6).when(C("p50") > 30, 10).otherwise(8)
    return lengths.select(*keys, word.alias("word_size"), F.lit(4).alias("alphabet_size"), F.floor(F.greatest(F.lit(32.0), C("p90"))).cast("bigint").alias("interpolate_len"))


_BLOCK = 1 << 14


def _blocks(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("block", F.floor(C(order) / _BLOCK))


def position(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``position`` (from 0) of each row by a whole-number ``order`` within its keys, NULL keys being a group.

    Counted within blocks of the order's values, plus the rows of the blocks before (one row per block), so that no group is
    sorted in one task.
    """
    rows = _blocks(rows, keys, order)
    sizes = rows.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy(*keys, "block").orderBy(order)))
    met = own.alias("o").join(before.alias("b"), [C(f"o.{k}").eqNullSafe(C(f"b.{k}")) for k in [*keys, "block"]])
    return met.select("o.*", (C("own") - 1 + C("before")).alias("position")).drop("own", "block")


def previous(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``previous``: the value of the row before by ``order`` within the keys, also across the blocks that ``position`` uses."""
    rows = _blocks(rows, keys, order)
    ends = rows.groupBy(*keys, "block").agg(F.max_by(F.struct(C(value).alias("v")), order).alias("end"))
    ahead = ends.withColumn("carried", F.lag("end").over(Window.partitionBy(*keys).orderBy("block"))).drop("end")
    own = rows.withColumn("own", F.lag(F.struct(C(value).alias("v"))).over(Window.partitionBy(*keys, "block").orderBy(order)))
    met = own.alias("o").join(ahead.alias("b"), [C(f"o.{k}").eqNullSafe(C(f"b.{k}")) for k in [*keys, "block"]])
    return met.select("o.*", F.coalesce("own", "carried")["v"].alias("previous")).drop("own", "block")


_EQUAL, _BETWEEN, _ORDER = r"\b{0}\s*=\s*('[^']*'|[\d.]+)", r"\b{0}\s+between\s+([\d.]+)\s+and\s+([\d.]+)", r"\border\s+by\s+(\w+)(?:\s+(desc|asc))?"


def typed_query(df: DataFrame, text: str, columns: list[str], tie: str, limit: int, key: str = "bookmaker_name") -> DataFrame:
    """The filters (equality of ``key`` and of ``columns``, ranges of ``columns``) and the order that a typed query names.

    Values are literals, columns are known ones: nothing of the text is evaluated. The limit is the feature of the listing.
    """
    if m := re.search(_EQUAL.format(key), text, re.I):
        df = df.where(C(key) == m[1].strip("'"))
    for c in columns:
        if m := re.search(_BETWEEN.format(c), text, re.I):
            df = df.where(C(c).between(F.lit(m[1]).cast(df.schema[c].dataType), F.lit(m[2]).cast(df.schema[c].dataType)))
        elif m := re.search(_EQUAL.format(c), text, re.I):
            df = df.where(C(c) == F.lit(m[1].strip("'")).cast(df.schema[c].dataType))
    m = re.search(_ORDER, text, re.I)
    order = [C(m[1]).desc() if (m[2] or "").lower() == "desc" else C(m[1])] if m and m[1] in df.columns else []
    return df.orderBy(*order, tie).limit(limit)
