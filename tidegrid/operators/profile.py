"""Distribution profile of a numeric column: moments, normality, equal-frequency entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.skew import join_unique
from tidegrid.session import written


def normality(n: Column, skew: Column, excess: Column) -> Column:
    """p-value of the D'Agostino-Pearson K-squared test from the count and population moments; NULL under 8 values."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    d, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    z1 = d * F.ln(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    e = 3 * (n - 1) / (n + 1)
    v = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3 - e) / F.sqrt(v)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    q = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - F.signum(q) * F.pow(F.abs(q), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, F.exp(-(z1 * z1 + z2 * z2) / 2))


def moments(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Count, mean, deviation, skewness, excess kurtosis (population) and the p-value of normality per key."""
    m = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("dev"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("excess"))
    return m.withColumn("p_value", normality(F.col("n"), F.col("skew"), F.col("excess"))).withColumn("gaussian", F.coalesce(F.col("p_value") > 0.05, F.lit(False)))


def inner_percentiles(k: int) -> list[float]:
    return [i / k for i in range(1, k)]


def value_counts(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """How often each value occurs per key, map-side first; NULL is no value."""
    return df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(counted: DataFrame, keys: list[str], x: str, qs: list[float], slices: int = 64) -> DataFrame:
    """``quantiles`` (linearly interpolated, in the order of ``qs``) per key of the values of ``value_counts``.

    A mergeable sketch only cuts each key into slices of values; rows before each slice are summed up, and a running count
    within the few slices that hold a wanted rank finds the exact values. No key is ever in one task. NULL keys have none.
    """
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(x, F.array(*[F.lit(i / slices) for i in range(1, slices)]), F.lit(1000)).alias("cuts"), F.sum("n").alias("rows"))
    placed = join_unique(counted, cuts, keys, "inner").select(*keys, x, "n", F.size(F.filter("cuts", lambda c: c < F.col(x))).alias("slice"))
    sizes = placed.groupBy(*keys, "slice").agg(F.sum("n").alias("size"))
    ahead = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    rank = lambda q: F.lit(q) * (F.col("rows") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), r.cast("bigint").alias("rank"), (rank(q) - F.floor(rank(q))).alias("part")) for i, q in enumerate(qs) for r in (F.floor(rank(q)), F.ceil(rank(q)))])).alias("w")
    wanted = cuts.select(*keys, wanted).select(*keys, "w.*").distinct()
    ranks = wanted.join(sizes, keys).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("size"))).select(*keys, "slice", "q", "rank", "part", "before")
    own = placed.join(ranks.select(*keys, "slice").distinct(), [*keys, "slice"], "left_semi")
    running = Window.partitionBy(*keys, "slice").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("upto", F.sum("n").over(running))
    hit = own.join(ranks, [*keys, "slice"]).where((F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n")))
    value = F.min(x) + (F.max(x) - F.min(x)) * F.max("part")
    each = hit.groupBy(*keys, "q").agg(value.alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "v"))), lambda s: s["v"]).alias("quantiles"))


def breakpoints(df: DataFrame, keys: list[str], x: str, k: int) -> DataFrame:
    """Empirical breakpoints: the k - 1 inner percentiles, linearly interpolated."""
    return exact_quantiles(written(value_counts(df, keys, x), "values"), keys, x, inner_percentiles(k)).withColumnRenamed("quantiles", "breakpoints")


def entropy(df: DataFrame, keys: list[str], x: str, sizes: range = range(3, 11)) -> DataFrame:
    """Entropy (bits) and efficiency of equal-frequency bins for each number of bins.

    Breakpoints of all sizes are found together; each distinct value is binned for all sizes in one pass.
    """
    counted = written(value_counts(df, keys, x), "values")
    qs = sorted({q for k in sizes for q in inner_percentiles(k)})
    marks = exact_quantiles(counted, keys, x, qs)
    of = lambda k: F.array(*[F.get("quantiles", F.lit(qs.index(q))) for q in inner_percentiles(k)])
    bins = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.size(F.filter(of(k), lambda b: b <= F.col(x))).alias("bin")) for k in sizes])).alias("s")
    binned = join_unique(counted, marks, keys, "inner").select(*keys, "n", bins).groupBy(*keys, "s.k", "s.bin").agg(F.sum("n").alias("n"))
    total = binned.groupBy(*keys, "k").agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    out = binned.join(total, [*keys, "k"]).groupBy(*keys, "k").agg(F.sum(-p * F.log2(p)).alias("entropy"))
    return out.withColumn("efficiency", F.col("entropy") / F.log2("k"))


__all__ = ["breakpoints", "entropy", "exact_quantiles", "inner_percentiles", "moments", "normality", "value_counts"]
