"""Kernels over numeric series, as Column expressions on arrays of double; sums run in array order."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def zscore(x: Column) -> Column:
    """(x - mean) / population deviation; only centred where the deviation is 0."""

    def centred(c: Column) -> Column:
        return let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v) / F.size(c)), lambda dev: F.transform(c, lambda v: F.when(dev == 0, v).otherwise(v / dev)))

    return let(x, lambda x: let(let(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)), centred))


def paa(x: Column, t: int) -> Column:
    return let(x, lambda x: _paa(x, t))


def _paa(x: Column, t: int) -> Column:
    """Means of ``t`` segments [int(i n/t), int((i+1) n/t)); the element itself where a segment is empty."""
    n = F.size(x)
    step = n / F.lit(float(t))

    def mean(i: Column) -> Column:
        a, e = F.floor(i * step).cast("int"), F.least(F.floor((i + 1) * step).cast("int"), n)
        return F.when(e > a, total(F.slice(x, a + 1, F.greatest(e - a, F.lit(1)))) / (e - a)).otherwise(F.get(x, a))

    return F.when(n == t, x).otherwise(F.transform(F.sequence(F.lit(0), F.lit(t - 1)), mean))


def upsample(x: Column, length: int) -> Column:
    return let(x, lambda x: _upsample(x, length))


def _upsample(x: Column, length: int) -> Column:
    """Linear interpolation at ``length`` even positions."""
    n = F.size(x)

    def at(i: Column) -> Column:
        p = i * ((n - 1) / F.lit(float(max(length - 1, 1))))
        lo = F.least(F.floor(p).cast("int"), n - 1)
        hi = F.least(lo + 1, n - 1)
        return F.get(x, lo) + (F.get(x, hi) - F.get(x, lo)) * (p - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def gather(x: Column, k: int) -> Column:
    return let(x, lambda x: _gather(x, k))


def _gather(x: Column, k: int) -> Column:
    """Elements at floor(i (n-1)/(k-1)), the last always the last."""
    n = F.size(x)

    def at(i: Column) -> Column:
        return F.get(x, F.when(i == k - 1, n - 1).otherwise(F.floor(i * ((n - 1) / F.lit(float(max(k - 1, 1))))).cast("int")))

    return F.when(n == k, x).otherwise(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), at))


def resample_mean(x: Column, length: int) -> Column:
    return let(x, lambda x: _resample_mean(x, length))


def _resample_mean(x: Column, length: int) -> Column:
    n = F.size(x)
    return F.when(n == length, x).when(n < length, upsample(x, length)).otherwise(paa(x, length))


def resample_pick(x: Column, length: int) -> Column:
    return let(x, lambda x: _resample_pick(x, length))


def _resample_pick(x: Column, length: int) -> Column:
    n = F.size(x)
    return F.when(n == length, x).when(n < length, upsample(x, length)).otherwise(gather(x, length))


def gaussian_breakpoints(k: int) -> list[float]:
    return [NormalDist().inv_cdf(i / k) for i in range(1, k)]


def symbols(x: Column, breakpoints: list[float]) -> Column:
    """One letter per value: a for values under the first breakpoint, the next letter from each breakpoint on."""
    marks = F.array(*[F.lit(float(b)) for b in breakpoints])
    letters = F.lit("".join(chr(97 + i) for i in range(len(breakpoints) + 1)))
    return F.array_join(F.transform(x, lambda v: F.substring(letters, F.size(F.filter(marks, lambda b: b <= v)) + 1, F.lit(1))), "")


def sax_word(x: Column, word: int, breakpoints: list[float], length: int) -> Column:
    """Resample by means, normalise, segment means, letters; a word of a's for fewer than two values."""
    return let(x, lambda x: F.when(F.size(x) < 2, F.lit("a" * word)).otherwise(symbols(paa(zscore(resample_mean(x, length)), word), breakpoints)))


def sax_pick(x: Column, word: int, breakpoints: list[float], length: int) -> Column:
    """Resample by picking, pick ``word`` values, letters; the caller normalises."""
    return let(x, lambda x: F.when(F.size(x) < 2, F.lit("a" * word)).otherwise(symbols(gather(resample_pick(x, length), word), breakpoints)))


def interleave(*xs: Column) -> Column:
    """x0[0], x1[0], ..., x0[1], x1[1], ... as far as the shortest goes."""
    n = F.least(*[F.size(x) for x in xs])
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.array(*[F.get(x, i) for x in xs]))))


def delta(a: Column, b: Column) -> Column:
    return F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), F.slice(b, 1, F.least(F.size(a), F.size(b))), lambda x, y: x - y)


def draw_deviation(h: Column, d: Column, a: Column) -> Column:
    return F.zip_with(d, F.zip_with(h, a, lambda x, y: (x + y) / 2), lambda x, y: x - y)


def change_points(x: Column, start: Column, threshold: float = 0.001) -> Column:
    """Indices whose value differs by more than ``threshold`` from the last accepted value."""
    seed = F.struct(start.cast("double").alias("prev"), F.array().cast("array<int>").alias("at"), F.lit(0).alias("i"))

    def step(s: Column, v: Column) -> Column:
        hit = F.abs(v - s["prev"]) > threshold
        return F.struct(F.when(hit, v).otherwise(s["prev"]).alias("prev"), F.when(hit, F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

    return F.aggregate(x, seed, step)["at"]


def hamming(a: Column, b: Column) -> Column:
    """Differing places over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.size(F.filter(F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: x != y), lambda d: d))


# Breakpoints with two decimals, by alphabet size, which the symbolic distance uses.
DISTANCE_BREAKPOINTS = {
    3: [-0.43, 0.43], 4: [-0.67, 0, 0.67], 5: [-0.84, -0.25, 0.25, 0.84], 6: [-0.97, -0.43, 0, 0.43, 0.97],
    7: [-1.07, -0.57, -0.18, 0.18, 0.57, 1.07], 8: [-1.15, -0.67, -0.32, 0, 0.32, 0.67, 1.15],
}
TOP = 3.0


def cost_table(k: int, variant: str = "search") -> list[float]:
    """Squared cost of letters r and c at r * k + c.

    ``search``: neighbours cost (0.1 squared, or a quarter of the squared gap below the lower one), others the squared gap of
    their breakpoints, the top letter's being ``TOP``. ``cluster``: neighbours cost nothing. ``standard``: the literature's
    lower bound, neighbours nothing, others the gap between the upper's lower and the lower's upper breakpoint.
    """
    b = DISTANCE_BREAKPOINTS[k]
    ext = [*b, TOP]

    def cost(r: int, c: int) -> float:
        lo, hi = min(r, c), max(r, c)
        if lo == hi:
            return 0.0
        if hi - lo == 1:
            return (0.01 if lo == 0 else (b[lo] - b[lo - 1]) ** 2 / 4) if variant == "search" else 0.0
        return (b[hi - 1] - b[lo]) ** 2 if variant == "standard" else (ext[hi] - ext[lo]) ** 2

    return [cost(r, c) for r in range(k) for c in range(k)]


def mindist(a: Column, b: Column, word: int | Column, k: int | Column, variant: str = "search") -> Column:
    """Distance of two words; infinite where one is NULL or empty. ``word`` and ``k`` may differ by row; then k is 3 to 8."""
    word = word if isinstance(word, Column) else F.lit(word)
    if isinstance(k, Column):
        sizes = sorted(DISTANCE_BREAKPOINTS)
        table = F.get(F.array(*[F.array(*[F.lit(float(x)) for x in cost_table(n, variant)]) for n in sizes]), k - sizes[0])
    else:
        table = F.array(*[F.lit(float(x)) for x in cost_table(k, variant)])
    m = F.least(F.length(a), F.length(b), word)

    def letter(s: Column, i: Column) -> Column:
        return F.ascii(F.substring(s, i, F.lit(1))) - 97

    cost = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda s, i: s + F.coalesce(F.get(table, letter(a, i) * k + letter(b, i)), F.lit(0.0)))
    return F.when(a.isNull() | b.isNull() | (m <= 0), F.lit(float("inf"))).otherwise(F.sqrt(cost / word))


def sax_free(x: Column, word: int, breakpoints: list[float]) -> Column:
    """A word without a fixed length: normalised, segment means, letters; a series shorter than the word is first brought to twice its length."""
    return let(x, lambda x: F.when(F.size(x) < 2, F.lit("a" * word)).otherwise(symbols(paa(zscore(F.when(F.size(x) < word, upsample(x, 2 * word)).otherwise(x)), word), breakpoints)))


#: Points of a series in the batch encoding.
BATCH = 20


def batch_resample(x: Column, points: int = BATCH) -> Column:
    """``points`` picked values, normalised (indices repeat in a shorter series); empty for fewer than two values."""
    return let(x, lambda x: F.when(F.size(x) < 2, F.array().cast("array<double>")).otherwise(zscore(gather(x, points))))


def batch_words(h: Column, d: Column, a: Column, word: int, breakpoints: list[float], joint_only: bool = False) -> dict[str, Column]:
    """The batch codes of three raw series: one word each, the interleaved word, and the difference's (NULL with ``joint_only``)."""
    h, d, a = (batch_resample(x) for x in (h, d, a))
    one = {f"sax_{n}": sax_pick(x, word, breakpoints, BATCH) for n, x in (("home", h), ("draw", d), ("away", a))}
    difference = F.lit(None).cast("string") if joint_only else sax_pick(delta(h, a), word, breakpoints, BATCH)
    return one | {"sax_interleaved": sax_pick(interleave(h, d, a), word, breakpoints, 3 * BATCH), "sax_delta": difference}


def mean_dev(x: Column) -> tuple[Column, Column]:
    """Mean and population deviation of a raw series, rounded to 3 places."""
    mean = total(x) / F.size(x)
    return F.round(mean, 3), F.round(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.size(x)), 3)
