"""Whole trajectories as Column expressions: event-time resampling, handicap codes and the distances between them.

A trajectory is one stored array of structs; instants are epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.series import delta, let, mindist, sax_pick, zscore

HOUR = 3600.0
# Anchors and marks in hours before the start, bounds of the number of points, and the change that counts.
ANCHORS, MARKS = (48, 36, 24), tuple(range(24, 0, -2))
MOST_CHANGES, MOST_POINTS, CHANGE = 12, 16, 0.001
_SIDES = ("h", "d", "a")


def _minute(t: Column) -> Column:
    return F.floor(t / 60)


def _point(r: Column) -> Column:
    return F.struct(*[r[c].alias(c) for c in _SIDES])


def in_order(records: Column, fields: tuple[str, ...]) -> Column:
    """Records with an instant by time, those of one instant in stored order."""
    kept = F.transform(records, lambda r, i: F.struct(r["t"].alias("t"), i.alias("i"), *[r[c].alias(c) for c in fields]))
    return F.array_sort(F.filter(kept, lambda r: r["t"].isNotNull()))


def early_mean(rows: Column, until: Column) -> Column:
    """Mean of the records up to ``until``, each but the first weighted by the hours since the one before (0.1 if none passed);
    a single one stands for itself; without one, the first record of all."""

    def mean(e: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(e) - 1, F.lit(1)))

        def weight(i: Column) -> Column:
            hours = (F.get(e, i)["t"] - F.get(e, i - 1)["t"]) / HOUR
            return F.when(hours <= 0, 0.1).otherwise(hours)

        whole = F.aggregate(places, F.lit(0.0), lambda s, i: s + weight(i))
        side = lambda c: F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get(e, i)[c] * weight(i)) / whole
        return F.when(F.size(e) >= 2, F.struct(*[side(c).alias(c) for c in _SIDES])).when(F.size(e) == 1, _point(F.get(e, F.lit(0)))).otherwise(_point(F.get(rows, F.lit(0))))

    return let(F.filter(rows, lambda r: r["t"] <= until), mean)


def accepted_changes(rows: Column, start: Column, after: Column, until: Column) -> Column:
    """Times in (after, until] at which ``h`` differs by more than ``CHANGE`` from the last accepted value, at first ``start``."""
    seed = F.struct(start.alias("prev"), F.array().cast("array<double>").alias("at"))

    def step(s: Column, r: Column) -> Column:
        hit = F.abs(r["h"] - s["prev"]) > CHANGE
        return F.struct(F.when(hit, r["h"]).otherwise(s["prev"]).alias("prev"), F.when(hit, F.concat(s["at"], F.array(r["t"]))).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.filter(rows, lambda r: (r["t"] > after) & (r["t"] <= until)), seed, step)["at"]


def time_grid(changes: Column, kickoff: Column) -> Column:
    """The instants of the grid in order: anchors, the first changes of different minutes, marks while there is room, the start."""

    def adding(limit: int):
        def add(have: Column, t: Column) -> Column:
            free = (F.size(have) < limit) & ~F.exists(have, lambda x: _minute(x) == _minute(t))
            return F.when(free, F.concat(have, F.array(t))).otherwise(have)

        return add

    marks = lambda hours: F.array(*[kickoff - h * HOUR for h in hours])
    picked = F.aggregate(changes, F.array().cast("array<double>"), adding(MOST_CHANGES))
    filled = F.aggregate(marks(MARKS), picked, adding(MOST_POINTS))
    return F.array_sort(F.array_distinct(F.concat(marks(ANCHORS), filled, F.array(kickoff))))


def event_time(records: Column, kickoff: Column) -> Column:
    """16 to 20 points (structs h, d, a): opening, early mean, and at each later instant of the grid the last record strictly
    before it, else the early mean. ``records`` (t, h, d, a) may have NULLs: such a record does not count. NULL without any."""
    whole = F.filter(records, lambda r: r["t"].isNotNull() & r["h"].isNotNull() & r["d"].isNotNull() & r["a"].isNotNull())

    def series(rows: Column, early: Column) -> Column:
        changes = accepted_changes(rows, early["h"], kickoff - 24 * HOUR, kickoff)
        at = let(changes, lambda c: time_grid(c, kickoff))
        before = lambda p: F.try_element_at(F.filter(rows, lambda r: r["t"] < p), F.lit(-1))
        later = let(at, lambda g: F.transform(F.slice(g, F.lit(2), F.size(g)), lambda p: F.coalesce(let(before(p), _point_or_null), early)))
        return F.concat(F.array(_point(F.get(rows, F.lit(0))), early), later)

    made = let(in_order(whole, _SIDES), lambda rows: let(early_mean(rows, kickoff - 48 * HOUR), lambda early: series(rows, early)))
    return F.when((F.size(whole) > 0) & kickoff.isNotNull(), made)


def _point_or_null(r: Column) -> Column:
    return F.when(r.isNotNull(), _point(r))


def line_changes(lines: Column) -> Column:
    """How often the line differs from the one before it, NULL being a line like any other."""
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1))), lambda i: (F.size(lines) > 1) & ~F.get(lines, i).eqNullSafe(F.get(lines, i - 1))))


def handicap_points(records: Column, points: int) -> Column:
    """The records (t, home, away, line) that are encoded: with fewer than three instants up to ``points`` picked in stored
    order; else those with one, by time, picked if there are ``points`` or more."""

    def picked(x: Column, k: Column) -> Column:
        n = F.size(x)
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.get(x, F.when(i == k - 1, n - 1).otherwise(F.floor(i * ((n - 1) / (k - 1).cast("double"))).cast("int"))))

    timed = in_order(records, ("home", "away", "line"))
    bare = lambda rows: F.transform(rows, lambda r: F.struct(r["home"].alias("home"), r["away"].alias("away")))

    def choose(t: Column) -> Column:
        loose = picked(bare(records), F.least(F.size(records), F.lit(points)))
        return F.when(F.size(t) < 3, loose).when(F.size(t) >= points, picked(bare(t), F.lit(points))).otherwise(bare(t))

    return F.when(F.size(records) >= 2, let(timed, choose))


def handicap_codes(records: Column, word: int, breakpoints: list[float], length: int = 32, raw: bool = False) -> Column:
    """Codes of home price, away price and their difference, and what else is told of the record; NULL for under two readings.

    ``records`` (t, home, away, line): a reading without a price does not count. ``raw``: stored order, prices as they are.
    """
    kept = F.filter(records, lambda r: r["home"].isNotNull() & r["away"].isNotNull())

    def side(rows: Column, c: str) -> Column:
        x = F.transform(rows, lambda r: r[c])
        return x if raw else zscore(x)

    def codes(rows: Column) -> Column:
        points = rows if raw else handicap_points(rows, 2 * word)

        def made(h: Column, a: Column) -> Column:
            return F.struct(*[sax_pick(x, word, breakpoints, length).alias(n) for n, x in (("sax_home", h), ("sax_away", a), ("sax_diff", delta(h, a)))])

        words = let(points, lambda p: let(side(p, "home"), lambda h: let(side(p, "away"), lambda a: made(h, a))))
        first, last = F.get(rows, F.lit(0)), F.get(rows, F.size(rows) - 1)
        return F.struct(
            *[words[n].alias(n) for n in ("sax_home", "sax_away", "sax_diff")], line_changes(F.transform(rows, lambda r: r["line"])).alias("handicap_changes"), F.size(rows).alias("n_readings"),
            (last["home"] - first["home"]).alias("home_change"), (last["away"] - first["away"]).alias("away_change"),
            first["home"].alias("home_initial"), last["home"].alias("home_final"), first["away"].alias("away_initial"), last["away"].alias("away_final"),
        )

    return let(kept, lambda rows: F.when(F.size(rows) >= 2, codes(rows)))


def handicap_distance(a: Column, b: Column, word: int, k: int) -> Column:
    """Mean of the three codes' distances; infinite where one is missing."""
    return sum((mindist(a[c], b[c], word, k) for c in ("sax_home", "sax_away", "sax_diff")), F.lit(0.0)) / 3


def combined_distance(interleaved: Column, difference: Column, handicap: Column | None = None) -> Column:
    """The mean of both words' distances, or the first where the second is missing (infinite or NULL); with a finite handicap
    distance 0.6 of that and 0.4 of the handicap's."""
    finite = lambda x: x.isNotNull() & (x < float("inf"))
    prices = F.when(finite(difference), (interleaved + difference) / 2).otherwise(interleaved)
    return prices if handicap is None else F.when(finite(handicap), prices * 0.6 + handicap * 0.4).otherwise(prices)
