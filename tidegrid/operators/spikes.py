"""Implausible readings of prices, flagged against their own source's normal behaviour.

Four findings per reading (a source is a match and bookmaker; readings of one stored list are neighbours):

* ``impossible``: a numeric price at or under ``low`` or over ``high``;
* ``stuck``: one of ``run`` or more neighbouring readings with the same prices (zero variance), all of the run;
* ``spike``: a price whose distance to the level before and after it lies outside the source's fence and from which the
  series comes back within ``width`` readings. A lasting change of level never comes back and is none;
* ``fast`` (with ``rates``): a price that changed by more than ``candidate`` and faster per hour than the source's fence of
  rates of change allows, whether or not it comes back.

The fences come from quantile sketches of a source's steps (absolute log changes between neighbouring prices that are no
candidates, or all of a price of which more than ``often`` of a list's readings are) and of its rates (steps per hour, of
neighbours with different instants), bucketed by hour context. A sketch is a fixed number of counters over logarithmic
buckets, so sketches of the same source made in different partitions merge by addition, exactly, and map-side. An hour
context is judged by its own counters plus the whole source's at the weight of ``enough`` steps: few steps lean on the
source, many stand for themselves, at every size. Fence: Q3 + ``spread`` * (Q3 - Q1), widened by 1 + ``small`` / n for n
steps of the source, and never under ``least``.

Defined results: a price that is no number is no reading of that price, and breaks a run; a NULL time has its own hour
context and no rate; sources with NULL in the key are sources like any other; equal neighbours, repeated rows and rows of one
reading are judged as they are; empty input gives no row. A source with a third of all rows is joined apart (``skew``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegrid.operators.nested import NestedTable, Stage, flatten
from tidegrid.operators.skew import join_unique
from tidegrid.operators.timestamps import OK, created_microseconds, parse_times
from tidegrid.operators.zones import current_version
from tidegrid.session import written

#: Counters of a sketch: bucket k holds steps from FIRST * GROWTH ** k; of rates per hour, from RATE_FIRST * RATE_GROWTH ** k.
BUCKETS, FIRST, GROWTH = 32, 0.0006, 1.28
RATE_FIRST, RATE_GROWTH = 0.0001, 1.5


@dataclass(frozen=True)
class SpikeRules:
    low: float = 1.0
    high: float = 1000.0
    run: int = 6
    width: int = 2
    candidate: float = 0.045
    back: float = 0.5
    spread: float = 5.5
    small: float = 4.0
    least: float = 0.065
    enough: int = 24
    context_hours: int = 12
    often: float = 0.5


def numbers(column: pa.Array) -> np.ndarray:
    """Numeric value of each text, NaN where it is no plain decimal number."""
    text = pc.utf8_trim_whitespace(column.fill_null(""))
    good = pc.match_substring_regex(text, r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    return np.asarray(pc.if_else(good, text, pa.scalar("nan")).cast(pa.float64()))


def spike_candidates(x: np.ndarray, group: np.ndarray, rules: SpikeRules) -> np.ndarray:
    """For each value the log distance it keeps to the levels around it if the series comes back, else 0.

    ``x``: log prices, ``group``: the list of each, both in stored order. The level before is the median of up to three
    values before the excursion, the level after that of up to three after it.
    """
    n, out = len(x), np.zeros(len(x))
    if n < 3:
        return out

    def near(start: int, step: int, i: np.ndarray) -> np.ndarray:
        cols = []
        for k in range(3):
            j = i + start + step * k
            inside = (j >= 0) & (j < n)
            same = inside & (group[np.clip(j, 0, n - 1)] == group[i])
            cols.append(np.where(same, x[np.clip(j, 0, n - 1)], np.nan))
        three = np.stack(cols, axis=1)
        count = np.isfinite(three).sum(axis=1)
        level = np.where(count == 3, np.sort(three, axis=1)[:, 1], three[:, 0])
        return level

    i = np.arange(n)
    before = near(-1, -1, i)
    for w in range(1, rules.width + 1):
        after = near(w, 1, i)
        members = [np.clip(i + k, 0, n - 1) for k in range(w)]
        whole = (i + w - 1 < n) & np.isfinite(before) & np.isfinite(after)
        for m in members:
            whole &= group[m] == group[i]
        away = np.min([np.minimum(np.sign(x[m] - before) * np.sign(x[members[0]] - before) * np.abs(x[m] - before), np.sign(x[m] - after) * np.sign(x[members[0]] - before) * np.abs(x[m] - after)) for m in members], axis=0)
        hit = whole & (away >= rules.candidate) & (np.abs(after - before) <= rules.back * away)
        for m in members:
            np.maximum.at(out, m[hit], away[hit])
    return out


def judge_lists(prices: np.ndarray, group: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Impossible and stuck flags, the candidate distance (largest over prices), and per price (rows, log steps)."""
    n = len(group)
    with np.errstate(invalid="ignore"):
        impossible = ((prices <= rules.low) | (prices > rules.high)).any(axis=1)
    same = np.zeros(n, bool)
    same[1:] = (group[1:] == group[:-1]) & (prices[1:] == prices[:-1]).all(axis=1)
    run = np.cumsum(~same) - 1 if n else np.zeros(0, int)
    stuck = np.bincount(run, minlength=1)[run] >= rules.run if n else np.zeros(0, bool)
    away, steps = np.zeros(n), []
    for k in range(prices.shape[1]):
        with np.errstate(invalid="ignore"):
            rows = np.flatnonzero((prices[:, k] > rules.low) & (prices[:, k] <= rules.high))
        x = np.log(prices[rows, k])
        far = spike_candidates(x, group[rows], rules)
        # where most values of a price leave and come back, that is its normal behaviour: its steps widen the fence, which decides
        own = group[rows]
        usual = np.bincount(own, far > 0, minlength=1) > rules.often * np.bincount(own, minlength=1) if len(own) else np.zeros(1, bool)
        away[rows] = np.maximum(away[rows], far)
        normal = (far == 0) | usual[own]
        calm = rows[normal]
        y = x[normal]
        next_to = group[calm[1:]] == group[calm[:-1]]
        steps.append((calm[1:][next_to], np.abs(np.diff(y))[next_to]))
    return impossible, stuck, away, steps


def bucket(step: np.ndarray, first: float = FIRST, growth: float = GROWTH) -> np.ndarray:
    return np.clip(np.floor(np.log(np.maximum(step, first) / first) / np.log(growth)), 0, BUCKETS - 1).astype(np.int64)


def rates_of_change(prices: np.ndarray, group: np.ndarray, epoch: np.ndarray, known: np.ndarray, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per change between neighbouring prices with different known instants: the row, its log step and the rate per hour."""
    rows, steps, rates = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
    for k in range(prices.shape[1]):
        with np.errstate(invalid="ignore"):
            at = np.flatnonzero((prices[:, k] > rules.low) & (prices[:, k] <= rules.high) & known)
        a, b = at[:-1], at[1:]
        hours = np.abs(epoch[b] - epoch[a]) / 3600
        use = (group[a] == group[b]) & (hours > 0)
        step = np.abs(np.log(prices[b[use], k]) - np.log(prices[a[use], k]))
        rows, steps, rates = [*rows, b[use]], [*steps, step], [*rates, step / hours[use]]
    return np.concatenate(rows), np.concatenate(steps), np.concatenate(rates)


_TAGGED = (
    T.StructField("key", T.LongType()),
    T.StructField("bookmaker", T.StringType()),
    T.StructField("context", T.IntegerType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
    T.StructField("id", T.LongType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("impossible", T.BooleanType()),
    T.StructField("stuck", T.BooleanType()),
    T.StructField("away", T.DoubleType()),
    T.StructField("rate", T.DoubleType()),
)


def _sketches(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches that have a counter among the cells (sketch * BUCKETS + bucket), and their counters."""
    cells, count = np.unique(cell, return_counts=True)
    own, sketch = np.unique(cells // BUCKETS, return_inverse=True)
    table = np.zeros((len(own), BUCKETS), np.int32)
    table[sketch, cells % BUCKETS] = count
    return own, table


def _stage(rules: SpikeRules, with_rates: bool) -> Stage:
    schema, version = to_arrow_schema(T.StructType(list(_TAGGED))), current_version()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        prices = np.stack([numbers(b[c]) for c in ("home", "draw", "away")], axis=1) if n else np.zeros((0, 3))
        row, entry, seq = np.asarray(b["row"]), np.asarray(b["entry_no"]), np.asarray(b["seq"])
        head = np.r_[True, (row[1:] != row[:-1]) | (entry[1:] != entry[:-1]) | (seq[1:] <= seq[:-1])] if n else np.zeros(0, bool)
        group = np.cumsum(head) - 1
        impossible, stuck, away, steps = judge_lists(prices, group, rules)
        status, epoch, _ = parse_times(b["time"], b["year"], created_microseconds(b["created_at"]), version=version)
        context = np.where(status == OK, epoch // 3600 % 24 // rules.context_hours, -1).astype(np.int64)
        width = 24 // rules.context_hours + 1
        place = group * width + context + 1  # one per list and hour context
        # kind 0: steps, kind 1: rates of change
        cell = [(2 * place[r]) * BUCKETS + bucket(s) for r, s in steps]
        rate = np.zeros(n)
        if with_rates:
            at, step, speed = rates_of_change(prices, group, epoch, status == OK, rules)
            cell.append((2 * place[at] + 1) * BUCKETS + bucket(speed, RATE_FIRST, RATE_GROWTH))
            big = step > rules.candidate
            np.maximum.at(rate, at[big], speed[big])
        own, table = _sketches(np.concatenate(cell) if n else np.zeros(0, np.int64))
        kind, own = own % 2, own // 2
        first = np.flatnonzero(head)[own // width] if len(own) else np.zeros(0, np.int64)
        flagged = np.flatnonzero(impossible | stuck | (away > 0) | (rate > 0))
        at, k, m = np.r_[first, flagged].astype(np.int64), len(own), len(flagged)
        none = lambda kind, size: pa.nulls(size, kind)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * BUCKETS), pa.array(table.ravel()))
        columns = [
            b["schedule_id"].take(pa.array(at)), b["bookmaker"].take(pa.array(at)),
            pa.array(np.r_[own % width - 1, context[flagged]].astype(np.int32)),
            pa.concat_arrays([pa.array(kind.astype(np.int32)), none(pa.int32(), m)]),
            pa.concat_arrays([lists, none(lists.type, m)]),
            pa.concat_arrays([none(pa.int64(), k), b["id"].take(pa.array(flagged)).cast(pa.int64())]),
            pa.concat_arrays([none(pa.int32(), k), pa.array(seq[flagged].astype(np.int32))]),
            pa.array(np.r_[np.zeros(k, bool), impossible[flagged]]), pa.array(np.r_[np.zeros(k, bool), stuck[flagged]]),
            pa.array(np.r_[np.zeros(k), away[flagged]]), pa.array(np.r_[np.zeros(k), rate[flagged]]),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return Stage(_TAGGED, run)


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch per key: counters added up, map-side first."""
    merged = sketches.groupBy(*keys).agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"b{i}") for i in range(BUCKETS)])
    return merged.select(*keys, F.array(*[F.coalesce(f"b{i}", F.lit(0)) for i in range(BUCKETS)]).alias("counts"))


def sketch_quantile(counts: np.ndarray, q: float, first: float = FIRST, growth: float = GROWTH) -> np.ndarray:
    """Middle of the bucket that holds the quantile, for each row of counters."""
    reached = np.cumsum(counts, axis=1) >= counts.sum(axis=1, keepdims=True) * q - 1e-9
    return first * growth ** (reached.argmax(axis=1) + 0.5)


def fences(contexts: np.ndarray, source: np.ndarray, rules: SpikeRules, rate: bool = False) -> np.ndarray:
    """The fence of each hour context. ``contexts``: a row of counters each; ``source``: the number of the source of each."""
    scale = (RATE_FIRST, RATE_GROWTH) if rate else (FIRST, GROWTH)
    whole = np.zeros((source.max(initial=-1) + 1, BUCKETS))
    np.add.at(whole, source, contexts)
    n = whole.sum(axis=1)[source]
    blend = contexts + whole[source] * (rules.enough / np.maximum(n, 1))[:, None]
    q1, q3 = sketch_quantile(blend, 0.25, *scale), sketch_quantile(blend, 0.75, *scale)
    limit = (q3 + rules.spread * (q3 - q1)) * (1 + rules.small / np.maximum(n, 1))
    return limit if rate else np.maximum(limit, rules.least)


_FENCES = "key bigint, no_key boolean, name string, no_name boolean, contexts array<int>, limits array<double>, whole double, rate_limits array<double>"


def _fences(merged: DataFrame, rules: SpikeRules) -> DataFrame:
    """A row per source with the fence of each of its hour contexts, and of a context that has no steps (``whole``).

    ``merged`` has a row per source, kind and context; a source has few contexts, which come together for one Arrow pass.
    """
    grouped = merged.groupBy("key", "no_key", "name", "no_name").agg(F.collect_list(F.struct("kind", "context", "counts")).alias("s"))
    schema = to_arrow_schema(T._parse_datatype_string(_FENCES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(b["s"].value_lengths())
            flat = b["s"].flatten()
            kind, context = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
            counts = np.asarray(flat.field(2).flatten()).reshape(-1, BUCKETS).astype(np.float64)
            source = np.repeat(np.arange(b.num_rows), sizes)
            steps, rates = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            limit = fences(counts[steps], source[steps], rules)
            whole = np.full(b.num_rows, rules.least)
            total = np.zeros((b.num_rows, BUCKETS))
            np.add.at(total, source[steps], counts[steps])
            some = np.flatnonzero(total.sum(axis=1) > 0)
            whole[some] = fences(total[some], np.arange(len(some)), rules)
            # a rate's fence stands at its context's place; infinite where the context has no rate
            number = {(s, c): i for i, (s, c) in enumerate(zip(source[steps].tolist(), context[steps].tolist(), strict=True))}
            fast = np.full(len(steps), np.inf)
            for s, c, x in zip(source[rates].tolist(), context[rates].tolist(), fences(counts[rates], source[rates], rules, rate=True).tolist(), strict=True):
                if (s, c) in number:
                    fast[number[s, c]] = x
            offsets = pa.array(np.searchsorted(source[steps], np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(context[steps].astype(np.int32)), pa.array(limit))]
            columns = [b["key"], b["no_key"], b["name"], b["no_name"], *lists, pa.array(whole), pa.ListArray.from_arrays(offsets, pa.array(fast))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return grouped.mapInArrow(run, _FENCES)


def flag_readings(df: DataFrame, json_column: str, spec: NestedTable, rules: SpikeRules | None = None, rates: bool = False) -> DataFrame:
    """Flagged readings of the nested lists in ``df``: id, bookmaker, seq, impossible, stuck, spike, away, fence, and with
    ``rates`` fast and rate.

    ``df`` has id, schedule_id, created_at and the JSON column; ``spec`` yields entry_no, bookmaker, seq, three prices,
    time and year. One pass over the texts leaves sketches and candidates, which are written once; only the candidates are
    joined with the fences of their sources.
    """
    rules = rules or SpikeRules()
    marked = df.select("id", "schedule_id", "created_at", json_column, F.monotonically_increasing_id().alias("row"))
    tagged = written(flatten(marked, json_column, spec, ["id", "schedule_id", "created_at", "row"], _stage(rules, rates)), "spikes")
    source = ["key", "no_key", "name", "no_name"]  # sources with a NULL are joined like any other
    tagged = tagged.select("*", F.coalesce("bookmaker", F.lit("")).alias("name"), F.col("bookmaker").isNull().alias("no_name"), F.col("key").isNull().alias("no_key")).withColumn("key", F.coalesce("key", F.lit(0)))
    merged = merge_sketches(tagged.where("counts is not null"), [*source, "kind", "context"])
    hits = tagged.where("counts is null").select(*source, "bookmaker", "id", "seq", "impossible", "stuck", "away", "rate", "context")
    near = join_unique(hits, _fences(merged, rules), source, "left")
    at = F.array_position("contexts", F.col("context")).cast("int") - 1
    limit = F.coalesce(F.get("limits", at), F.col("whole"), F.lit(rules.least))
    fast = F.coalesce(F.col("rate") > F.get("rate_limits", at), F.lit(False)) & (F.col("rate") > 0)
    flags = ["impossible", "stuck", ((F.col("away") > 0) & (F.col("away") > limit)).alias("spike")]
    out = near.select("id", "bookmaker", "seq", *flags, "away", limit.alias("fence"), *([fast.alias("fast"), "rate"] if rates else []))
    return out.where("impossible or stuck or spike" + (" or fast" if rates else ""))
